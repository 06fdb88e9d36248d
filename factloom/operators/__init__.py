"""DataFrame to DataFrame steps with joins, windows or grouping."""
