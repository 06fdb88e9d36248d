"""factloom: published contact facts from tables of web pages, on Spark."""
