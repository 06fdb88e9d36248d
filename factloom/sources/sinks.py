"""CSV, JSON and text output of contact facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.names import display


def csv_rows(facts: DataFrame) -> DataFrame:
    """The ten text columns: people and phones joined by ``; ``, warnings by `` | ``, missing values empty."""
    joined = {
        "names": F.array_join(F.transform("names", display), "; "),
        "phones": F.array_join("phones", "; "),
        "warnings": F.array_join("warnings", " | "),
    }
    return facts.select(*(F.coalesce(joined.get(c, F.col(c)), F.lit("")).alias(c) for c in fixed.CSV_COLUMNS))


def table_rows(facts: DataFrame) -> DataFrame:
    """The columns of an on-screen table: those of the CSV without the address."""
    return csv_rows(facts).drop("address_raw")


def write_csv(facts: DataFrame, path: str) -> None:
    """A folder with one UTF-8 file: a header and rows in input order (a report, hence one task)."""
    ordered = facts.orderBy("site_ord") if "site_ord" in facts.columns else facts
    csv_rows(ordered).coalesce(1).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def json_rows(facts: DataFrame) -> DataFrame:
    """One JSON object a row, nulls shown."""
    return facts.select(F.to_json(F.struct(*(c for c in facts.columns if c != "site_ord")), {"ignoreNullFields": "false"}).alias("json"))


def write_json(facts: DataFrame, path: str) -> None:
    facts.drop("site_ord").write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def human_text() -> Column:
    """A labelled block of lines; a line without value says so, or goes where nothing is to be said."""
    values = {"names": F.array_join(F.transform("names", display), ", "), "phones": F.array_join("phones", ", ")}

    def line(name: str) -> Column:
        label, missing = fixed.LABELS[name]
        if name == "warnings":
            return F.when(F.size("warnings") > 0, F.concat(F.lit(label + fixed.WARNING_MARK), F.array_join("warnings", fixed.WARNING_MARK)))
        value = F.nullif(values.get(name, F.col(name)), F.lit(""))
        return F.concat(F.lit(label), value if missing is None else F.coalesce(value, F.lit(missing)))

    return F.concat_ws("\n", *map(line, fixed.LABELS))
