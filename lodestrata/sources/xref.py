"""Cross references from a database: three tables over JDBC, under the names that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Columns of the database's tables: their table, name there, name here.
COLUMNS = {
    "References": [("SourceId", "source_id"), ("TargetId", "target_id"), ("Kind", "kind"), ("Line", "line"), ("Column", "column")],
    "Names": [("Id", "id"), ("Path", "path"), ("ModuleId", "module_id")],
    "Modules": [("Id", "id"), ("Module", "module")],
}


def read_xref(spark: SparkSession, url: str, driver: str | None = None, quote: str = '"', parts: int = 1, bounds: tuple[int, int] | None = None, **options: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(references, names, modules). With `parts` and `bounds` of the source id, references are read by as many connections."""

    def read(table: str, **more: str) -> DataFrame:
        wanted = ", ".join(f"{quote}{there}{quote} AS {quote}{here}{quote}" for there, here in COLUMNS[table])
        r = spark.read.format("jdbc").options(url=url, dbtable=f"(SELECT {wanted} FROM {quote}{table}{quote}) x", **options, **more)
        return (r.option("driver", driver) if driver else r).load()

    split = {} if bounds is None else {"partitionColumn": f"{quote}source_id{quote}", "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(parts)}
    return read("References", **split), read("Names"), read("Modules")
