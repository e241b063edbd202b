"""Tables of a folder of Parquet files, and other file sources and sinks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Full scan of one table; filters and columns are pushed into it by the optimizer."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> None:
    """Temporary views of the tables, for SQL text."""
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, header: bool = True) -> DataFrame:
    """Rows of CSV files. The schema is declared: nothing is inferred, malformed rows are an error."""
    return spark.read.schema(schema).option("header", header).option("mode", "FAILFAST").csv(path)


def read_json(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write(df: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = (), replace: bool = False) -> None:
    """Write to Parquet, CSV, JSON or ORC; an existing target is an error unless it is to be replaced."""
    out = df.write.mode("overwrite" if replace else "errorifexists").format(kind)
    if kind == "csv":
        out = out.option("header", True)
    (out.partitionBy(*partition_by) if partition_by else out).save(path)


def write_text(df: DataFrame, path: str, form: dict[str, str]) -> None:
    """Write delimited text with these options of Spark's CSV writer; an existing target is an error."""
    df.write.mode("errorifexists").options(**form).csv(path)


def read_orc(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).orc(path)


def spool(df: DataFrame, rows: int = 1024) -> Iterator[list[Row]]:
    """A result as lists of at most ``rows`` rows in its order; the driver holds one partition and the next."""
    page: list[Row] = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        page.append(row)
        if len(page) == rows:
            yield page
            page = []
    if page:
        yield page


def seed_accounts(spark: SparkSession) -> DataFrame:
    """Four example accounts."""
    rows = [(1, "ada@example.com", "Ada", 1), (2, "bea@example.com", "Bea", 1), (3, "cid@example.com", "Cid", 0), (4, "dan@example.com", "Dan", 1)]
    return spark.createDataFrame(rows, "id bigint, email string, name string, status tinyint")


def seed_notes(spark: SparkSession) -> DataFrame:
    """Eight example notes, two for each account."""
    rows = [(i, (i + 1) // 2, f"note {i}") for i in range(1, 9)]
    return spark.createDataFrame(rows, "id bigint, account_id bigint, body string")
