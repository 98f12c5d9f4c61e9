"""Table sources. The schema always comes from outside; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# The fixed format has no quotes, escapes or header, and its only line end is the line feed.
LINE_END = "\n"
PLAIN_CSV = {"header": "false", "quote": "", "escape": "", "mode": "FAILFAST", "lineSep": LINE_END}


def filled_text(df: DataFrame) -> DataFrame:
    """Empty text fields as empty strings: the format has no null, but a CSV reader says null."""
    return df.select(
        *[
            F.coalesce(F.col(f.name), F.lit("")).alias(f.name, metadata=f.metadata)
            if isinstance(f.dataType, T.StringType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Headerless comma file in the fixed CSV format; a row that does not parse fails the job."""
    return read_delimited(spark, path, schema, ",")


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, sep: str = "|") -> DataFrame:
    return filled_text(spark.read.schema(schema).options(**PLAIN_CSV).csv(path, sep=sep))


def read_parquet_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet table; with a schema only its columns are read."""
    df = spark.read.parquet(path)
    return df.select(*schema.names) if schema else df


def jdbc_options(
    url: str,
    table: str,
    column: str | None = None,
    lower: int | None = None,
    upper: int | None = None,
    read_partitions: int = 1,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    """Options of a database read cut into ``read_partitions`` ranges of a numeric column."""
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_size)}
    if read_partitions > 1:
        if column is None or lower is None or upper is None:
            raise ValueError("a partitioned read needs column, lower and upper")
        options.update(
            partitionColumn=column,
            lowerBound=str(lower),
            upperBound=str(upper),
            numPartitions=str(read_partitions),
        )
    return options


def read_jdbc_table(spark: SparkSession, url: str, table: str, read_par: int | None = None, **options) -> DataFrame:
    """Database read. Filters and column choices made on the result are pushed into the database.

    ``read_partitions`` ranges are read, each by one task; ``read_par`` below that joins ranges, so
    that no more connections than that are open at once.
    """
    df = spark.read.format("jdbc").options(**jdbc_options(url, table, **options)).load()
    return df.coalesce(read_par) if read_par else df
