"""Request logs: JSON lines in, rows and rejects out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelode.schemas import REQUEST_LOG

CORRUPT = "_corrupt"


def parse_lines(lines: DataFrame) -> DataFrame:
    """Non-blank lines with their parsed record and, where parsing failed, the line itself."""
    schema = T.StructType([*REQUEST_LOG.fields, T.StructField(CORRUPT, T.StringType(), True)])
    parsed = F.from_json(
        "value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    )
    filled = lines.where(F.col("value").rlike(r"\S"))
    return filled.select(parsed.alias("r")).select("r.*")


def split_lines(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, rejected lines)."""
    bad = F.col(CORRUPT).isNotNull()
    return parsed.where(~bad).drop(CORRUPT), parsed.where(bad).select(F.col(CORRUPT).alias("line"))


def read_requests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejected lines) of the log files under `path`."""
    return split_lines(parse_lines(spark.read.text(path)))
