"""JSON documents and queue messages: tolerant reads with dead letters, and date-partitioned writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest message, in bytes.
CEILING = 65_536


def json_documents(spark: SparkSession, path: str, schema: T.StructType, modified_after: str | None = None) -> DataFrame:
    """One row a well-formed document, with ``key`` (its path) and ``modified_at``; broken and non-object ones go."""
    reader = spark.read.schema(T.StructType([*schema.fields, T.StructField("_broken", T.StringType())])).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    if modified_after is not None:
        reader = reader.option("modifiedAfter", modified_after)
    rows = reader.json(path).select("*", F.col("_metadata.file_path").alias("key"), F.col("_metadata.file_modification_time").alias("modified_at"))
    return rows.filter(F.col("_broken").isNull()).drop("_broken")


def parsed(messages: DataFrame, body: str, schema: str, required: list[str], names: tuple[str, ...] | None = None) -> DataFrame:
    """Adds ``message`` (the struct, null if refused) and ``refused`` (null or the reason): over the ceiling, not JSON,
    an unknown ``schema`` name (where names are given), or a required field that is absent."""
    got = F.from_json(body, schema)
    known = F.get_json_object(body, "$.schema").isin(*names) if names else F.lit(True)
    reason = (
        F.when(F.col(body).isNull(), "empty")
        .when(F.octet_length(body) > CEILING, "too large")
        .when(F.get_json_object(body, "$").isNull() | ~F.ltrim(body).startswith("{"), "not an object")
        .when(~F.coalesce(known, F.lit(False)), "unknown schema")
    )
    for field in required:
        reason = reason.when(F.get_json_object(body, f"$.{field}").isNull(), F.lit(f"no {field}"))
    return messages.withColumn("refused", reason).withColumn("message", F.when(F.col("refused").isNull(), got))


def write_documents(rows: DataFrame, at: Column, path: str) -> None:
    """JSON lines under year=/month=/day= of the given time; a day that is written again is replaced."""
    dated = rows.withColumns({"year": F.year(at), "month": F.month(at), "day": F.dayofmonth(at)})
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "month", "day").json(path)
