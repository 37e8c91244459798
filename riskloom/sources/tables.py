"""Observations from the standard tables.

`events` as a counting process: an observation is the time since the same
user's previous event; in hours there are ties, in microseconds there are none.
`lineitem` as lifetimes: 50 distinct times, many ties, no row key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

MICROS_PER_HOUR = 3_600_000_000
WEIGHTS = {
    "ones": "CAST(1 AS DOUBLE)",
    "positive": "CAST(0.5 AS DOUBLE) + CAST(event_id % 5 AS DOUBLE) / 4",
    "zeros": "CASE WHEN event_type = 'error' THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END",
}
VECTORS = ["CAST(event_id % 7 AS DOUBLE)", "value / 50"]
FEATURES = ["value / 100", "CAST(event_id % 10 AS DOUBLE) / 10", "CAST(user_id % 2 AS DOUBLE)"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_intervals(spark: SparkSession, sf_dir: str, hours: bool = True) -> DataFrame:
    """event_id, user_id, event_type, value, stop, entry (-Infinity for a user's first event)."""
    e = _table(spark, sf_dir, "events").withColumn("us", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))"))
    e = e.withColumn("stop", F.expr(f"CAST(us DIV {MICROS_PER_HOUR} AS DOUBLE)") if hours else F.col("us").cast("double"))
    before = F.lag("stop").over(Window.partitionBy("user_id").orderBy("us", "event_id"))
    e = e.withColumn("before", before)
    entry = F.when(F.col("before").isNull(), F.lit(float("-inf"))).when(F.col("before") < F.col("stop"), F.col("before")).otherwise(F.col("stop") - 1)
    return e.select("event_id", "user_id", "event_type", "value", "stop", entry.alias("entry"), (F.col("event_type") == "purchase").cast("int").alias("bought"), (F.col("user_id") % 3).cast("int").alias("site"))


def lifetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_quantity, returned, l_discount, l_tax, l_linestatus."""
    return _table(spark, sf_dir, "lineitem").select("l_quantity", (F.col("l_returnflag") == "R").cast("int").alias("returned"), "l_discount", "l_tax", "l_linestatus")
