"""Deviance over a stream of observations.

Risk sets need all rows, but only through sums per stratum and time, and those
add up.  Each micro-batch writes its own sums under its number in one write, so a batch
that is run again replaces itself; the deviance at any moment is made from all
sums so far.  `compact` adds up all batches but the last, which alone can be run again.  Predictors are centred by a given constant, not by a mean
that would move; below the clip that changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from riskloom.functions.prefix import split_in_order
from riskloom.operators import timeline as tl

COLUMNS = ["stratum", "start", "event", "status", "weight", "eta"]


class RunningDeviance:
    """Observations (columns stratum, start, event, status, weight, eta) in, deviance out.

    `path` is a folder that driver and executors share.  Rows with a null, with a status other than 0
    and 1, a negative weight or a start not before the event are counted as rejected and left out.
    """

    def __init__(self, spark: SparkSession, path: str, tie_breaking: str = "efron", centre: float = 0.0):
        if tie_breaking not in ("efron", "breslow"):
            raise ValueError("tie_breaking must be 'efron' or 'breslow'")
        self.spark, self.path, self.efron, self.centre = spark, path.rstrip("/"), tie_breaking == "efron", centre

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """Write the sums of one batch, in place of any that have its number."""
        rows = batch.select("stratum", *(F.col(c).cast("double").alias(c) for c in COLUMNS[1:]))
        good = F.col("status").isin(0.0, 1.0) & (F.col("weight") >= 0) & (F.col("start") < F.col("event")) & F.col("stratum").isNotNull() & ~F.isnan("eta") & ~F.isnan("event") & ~F.isnan("start") & ~F.isnan("weight")
        rows = rows.withColumn("good", F.coalesce(good & F.col("eta").isNotNull(), F.lit(False)))
        rows = rows.withColumn("eta_c", F.col("eta") - F.lit(float(self.centre))).withColumn("e", F.col("weight") * F.exp(F.least("eta_c", F.lit(tl.CLIP)))).withColumn("hit", (F.col("status") == 1) & (F.col("weight") > 0))
        rows = rows.persist()  # read by three sums
        try:
            self._summed(rows).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        finally:
            rows.unpersist()

    def _summed(self, rows: DataFrame) -> DataFrame:
        """Rows of three kinds: sums per stratum and time, totals per stratum, and how many rows were rejected."""
        kept = rows.where("good")
        linear = F.sum(F.when(F.col("status") == 1, F.col("weight") * F.col("eta_c")).otherwise(0.0))
        totals = kept.groupBy("stratum").agg(linear.alias("linear"), F.count("*").alias("n"), F.sum(F.when(F.col("eta_c") > tl.CLIP, 1).otherwise(0)).alias("clipped"))
        rejected = rows.agg(F.sum(F.when(F.col("good"), 0).otherwise(1)).alias("rejected"))
        out = tl.time_sums(kept, starts=True).withColumn("kind", F.lit("time"))
        for kind, df in (("total", totals), ("seen", rejected)):
            out = out.unionByName(df.withColumn("kind", F.lit(kind)), allowMissingColumns=True)
        return out

    def _written(self) -> tuple[int | None, list[int]]:
        """The newest base (a batch number: all up to it are in there) and the batches after it."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath() for f in fs.listStatus(where)] if fs.exists(where) else []
        done = [n.getName() for n in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(n, "_SUCCESS"))]
        base = max((int(n[5:]) for n in done if n.startswith("base=")), default=None)
        return base, sorted(b for b in (int(n[6:]) for n in done if n.startswith("batch=")) if base is None or b > base)

    def _read(self, kind: str, base: int | None, batches: list[int]) -> DataFrame:
        paths = [f"{self.path}/base={base}"] * (base is not None) + [f"{self.path}/batch={b}" for b in batches]
        return self.spark.read.parquet(*paths).where(F.col("kind") == kind)

    def compact(self) -> None:
        """Add up all batches but the last in one table, then delete what went into it."""
        base, batches = self._written()
        if len(batches) < 2:
            return
        parts = base, batches[:-1]
        add = lambda df, keys: df.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in df.columns if c not in keys))
        times = self._read("time", *parts)
        out = add(times.select(*tl.KEY, *(c for c in times.columns if c not in (*tl.KEY, "kind", "linear", "n", "clipped", "rejected"))), tl.KEY).withColumn("kind", F.lit("time"))
        out = out.unionByName(add(self._read("total", *parts).select("stratum", "linear", "n", "clipped"), ["stratum"]).withColumn("kind", F.lit("total")), allowMissingColumns=True)
        out = out.unionByName(self._read("seen", *parts).agg(F.sum("rejected").alias("rejected")).withColumn("kind", F.lit("seen")), allowMissingColumns=True)
        out.select(*times.columns).write.mode("overwrite").parquet(f"{self.path}/base={batches[-2]}")
        fs = self.spark._jvm.org.apache.hadoop.fs
        for old in [f"base={base}"] * (base is not None) + [f"batch={b}" for b in batches[:-1]]:
            where = fs.Path(f"{self.path}/{old}")
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()

    def rejected(self) -> int:
        return self._read("seen", *self._written()).agg(F.coalesce(F.sum("rejected"), F.lit(0))).first()[0]

    def scalars(self, by_stratum: bool = False) -> DataFrame:
        """deviance, loglik_sat, loglik, n, clipped_rows and bad_times over all batches so far."""
        written = self._written()
        sums = self._read("time", *written).drop("kind", "linear", "n", "clipped", "rejected")
        merged = sums.groupBy(*tl.KEY).agg(*(F.sum(c).alias(c) for c in sums.columns if c not in tl.KEY))
        line = split_in_order(merged, ["stratum"], ["t"], "running")
        terms = tl.moments(tl.at_risk(line), self.efron, tl.largest_tie(line))
        fails = terms.where("k > 0").groupBy(F.col("stratum").alias("_s")).agg(F.sum("penalty").alias("penalty"), F.sum("saturated").alias("saturated"), F.sum(F.when(F.col("r") > 0, 0).otherwise(1)).alias("bad"))
        totals = self._read("total", *written).groupBy("stratum").agg(F.sum("linear").alias("linear"), F.sum("n").alias("n"), F.sum("clipped").alias("clipped"))
        both = totals.join(fails, F.col("stratum") == F.col("_s"), "left")
        total = lambda c: F.sum(F.coalesce(c, F.lit(0)))
        out = both.groupBy(*(["stratum"] if by_stratum else [])).agg((total("linear") - total("penalty")).alias("loglik"), (-total("saturated") + 0.0).alias("loglik_sat"), total("n").alias("n"), total("clipped").alias("clipped_rows"), total("bad").alias("bad_times"))
        return out.withColumn("deviance", 2 * (F.col("loglik_sat") - F.col("loglik")))
