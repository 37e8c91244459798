"""Positions, tie clusters and rank look-ups of observations.

The joint order of the 2n start and event points is by time; within a time failures
come first, then by falling weight, events before starts.  Equal points
are ordered by row_id.  A cluster is the positively weighted failures of one
time; any other row is a cluster of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.functions.prefix import PART, running_sums, split_in_order
from riskloom.plans.storage import materialise

ORDER = ["t", "not_failure", "minus_weight", "is_start", "row_id"]


def joint_order(obs: DataFrame) -> DataFrame:
    """A row for each point, in numbered ranges of the joint order."""
    point = lambda at, is_start, late: F.struct(F.col(at).alias("t"), late.alias("not_failure"), (-F.col("weight")).alias("minus_weight"), F.lit(is_start).alias("is_start"), F.col("row_id"))
    points = F.array(point("event", 0, 1 - F.col("status")), point("start", 1, F.lit(1)))
    flat = obs.select("stratum", "status", "weight", F.explode(points).alias("p")).select("stratum", "status", "weight", "p.*")
    return split_in_order(flat, ["stratum"], ORDER, "joint")


def lexsort(obs: DataFrame) -> DataFrame:
    """stratum, position, row_id, is_start: the joint order as positions from 0 in each stratum."""
    counted = running_sums(joint_order(obs), ["stratum"], [F.col(c) for c in ORDER], {"n": F.lit(1).cast("long")})
    return counted.select("stratum", (F.col("n") - 1).alias("position"), "row_id", "is_start")


def risk_index(obs: DataFrame) -> DataFrame:
    """Per row (ids are unique): event_order and start_order positions, first, last, scaling, event_map and start_map, all from 0.

    event_map is the number of start points before the row's event point in the
    joint order, start_map the number of event points before its start point;
    scaling is the row's place in its cluster over the cluster's size.
    """
    joint = joint_order(obs)
    is_event, cols = F.col("is_start") == 0, [F.col(c) for c in ORDER]
    counted = running_sums(joint, ["stratum"], cols, {"events": F.when(is_event, 1).otherwise(0), "starts": F.when(is_event, 0).otherwise(1)})
    events = counted.where(is_event).select("stratum", "row_id", "t", "status", "weight", (F.col("events") - 1).alias("event_order"), F.col("starts").alias("event_map"))
    starts = counted.where(~is_event).select(F.col("row_id").alias("_r"), (F.col("starts") - 1).alias("start_order"), F.col("events").alias("start_map"))
    hit = (F.col("status") == 1) & (F.col("weight") > 0)
    ties = events.where(hit).groupBy(F.col("stratum").alias("_s"), F.col("t").alias("_t")).agg(F.min("event_order").alias("_first"), F.max("event_order").alias("_last"))
    out = events.join(ties, (F.col("stratum") == F.col("_s")) & (F.col("t") == F.col("_t")) & hit, "left").join(starts, F.col("row_id") == F.col("_r"))
    first, last = F.coalesce("_first", "event_order"), F.coalesce("_last", "event_order")
    scaling = (F.col("event_order") - first).cast("double") / (last - first + 1)
    return out.select("stratum", "row_id", "event_order", "start_order", first.alias("first"), last.alias("last"), scaling.alias("scaling"), "event_map", "start_map")


def preprocess(obs: DataFrame) -> DataFrame:
    """A row per position in event order: the observation, its index, and first_start = first at position start_map.

    first_start is null where a start is after every event, which validation rules out; else it equals start_map.
    """
    index = materialise(risk_index(obs), "index")
    at = index.select(F.col("stratum").alias("_s"), F.col("event_order").alias("_p"), F.col("first").alias("first_start"))
    found = index.join(at, (F.col("stratum") == F.col("_s")) & (F.col("start_map") == F.col("_p")), "left").drop("_s", "_p", "stratum").withColumnRenamed("row_id", "_r")
    return obs.select("row_id", "stratum", "start", "event", "status").join(found, F.col("row_id") == F.col("_r")).drop("_r")


def forward_prework(i: int, j: int, status: Column, scaling: Column, risk: Column, mean_weight: Column | None = None, arg: Column | None = None) -> Column:
    """status * mean_weight * scaling^i / risk^j * arg; 0 where mean_weight, or without one status, isn't positive."""
    base = status * F.pow(scaling, F.lit(float(i))) / F.pow(risk, F.lit(float(j)))
    base = base if mean_weight is None else base * mean_weight
    base = base if arg is None else base * arg
    return F.when((status if mean_weight is None else mean_weight) > 0, base).otherwise(0.0)


def in_event_order(obs: DataFrame, index: DataFrame, *columns: str) -> DataFrame:
    """Columns of the rows, by position in event order."""
    ours = index.select(F.col("row_id").alias("_r"), "event_order")
    return obs.join(ours, F.col("row_id") == F.col("_r")).select("stratum", F.col("event_order").alias("position"), *columns)


def in_native_order(values: DataFrame, index: DataFrame, *columns: str) -> DataFrame:
    """Columns by position in event order, back to row_id."""
    ours = index.select(F.col("stratum").alias("_s"), "row_id", "event_order")
    return values.join(ours, (F.col("stratum") == F.col("_s")) & (F.col("position") == F.col("event_order"))).select("stratum", "row_id", *columns)


def forward_cumsum(df: DataFrame, value: Column, order: str = "position") -> DataFrame:
    """position, value: n + 1 rows a stratum, 0 before the first, then running sums."""
    ranged = split_in_order(df.select("stratum", F.col(order).alias("position"), value.cast("double").alias("_v")), ["stratum"], ["position"])
    sums = running_sums(ranged, ["stratum"], [F.col("position")], {"value": F.col("_v")}).select("stratum", (F.col("position") + 1).alias("position"), "value")
    zero = df.select("stratum").distinct().select("stratum", F.lit(0).cast("long").alias("position"), F.lit(0.0).alias("value"))
    return zero.unionByName(sums.withColumn("position", F.col("position").cast("long")))


def reverse_cumsums(obs: DataFrame, index: DataFrame, value: Column) -> DataFrame:
    """position, by_event, by_start: sums from each position to the end, in event and in start order; n + 1 rows a stratum."""

    def one(order: str, name: str) -> DataFrame:
        ours = index.select(F.col("row_id").alias("_r"), F.col(order).cast("long").alias("position"))
        rows = obs.join(ours, F.col("row_id") == F.col("_r")).select("stratum", "position", value.cast("double").alias("_v"))
        ranged = split_in_order(rows, ["stratum"], ["position"])
        sums = running_sums(ranged, ["stratum"], [F.col("position")], {name: F.col("_v")}, reverse=True).select("stratum", "position", name)
        end = rows.groupBy("stratum").agg((F.max("position") + 1).alias("position")).withColumn(name, F.lit(0.0))
        return sums.unionByName(end)

    return one("event_order", "by_event").join(one("start_order", "by_start"), ["stratum", "position"])


def _in_risk_time(obs: DataFrame) -> DataFrame:
    return obs.withColumn("hit", (F.col("status") == 1) & (F.col("weight") > 0))


def sum_over_risk_set(obs: DataFrame, index: DataFrame, value: Column, efron: bool = True) -> DataFrame:
    """stratum, row_id, value at each row: the sum of `value` over its risk set, less scaling times the sum over its cluster.

    At a counted failure that is all rows at risk at its time.  At any other row it is those from its own
    position in the event order on, less those whose start point comes after its event point in the joint order.
    """
    sums = materialise(reverse_cumsums(obs, index, value), "reverse")
    at = lambda n, *cols: sums.select(F.col("stratum").alias(f"_s{n}"), F.col("position").alias(f"_p{n}"), *(F.col(c).alias(f"_{c}{n}") for c in cols))
    on = lambda n, p: (F.col("stratum") == F.col(f"_s{n}")) & (p == F.col(f"_p{n}"))
    out = index.join(at(1, "by_event"), on(1, F.col("first"))).join(at(2, "by_start"), on(2, F.col("event_map")))
    total = F.col("_by_event1") - F.col("_by_start2")
    if efron:
        out = out.join(at(3, "by_event"), on(3, F.col("last") + 1))
        total = total - F.col("scaling") * (F.col("_by_event1") - F.col("_by_event3"))
    return out.select("stratum", "row_id", total.alias("value"))


def sum_over_events(obs: DataFrame, index: DataFrame, value: Column, efron: bool = True) -> DataFrame:
    """stratum, row_id, value at each row: the sum of `value` over the failures in the row's time at risk, less the scaled sum over its cluster."""
    ours = index.select(F.col("row_id").alias("_i"), "scaling")
    rows = _in_risk_time(obs).join(ours, F.col("row_id") == F.col("_i")).withColumn("_v", F.when(F.col("hit"), value.cast("double")).otherwise(0.0))
    at = lambda t, x: F.struct(F.col(t).alias("t"), F.col("_v").alias("f") if x else F.lit(0.0).alias("f"), (F.col("_v") * F.col("scaling") if x else F.lit(0.0)).alias("fs"))
    flat = rows.select("stratum", F.explode(F.array(at("event", True), at("start", False))).alias("p")).select("stratum", "p.*").where(F.col("t") > F.lit(float("-inf")))
    line = split_in_order(flat.groupBy("stratum", "t").agg(F.sum("f").alias("f"), F.sum("fs").alias("fs")), ["stratum"], ["t"])
    cum = materialise(running_sums(line, ["stratum"], [F.col("t")], {"c": F.col("f")}).select("stratum", "t", "c", "fs"), "events")
    first = cum.select(F.col("stratum").alias("_s"), F.col("t").alias("_t"), F.col("c").alias("_c"), "fs")
    second = cum.select(F.col("stratum").alias("_s2"), F.col("t").alias("_t2"), F.col("c").alias("_c2"))
    out = rows.join(first, (F.col("stratum") == F.col("_s")) & (F.col("event") == F.col("_t"))).join(second, (F.col("stratum") == F.col("_s2")) & (F.col("start") == F.col("_t2")), "left")
    own = F.when(F.col("hit"), F.col("fs")).otherwise(0.0) if efron else F.lit(0.0)
    return out.select("stratum", "row_id", (F.col("_c") - F.coalesce("_c2", F.lit(0.0)) - own).alias("value"))


__all__ = ["PART", "forward_cumsum", "forward_prework", "in_event_order", "in_native_order", "joint_order", "lexsort", "preprocess", "reverse_cumsums", "risk_index", "sum_over_events", "sum_over_risk_set"]
