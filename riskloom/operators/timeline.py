"""Cox partial likelihood as sums over a timeline.

The timeline has a row for each stratum and distinct time, start or event
time alike.  So all look-ups of risk sets are equal joins, and all sums over
risk sets are running sums.  Notation, for a failure time with K positively
weighted failures of weight W and risk-score sum D in it: R is the sum of the
risk scores of those at risk (start < t <= event), s = m / K for Efron's rule
and 0 for Breslow's, m = 0 .. K-1, and R_m = R - s D.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.functions.prefix import PART, running_sums, split_in_order
from riskloom.plans.storage import materialise

CLIP = 30.0
KEY = ["stratum", "t"]
NOT_POSITIVE = " failure times have no positive risk sum"
# A tie of up to INLINE members is summed up in its row; the members of a larger one are listed in runs of RUN that go to many tasks.
INLINE, RUN = 1024, 8192
MOMENTS = ["a1", "a2", "b1", "b2", "c2", "b2x", "penalty", "saturated"]


def scored(obs: DataFrame, means: DataFrame) -> DataFrame:
    """Add eta_c (eta less its stratum's plain mean), e (weight * exp(eta_c), the exponent at most CLIP) and hit (a failure that counts).

    `means` has the columns stratum and mean.
    """
    means = means.select(F.col("stratum").alias("_s"), F.col("mean").alias("_mean"))
    out = obs.join(means, F.col("stratum") == F.col("_s")).withColumn("eta_c", F.col("eta") - F.col("_mean")).drop("_mean", "_s")
    return out.withColumn("e", F.col("weight") * F.exp(F.least("eta_c", F.lit(CLIP)))).withColumn("hit", (F.col("status") == 1) & (F.col("weight") > 0))


def time_sums(rows: DataFrame, starts: bool, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """Sums per stratum and time; sums of parts of the rows add up to those of the whole.

    d, w, k: risk scores, weights and number of the failures at t; ev and st: risk scores
    of those whose event, or start, it is.  For each name of `extra`, a factor x:
    ev_name, st_name and d_name are the same sums of e * x.
    """
    factors = {"": F.lit(1.0)} | {f"_{k}": v for k, v in (extra or {}).items()}
    zero = F.lit(0.0)
    hit = F.col("hit")

    def point(at: str, event: bool) -> Column:
        e = {f: F.col("e") * x for f, x in factors.items()}
        cols = [F.col(at).alias("t"), F.when(hit, F.col("weight")).otherwise(zero).alias("w") if event else zero.alias("w"), F.when(hit, 1).otherwise(0).alias("k") if event else F.lit(0).alias("k")]
        for f in factors:
            cols += [(e[f] if event else zero).alias(f"ev{f}"), (zero if event else e[f]).alias(f"st{f}"), (F.when(hit, e[f]).otherwise(zero) if event else zero).alias(f"d{f}")]
        return F.struct(*cols)

    points = F.array(point("event", True), *([point("start", False)] if starts else []))
    flat = rows.select("stratum", F.explode(points).alias("p")).select("stratum", "p.*").where(F.col("t") > F.lit(float("-inf")))
    sums = [c for c in flat.columns if c not in KEY]
    return flat.groupBy(*KEY).agg(*(F.sum(c).alias(c) for c in sums))


def timeline(rows: DataFrame, starts: bool, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """`time_sums` in numbered ranges of time."""
    return split_in_order(time_sums(rows, starts, extra), ["stratum"], ["t"], "timeline")


def at_risk(line: DataFrame, names: Sequence[str] = ()) -> DataFrame:
    """Add r, and r_name for each name: the sums over the risk set at t.  Event and start sums are kept apart until the last step."""
    all_names = ["", *(f"_{n}" for n in names)]
    sums = {f"s{kind}{n}": F.col(f"{kind}{n}") for n in all_names for kind in ("ev", "st")}
    out = running_sums(line, ["stratum"], [F.col("t")], sums, reverse=True)
    return out.select(*line.columns, *((F.col(f"sev{n}") - F.col(f"sst{n}")).alias(f"r{n}") for n in all_names))


def largest_tie(line: DataFrame) -> int:
    """The most failures at one time of a written timeline."""
    return line.agg(F.coalesce(F.max("k"), F.lit(0))).first()[0]


def _of_member(s: Column, w: Column, r: Column, d: Column, k: Column) -> list[Column]:
    """What one member of a tie adds to each of MOMENTS (null for a sum of 0, which counts as a bad time)."""
    mean, rm = w / k, r - s * d
    one, two = F.try_divide(mean, rm), F.try_divide(mean, rm * rm)
    return [one, two, one * s, two * s, two * s * s, one * s * s, mean * F.log(rm), mean * F.log(1 - s)]


def _of_tie(w: Column, r: Column, d: Column, k: Column) -> Column:
    """The sums over a tie's members, as a struct, without a row per member."""
    one, zero = F.lit(1.0), F.lit(0.0)
    single = F.struct(*(x.alias(n) for n, x in zip(MOMENTS, _of_member(zero, w, r, d, one))))
    start = F.struct(*(zero.alias(n) for n in MOMENTS))

    def step(acc: Column, m: Column) -> Column:
        return F.struct(*((acc[n] + x).alias(n) for n, x in zip(MOMENTS, _of_member(m.cast("double") / k, w, r, d, k))))

    some = F.aggregate(F.sequence(F.lit(0).cast("long"), F.greatest(k.cast("long"), F.lit(1).cast("long")) - 1), start, step)
    return F.when(k == 1, single).when(k > 1, some).otherwise(start)


def moments(risk: DataFrame, efron: bool, largest: int) -> DataFrame:
    """Add, per failure time, sums over m with w' = W / K:

    a1, a2: w' / R_m, w' / R_m^2; b1, b2: the same with s; c2: w' s^2 / R_m^2; b2x: w' s^2 / R_m;
    penalty: w' ln R_m; saturated: W ln W + w' ln(1 - s).  All are 0 at other times.
    `largest` is the most failures at one time (see `largest_tie`).
    """
    w, r, d, k, zero = F.col("w"), F.col("r"), F.col("d"), F.col("k"), F.lit(0.0)
    if not efron:
        values = [F.try_divide(w, r), F.try_divide(w, r * r), zero, zero, zero, zero, w * F.log(r), w * F.log(w)]
        return risk.select("*", *(F.when(k > 0, v).otherwise(zero).alias(n) for n, v in zip(MOMENTS, values)))
    in_row = F.when(k <= INLINE, k).otherwise(0)
    out = risk.withColumn("_m", _of_tie(w, r, d, in_row))
    sums = {n: F.col("_m")[n] for n in MOMENTS}
    if largest > INLINE:
        top = k.cast("long") - 1
        runs = risk.where(k > INLINE).select(*KEY, "w", "r", "d", "k", F.explode(F.sequence(F.lit(0).cast("long"), top, F.lit(RUN).cast("long"))).alias("first"))
        parts = int(risk.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        members = runs.repartition(parts, *KEY, "first").withColumn("m", F.explode(F.sequence("first", F.least(F.col("first") + (RUN - 1), top))))
        added = _of_member(F.col("m").cast("double") / k, w, r, d, k)
        large = members.groupBy(F.col("stratum").alias("_ls"), F.col("t").alias("_lt")).agg(*(F.sum(x).alias(f"_l_{n}") for n, x in zip(MOMENTS, added)))
        out = out.join(large, (F.col("stratum") == F.col("_ls")) & (F.col("t") == F.col("_lt")), "left")
        sums = {n: F.coalesce(f"_l_{n}", x) for n, x in sums.items()}
    sums["saturated"] = F.when(k > 0, w * F.log(w) + sums["saturated"]).otherwise(zero)
    return out.select(*risk.columns, *(x.alias(n) for n, x in sums.items()))


def scalars(rows: DataFrame, terms: DataFrame, by_stratum: bool = False) -> DataFrame:
    """deviance, loglik_sat, loglik, clipped_rows (rows whose eta_c is over CLIP) and bad_times (failure times with no positive risk sum)."""
    keys = ["stratum"] if by_stratum else []
    linear = rows.groupBy("stratum").agg(F.sum(F.when(F.col("status") == 1, F.col("weight") * F.col("eta_c")).otherwise(0.0)).alias("linear"), F.sum(F.when(F.col("eta_c") > CLIP, 1).otherwise(0)).alias("clipped"))
    fails = terms.where("k > 0").groupBy("stratum").agg(F.sum("penalty").alias("penalty"), F.sum("saturated").alias("saturated"), F.sum(F.when(F.col("r") > 0, 0).otherwise(1)).alias("bad"))
    both = linear.join(fails.withColumnRenamed("stratum", "_s"), F.col("stratum") == F.col("_s"), "left")
    total = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    out = both.groupBy(*keys).agg(total("linear").alias("_l"), total("penalty").alias("_p"), total("saturated").alias("_s"), total("clipped").alias("clipped_rows"), total("bad").alias("bad_times"))
    zero = F.lit(0.0)
    loglik, sat = F.coalesce(F.col("_l") - F.col("_p"), zero), F.coalesce(-F.col("_s"), zero) + 0.0
    return out.select(*keys, (2 * (sat - loglik)).alias("deviance"), sat.alias("loglik_sat"), loglik.alias("loglik"), F.coalesce("clipped_rows", F.lit(0)).alias("clipped_rows"), F.coalesce("bad_times", F.lit(0)).alias("bad_times"))


def per_row(rows: DataFrame, terms: DataFrame, starts: bool, vectors: Sequence[str] = (), reference_diag: bool = False, efron: bool = True) -> DataFrame:
    """Add gradient and diag_hessian (of the deviance) and, for each name of `vectors`, iv_name: the information times the vector.

    The information is the Hessian of minus the log-likelihood, so diag_hessian is
    twice its diagonal.  `reference_diag` uses the widely deployed formula for
    Efron's rule that has s^2 / R for s / R^2 in the cross term, and with start times counts the row's own time alone.
    """
    g = {n: F.col(f"r_{n}") * F.col("a2") - F.col(f"d_{n}") * F.col("b2") for n in vectors}
    gs = {n: F.col(f"r_{n}") * F.col("b2") - F.col(f"d_{n}") * F.col("c2") for n in vectors}
    cum = running_sums(terms, ["stratum"], [F.col("t")], {"s1": F.col("a1"), "s2": F.col("a2")} | {f"g_{n}": x for n, x in g.items()})
    keep = ["s1", "s2", *(f"g_{n}" for n in vectors)]
    cum = materialise(cum.select(*KEY, *keep, "a2", "b1", "b2", "c2", "b2x", *(gs[n].alias(f"gs_{n}") for n in vectors)), "cumulated")
    at_event = cum.select(F.col("stratum").alias("_es"), F.col("t").alias("_et"), *(F.col(c).alias(f"_e_{c}") for c in cum.columns if c not in KEY))
    out = rows.join(at_event, (F.col("stratum") == F.col("_es")) & (F.col("event") == F.col("_et")))
    if starts:
        at_start = cum.select(F.col("stratum").alias("_ss"), F.col("t").alias("_st"), *(F.col(c).alias(f"_s_{c}") for c in keep))
        out = out.join(at_start, (F.col("stratum") == F.col("_ss")) & (F.col("start") == F.col("_st")), "left")
    since = lambda c: F.col(f"_e_{c}") - (F.coalesce(f"_s_{c}", F.lit(0.0)) if starts else 0.0)
    own = lambda x: F.when(F.col("hit"), x).otherwise(0.0)
    e, d = F.col("e"), F.col("status").cast("double")
    t1 = since("s1") - own(F.col("_e_b1"))
    if reference_diag and efron:
        t2 = own(F.col("_e_c2") - 2 * F.col("_e_b2x")) + (own(F.col("_e_a2")) if starts else F.col("_e_s2"))
    else:
        t2 = since("s2") + own(F.col("_e_c2") - 2 * F.col("_e_b2"))
    outs = [(-2 * (F.col("weight") * d - e * t1)).alias("gradient"), (2 * (e * t1 - e * e * t2)).alias("diag_hessian")]
    for n in vectors:
        outs.append((e * t1 * F.col(n) - e * (since(f"g_{n}") - own(F.col(f"_e_gs_{n}")))).alias(f"iv_{n}"))
    return out.select(*(F.col(c) for c in rows.columns), *outs)


def quadratic_form(terms: DataFrame, names: Sequence[str]) -> DataFrame:
    """i, j, value of X' I X, from the sums over risk sets of x_i and of x_i x_j (names p_i_j), i <= j."""
    r, d = (lambda n: F.col(f"r_{n}")), (lambda n: F.col(f"d_{n}"))
    values = {}
    for i, a in enumerate(names):
        for j in range(i, len(names)):
            b, pair = names[j], f"p_{i}_{j}"
            outer = r(a) * r(b) * F.col("a2") - (r(a) * d(b) + d(a) * r(b)) * F.col("b2") + d(a) * d(b) * F.col("c2")
            values[i, j] = r(pair) * F.col("a1") - d(pair) * F.col("b1") - outer
    return _cells(terms.where("k > 0"), values, F.sum(F.when(F.col("r") > 0, 0).otherwise(1)))


def quadratic_form_by_rows(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """The same from each row's features and the information times them (iv_name)."""
    return _cells(rows, {(i, j): F.col(a) * F.col(f"iv_{names[j]}") for i, a in enumerate(names) for j in range(i, len(names))})


def _cells(df: DataFrame, values: Mapping[tuple[int, int], Column], bad: Column | None = None) -> DataFrame:
    """A row per cell with the sum of its values; an error where `bad` isn't 0."""
    cells = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.coalesce(F.sum(v), F.lit(0.0)).alias("value")) for (i, j), v in values.items()))
    total = df.agg(cells.alias("cells"), F.coalesce(F.lit(0) if bad is None else bad, F.lit(0)).alias("bad"))
    wrong = F.raise_error(F.concat("bad", F.lit(NOT_POSITIVE))).cast(total.schema["cells"].dataType)
    return total.select(F.explode(F.when(F.col("bad") > 0, wrong).otherwise(F.col("cells"))).alias("c")).select("c.*")


__all__ = ["KEY", "NOT_POSITIVE", "PART", "at_risk", "largest_tie", "moments", "per_row", "quadratic_form", "quadratic_form_by_rows", "scalars", "scored", "time_sums", "timeline"]
