"""The registered survival queries and their SQL.

The SQL is definitional: risk sets are found by the join start < t <= event, not by running sums.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskloom.api import CoxLikelihood
from riskloom.operators import order
from riskloom.sources.tables import FEATURES, MICROS_PER_HOUR, VECTORS, WEIGHTS, event_intervals, lifetimes

Query = Callable[[SparkSession, str], DataFrame]
ETA = "value / 100"
TIES, STARTS, STRATA = ("breslow", "efron"), (False, True), (False, True)


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floating columns rounded, without a negative zero."""
    return df.select(*((F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _r(x: str, name: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0 AS {name}"


def _cox(spark: SparkSession, sf_dir: str, ties: str, start: bool, strata: bool, hours: bool = True, **options) -> CoxLikelihood:
    rows = event_intervals(spark, sf_dir, hours)
    return CoxLikelihood(rows, "stop", "bought", strata="site" if strata else None, start="entry" if start else None, tie_breaking=ties, row_id="event_id", **options)


def _lifetimes(spark: SparkSession, sf_dir: str, ties: str, strata: bool = True) -> CoxLikelihood:
    rows = lifetimes(spark, sf_dir)
    return CoxLikelihood(rows, "l_quantity", "returned", strata="l_linestatus" if strata else None, tie_breaking=ties, row_id=F.xxhash64(*rows.columns))


# ---- SQL


def events_sql(start: bool, strata: bool, weight: str, hours: bool = True, eta: str = ETA) -> str:
    stop = f"CAST(epoch_us(ts) // {MICROS_PER_HOUR} AS DOUBLE)" if hours else "CAST(epoch_us(ts) AS DOUBLE)"
    entry = "CASE WHEN before IS NULL THEN '-Infinity'::DOUBLE WHEN before < event THEN before ELSE event - 1 END" if start else "'-Infinity'::DOUBLE"
    return f"""
s AS (SELECT *, {stop} AS event, epoch_us(ts) AS us FROM events),
l AS (SELECT *, lag(event) OVER (PARTITION BY user_id ORDER BY us, event_id) AS before FROM s),
obs AS (SELECT event_id AS row_id, {"CAST(user_id % 3 AS INTEGER)" if strata else "0"} AS stratum, {entry} AS start, event,
  CAST(event_type = 'purchase' AS INTEGER) AS status, {WEIGHTS[weight]} AS weight, {eta} AS eta,
  {VECTORS[0]} AS v0, {VECTORS[1]} AS v1, {", ".join(f"{x} AS x{i}" for i, x in enumerate(FEATURES))} FROM l)"""


def lifetimes_sql(strata: bool = True, weight: str = "10 * l_discount") -> str:
    return f"""
obs AS (SELECT {"l_linestatus" if strata else "0"} AS stratum, '-Infinity'::DOUBLE AS start, CAST(l_quantity AS DOUBLE) AS event,
  CAST(l_returnflag = 'R' AS INTEGER) AS status, {weight} AS weight, 5 * l_tax AS eta, l_discount, l_tax, 0.0::DOUBLE AS v0, 0.0::DOUBLE AS v1 FROM lineitem)"""


def terms_sql(obs: str, efron: bool, products: dict[str, str] | None = None) -> str:
    """Per failure time: r, d, w, k, the moments, and r_name, d_name for each product."""
    more = products if products is not None else {"v0": "v0", "v1": "v1"}
    f_more = "".join(f", sum(e * {x}) AS d_{n}" for n, x in more.items())
    r_more = "".join(f", any_value(d_{n}) AS d_{n}, sum(o.e * {x}) AS r_{n}" for n, x in more.items())
    keep = "".join(f", any_value(r_{n}) AS r_{n}, any_value(d_{n}) AS d_{n}" for n in more)
    return f"""WITH {obs.strip()},
m AS (SELECT stratum, avg(eta) AS mean FROM obs GROUP BY stratum),
o AS (SELECT obs.*, eta - mean AS eta_c, weight * exp(least(eta - mean, 30.0::DOUBLE)) AS e, status = 1 AND weight > 0 AS hit FROM obs JOIN m USING (stratum)),
f AS (SELECT stratum, event AS t, count(*) AS k, sum(weight) AS w, sum(e) AS d{f_more} FROM o WHERE hit GROUP BY stratum, event),
r AS (SELECT f.stratum, f.t, any_value(k) AS k, any_value(w) AS w, any_value(d) AS d, sum(o.e) AS r{r_more}
  FROM f JOIN o ON o.stratum = f.stratum AND o.start < f.t AND f.t <= o.event GROUP BY f.stratum, f.t),
q AS (SELECT *, {"CAST(n AS DOUBLE) / k" if efron else "0.0::DOUBLE"} AS s, w / k AS u FROM (SELECT *, unnest(range(k)) AS n FROM r)),
z AS (SELECT *, r - s * d AS rm FROM q),
terms AS (SELECT stratum, t, any_value(r) AS r, any_value(d) AS d, any_value(w) AS w, any_value(k) AS k{keep},
  sum(u / rm) AS a1, sum(u / rm ** 2) AS a2, sum(u * s / rm) AS b1, sum(u * s / rm ** 2) AS b2, sum(u * s ** 2 / rm ** 2) AS c2, sum(u * s ** 2 / rm) AS b2x,
  sum(u * ln(rm)) AS penalty, any_value(w * ln(w)) + sum(u * ln(1 - s)) AS saturated FROM z GROUP BY stratum, t)"""


def scalars_sql(obs: str, efron: bool) -> str:
    return terms_sql(obs, efron) + f""",
p AS (SELECT -(SELECT sum(saturated) FROM terms) AS sat, (SELECT sum(weight * eta_c) FROM o WHERE status = 1) - (SELECT sum(penalty) FROM terms) AS ll)
SELECT {_r("2 * (sat - ll)", "deviance")}, {_r("sat", "loglik_sat")}, {_r("ll", "loglik")},
  CAST((SELECT count(*) FROM o WHERE eta_c > 30) AS BIGINT) AS clipped_rows, CAST(0 AS BIGINT) AS bad_times FROM p"""


def by_stratum_sql(obs: str, efron: bool) -> str:
    return terms_sql(obs, efron) + f""",
a AS (SELECT stratum, sum(CASE WHEN status = 1 THEN weight * eta_c ELSE 0 END) AS lin, CAST(sum(CASE WHEN eta_c > 30 THEN 1 ELSE 0 END) AS BIGINT) AS clipped_rows FROM o GROUP BY stratum),
b AS (SELECT stratum, sum(penalty) AS pen, sum(saturated) AS sat FROM terms GROUP BY stratum)
SELECT a.stratum, {_r("2 * (-coalesce(sat, 0) - (lin - coalesce(pen, 0)))", "deviance")}, {_r("-coalesce(sat, 0)", "loglik_sat")}, {_r("lin - coalesce(pen, 0)", "loglik")}, clipped_rows, CAST(0 AS BIGINT) AS bad_times
FROM a LEFT JOIN b USING (stratum)"""


def rows_sql(obs: str, efron: bool, start: bool, reference: bool = False, key: str = "o.row_id") -> str:
    own = "(o.hit AND terms.t = o.event)"
    if reference and efron:
        t2 = f"CASE WHEN {own} THEN c2 - 2 * b2x ELSE 0 END + " + (f"CASE WHEN {own} THEN a2 ELSE 0 END" if start else "a2")
    else:
        t2 = f"a2 + CASE WHEN {own} THEN c2 - 2 * b2 ELSE 0 END"
    g = lambda v: f"r_{v} * a2 - d_{v} * b2 - CASE WHEN {own} THEN r_{v} * b2 - d_{v} * c2 ELSE 0 END"
    return terms_sql(obs, efron) + f""",
c AS (SELECT {key}, any_value(o.weight * o.status) AS wd, any_value(o.e) AS e, any_value(o.v0) AS v0, any_value(o.v1) AS v1, count(*) AS n_joined,
  coalesce(sum(a1 - CASE WHEN {own} THEN b1 ELSE 0 END), 0) AS t1, coalesce(sum({t2}), 0) AS t2, coalesce(sum({g("v0")}), 0) AS g0, coalesce(sum({g("v1")}), 0) AS g1
  FROM o LEFT JOIN terms ON terms.stratum = o.stratum AND o.start < terms.t AND terms.t <= o.event GROUP BY {key})
SELECT row_id, {_r("-2 * (wd - e * t1)", "gradient")}, {_r("2 * (e * t1 - e * e * t2)", "diag_hessian")}, {_r("e * t1 * v0 - e * g0", "iv_0")}, {_r("e * t1 * v1 - e * g1", "iv_1")} FROM c"""


def quadform_sql(obs: str, efron: bool) -> str:
    p = len(FEATURES)
    products = {f"x{i}": f"x{i}" for i in range(p)} | {f"p_{i}_{j}": f"x{i} * x{j}" for i in range(p) for j in range(i, p)}
    cells = []
    for i in range(p):
        for j in range(i, p):
            outer = f"(r_x{i} * r_x{j} * a2 - (r_x{i} * d_x{j} + d_x{i} * r_x{j}) * b2 + d_x{i} * d_x{j} * c2)"
            cells.append(f"SELECT {i} AS i, {j} AS j, {_r(f'sum(r_p_{i}_{j} * a1 - d_p_{i}_{j} * b1 - {outer})', 'value')} FROM terms")
    return terms_sql(obs, efron, products) + "\n" + "\nUNION ALL ".join(cells)


def score_sql(obs: str, efron: bool) -> str:
    own = "(o.hit AND terms.t = o.event)"
    cells = [f"SELECT {i} AS i, {_r(f'sum(x{i} * gradient)', 'value')} FROM g" for i in range(len(FEATURES))]
    return terms_sql(obs, efron) + f""",
t AS (SELECT o.row_id, coalesce(sum(a1 - CASE WHEN {own} THEN b1 ELSE 0 END), 0) AS t1 FROM o LEFT JOIN terms ON terms.stratum = o.stratum AND o.start < terms.t AND terms.t <= o.event GROUP BY o.row_id),
g AS (SELECT o.*, -2 * (weight * status - e * t1) AS gradient FROM o JOIN t USING (row_id))
""" + "\nUNION ALL ".join(cells)


INDEX_SQL = """
pts AS (SELECT stratum, row_id, event AS t, 1 - status AS late, -weight AS mw, 0 AS is_start, status, weight FROM obs
  UNION ALL SELECT stratum, row_id, start, 1, -weight, 1, status, weight FROM obs),
ord AS (SELECT *, sum(1 - is_start) OVER j AS ev, sum(is_start) OVER j AS st FROM pts WINDOW j AS (PARTITION BY stratum ORDER BY t, late, mw, is_start, row_id ROWS UNBOUNDED PRECEDING)),
e AS (SELECT *, CAST(ev - 1 AS BIGINT) AS event_order, CAST(st AS BIGINT) AS event_map, status = 1 AND weight > 0 AS hit FROM ord WHERE is_start = 0),
b AS (SELECT *, CASE WHEN hit THEN min(event_order) OVER (PARTITION BY stratum, t, hit) ELSE event_order END AS first,
  CASE WHEN hit THEN max(event_order) OVER (PARTITION BY stratum, t, hit) ELSE event_order END AS last FROM e),
idx AS (SELECT b.stratum, b.row_id, b.event_order, CAST(a.st - 1 AS BIGINT) AS start_order, b.first, b.last,
  CAST(b.event_order - b.first AS DOUBLE) / (b.last - b.first + 1) AS scaling, b.event_map, CAST(a.ev AS BIGINT) AS start_map
  FROM b JOIN (SELECT * FROM ord WHERE is_start = 1) a USING (row_id))"""


INDEX_COLUMNS = f"SELECT stratum, row_id, event_order, start_order, first, last, {_r('scaling', 'scaling')}, event_map, start_map FROM idx"


# ---- queries


def queries() -> dict[str, Query]:
    return {name: run for name, (run, _) in _registry().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _registry().items()}


def _config_name(ties: str, start: bool, strata: bool, weight: str) -> str:
    return "_".join([ties, *["start"] * start, *["strata"] * strata, weight])


def _registry() -> dict[str, tuple[Query, str]]:
    out: dict[str, tuple[Query, str]] = {}

    def flagship(ties: str) -> Query:
        return lambda spark, d: _rounded(_lifetimes(spark, d, ties)(5 * F.col("l_tax"), 10 * F.col("l_discount")).scalars())

    def part(ties: str, *names: str) -> Query:
        return lambda spark, d: flagship(ties)(spark, d).select(*names)

    for ties in TIES:
        full = scalars_sql(lifetimes_sql(), ties == "efron")
        out[f"cox_deviance_{ties}"] = part(ties, "deviance"), f"SELECT deviance FROM ({full})"
        out[f"cox_loglik_sat_{ties}"] = part(ties, "loglik_sat"), f"SELECT loglik_sat FROM ({full})"
        out[f"cox_by_stratum_{ties}"] = (
            lambda spark, d, ties=ties: _rounded(_lifetimes(spark, d, ties)(5 * F.col("l_tax"), 10 * F.col("l_discount")).scalars(by_stratum=True)),
            by_stratum_sql(lifetimes_sql(), ties == "efron"),
        )

    def config(ties: str, start: bool, strata: bool, weight: str) -> None:
        name, obs, efron = _config_name(ties, start, strata, weight), events_sql(start, strata, weight), ties == "efron"
        w = lambda: None if weight == "ones" else F.expr(WEIGHTS[weight])  # noqa: E731  columns need a session
        cox = lambda spark, d, **o: _cox(spark, d, ties, start, strata, **o)
        out[f"cox_scalars_{name}"] = (lambda spark, d: _rounded(cox(spark, d)(F.expr(ETA), w()).scalars()), scalars_sql(obs, efron))
        out[f"cox_rows_{name}"] = (lambda spark, d: _rounded(cox(spark, d).information(F.expr(ETA), w()).rows(*map(F.expr, VECTORS))), rows_sql(obs, efron, start))
        out[f"cox_info_quadform_{name}"] = (lambda spark, d: _rounded(cox(spark, d).information(F.expr(ETA), w()).quadratic_form([F.expr(x) for x in FEATURES])), quadform_sql(obs, efron))
        index = lambda spark, d: cox(spark, d).risk_index(w())
        out[f"risk_index_{name}"] = (lambda spark, d: _rounded(index(spark, d)), f"WITH {obs.strip()},{INDEX_SQL} {INDEX_COLUMNS}")
        if weight == "zeros" and efron:
            out[f"cox_diag_hessian_reference_{name}"] = (
                lambda spark, d: _rounded(cox(spark, d, compat="reference")(F.expr(ETA), w()).rows().select("row_id", "diag_hessian")),
                f"SELECT row_id, diag_hessian FROM ({rows_sql(obs, efron, start, reference=True)})",
            )
            out[f"cox_score_{name}"] = (lambda spark, d: _rounded(cox(spark, d).information(F.expr(ETA), w()).score([F.expr(x) for x in FEATURES])), score_sql(obs, efron))
            out[f"risk_sum_at_failures_{name}"] = (
                lambda spark, d: _rounded(cox(spark, d)(F.expr(ETA), w()).risk_sums()),
                terms_sql(obs, efron) + f" SELECT stratum, {_r('t', 't')}, {_r('r', 'r')}, {_r('d', 'd')}, {_r('w', 'w')}, CAST(k AS BIGINT) AS k FROM terms",
            )

    for c in itertools.product(TIES, STARTS, STRATA, WEIGHTS):
        config(*c)

    def continuous(spark: SparkSession, d: str) -> DataFrame:
        return _rounded(_cox(spark, d, "efron", True, False, hours=False)(F.expr(ETA), F.expr(WEIGHTS["zeros"])).scalars())

    out["cox_scalars_continuous_time"] = continuous, scalars_sql(events_sql(True, False, "zeros", hours=False), True)

    def clipped(spark: SparkSession, d: str) -> DataFrame:
        return _rounded(_cox(spark, d, "efron", False, True)(F.expr("value / 10"), F.expr(WEIGHTS["positive"])).scalars())

    out["cox_scalars_clipped"] = clipped, scalars_sql(events_sql(False, True, "positive", eta="value / 10"), True)

    def lifetime_rows(ties: str) -> Query:
        def run(spark: SparkSession, d: str) -> DataFrame:
            rows = lifetimes(spark, d).groupBy("l_quantity", "returned", "l_discount", "l_tax", "l_linestatus").agg(F.count("*").alias("n"))
            keys = ["l_linestatus", "l_quantity", "returned", "l_discount", "l_tax"]
            key = F.concat_ws("|", "l_linestatus", *(F.round(F.col(c) * 100).cast("long") for c in keys[1:]))
            full = lifetimes(spark, d).withColumn("key", key)
            cox = CoxLikelihood(full, "l_quantity", "returned", strata="l_linestatus", tie_breaking=ties, row_id="key")
            got = cox(5 * F.col("l_tax"), 10 * F.col("l_discount")).rows()  # rows alike have results alike
            counted = rows.select(key.alias("_key"), "n")
            return _rounded(got.groupBy("row_id").agg(F.min("gradient").alias("gradient"), F.min("diag_hessian").alias("diag_hessian")).join(counted, F.col("row_id") == F.col("_key")).select("row_id", "gradient", "diag_hessian", "n"))

        return run

    for ties in TIES:
        key = "o.stratum || '|' || CAST(round(o.event * 100) AS BIGINT) || '|' || CAST(o.status * 100 AS BIGINT) || '|' || CAST(round(o.l_discount * 100) AS BIGINT) || '|' || CAST(round(o.l_tax * 100) AS BIGINT)"
        own = "(o.hit AND terms.t = o.event)"
        sql = terms_sql(lifetimes_sql(), ties == "efron") + f""",
u AS (SELECT stratum, start, event, status, weight, e, hit, l_discount, l_tax, count(*) AS n FROM o GROUP BY ALL),
c AS (SELECT {key} AS row_id, any_value(o.n) AS n, any_value(o.weight * o.status) AS wd, any_value(o.e) AS e,
  coalesce(sum(a1 - CASE WHEN {own} THEN b1 ELSE 0 END), 0) AS t1, coalesce(sum(a2 + CASE WHEN {own} THEN c2 - 2 * b2 ELSE 0 END), 0) AS t2
  FROM u o LEFT JOIN terms ON terms.stratum = o.stratum AND terms.t <= o.event GROUP BY 1)
SELECT row_id, {_r("-2 * (wd - e * t1)", "gradient")}, {_r("2 * (e * t1 - e * e * t2)", "diag_hessian")}, CAST(n AS BIGINT) AS n FROM c"""
        out[f"cox_lifetime_rows_{ties}"] = lifetime_rows(ties), sql

    def kernel(make: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
        def run(spark: SparkSession, d: str) -> DataFrame:
            cox, w = _cox(spark, d, "efron", True, True), F.expr(WEIGHTS["zeros"])
            obs = cox.observations(F.expr(ETA), w, {"v0": F.expr(VECTORS[0]), "v1": F.expr(VECTORS[1])})
            return _rounded(make(obs, cox.risk_index(w)))

        return run

    whole = f"WITH {events_sql(True, True, 'zeros').strip()},{INDEX_SQL}"
    n = f"{whole}, oo AS (SELECT obs.*, idx.event_order, idx.start_order, idx.scaling, status = 1 AND weight > 0 AS hit FROM obs JOIN idx USING (row_id))"
    out["forward_cumsum"] = (
        kernel(lambda obs, idx: order.forward_cumsum(order.in_event_order(obs, idx, "v1"), F.col("v1"))),
        f"{n} SELECT stratum, event_order + 1 AS position, {_r('sum(v1) OVER (PARTITION BY stratum ORDER BY event_order ROWS UNBOUNDED PRECEDING)', 'value')} FROM oo UNION ALL SELECT DISTINCT stratum, 0, 0.0::DOUBLE FROM oo",
    )
    out["reverse_cumsums"] = (
        kernel(lambda obs, idx: order.reverse_cumsums(obs, idx, F.col("v1"))),
        f"""{n}, a AS (SELECT stratum, event_order AS position, sum(v1) OVER (PARTITION BY stratum ORDER BY event_order DESC ROWS UNBOUNDED PRECEDING) AS x FROM oo),
b2 AS (SELECT stratum, start_order AS position, sum(v1) OVER (PARTITION BY stratum ORDER BY start_order DESC ROWS UNBOUNDED PRECEDING) AS y FROM oo)
SELECT stratum, position, {_r('x', 'by_event')}, {_r('y', 'by_start')} FROM a JOIN b2 USING (stratum, position) UNION ALL SELECT stratum, count(*), 0.0::DOUBLE, 0.0::DOUBLE FROM oo GROUP BY stratum""",
    )
    out["native_order_round_trip"] = (
        kernel(lambda obs, idx: order.in_native_order(order.in_event_order(obs, idx, "v0", "v1"), idx, "v0", "v1")),
        f"{n} SELECT stratum, row_id, {_r('v0', 'v0')}, {_r('v1', 'v1')} FROM oo",
    )
    for ties in TIES:
        efron = ties == "efron"
        out["sum_over_risk_set" + "_breslow" * (not efron)] = (
            kernel(lambda obs, idx, efron=efron: order.sum_over_risk_set(obs, idx, F.col("v0"), efron)),
            f"""{n}, a AS (SELECT stratum, event_order AS p, sum(v0) OVER (PARTITION BY stratum ORDER BY event_order DESC ROWS UNBOUNDED PRECEDING) AS x FROM oo),
b2 AS (SELECT stratum, start_order AS p, sum(v0) OVER (PARTITION BY stratum ORDER BY start_order DESC ROWS UNBOUNDED PRECEDING) AS y FROM oo)
SELECT idx.stratum, idx.row_id, {_r(f"a1.x - coalesce(b2.y, 0) - {'idx.scaling' if efron else '0'} * (a1.x - coalesce(a2.x, 0))", "value")} FROM idx
JOIN a a1 ON a1.stratum = idx.stratum AND a1.p = idx.first LEFT JOIN b2 ON b2.stratum = idx.stratum AND b2.p = idx.event_map
LEFT JOIN a a2 ON a2.stratum = idx.stratum AND a2.p = idx.last + 1""",
        )
        own = "CASE WHEN o.hit AND t = o.event THEN fs ELSE 0 END" if efron else "0"
        out["sum_over_events" + "_breslow" * (not efron)] = (
            kernel(lambda obs, idx, efron=efron: order.sum_over_events(obs, idx, F.col("v0"), efron)),
            f"""{n}, ft AS (SELECT stratum, event AS t, sum(v0) AS f, sum(v0 * scaling) AS fs FROM oo WHERE hit GROUP BY stratum, event)
SELECT o.stratum, o.row_id, {_r(f'coalesce(sum(f - {own}), 0)', 'value')} FROM oo o LEFT JOIN ft ON ft.stratum = o.stratum AND o.start < t AND t <= o.event GROUP BY o.stratum, o.row_id""",
        )
    out["preprocess_strata"] = (
        lambda spark, d: _rounded(_cox(spark, d, "efron", True, True).preprocess(F.expr(WEIGHTS["zeros"])).withColumn("start", F.greatest("start", F.lit(-1.0)))),
        f"""{whole} SELECT obs.row_id, obs.stratum, {_r('greatest(obs.start, -1.0::DOUBLE)', 'start')}, {_r('obs.event', 'event')}, status, idx.event_order, idx.start_order, idx.first, idx.last, {_r('idx.scaling', 'scaling')}, idx.event_map, idx.start_map, o2.first AS first_start
FROM obs JOIN idx USING (row_id) LEFT JOIN idx o2 ON o2.stratum = obs.stratum AND o2.event_order = idx.start_map""",
    )
    out["lexsort_strata"] = (
        kernel(lambda obs, idx: order.lexsort(obs)),
        f"""WITH {events_sql(True, True, 'zeros').strip()},{INDEX_SQL} SELECT stratum, row_id, is_start,
row_number() OVER (PARTITION BY stratum ORDER BY t, late, mw, is_start, row_id) - 1 AS position FROM pts""",
    )
    out["strata"] = (lambda spark, d: _cox(spark, d, "efron", True, True).strata(), f"WITH {events_sql(True, True, 'zeros').strip()} SELECT stratum, count(*) AS n FROM obs GROUP BY stratum")
    out["stratum_rows"] = (lambda spark, d: _cox(spark, d, "efron", True, True).stratum_rows(), f"WITH {events_sql(True, True, 'zeros').strip()} SELECT stratum, row_id FROM obs")

    def prework(obs: DataFrame, idx: DataFrame) -> DataFrame:
        at = idx.select(F.col("row_id").alias("_i"), "scaling")
        made = order.forward_prework(1, 2, F.col("status").cast("double"), F.col("scaling"), F.lit(4.0) + F.exp("v1"), F.col("weight"), F.col("v1"))
        return obs.join(at, F.col("row_id") == F.col("_i")).select("row_id", made.alias("value"))

    out["forward_prework"] = (
        kernel(prework),
        f"{n} SELECT row_id, {_r('CASE WHEN weight > 0 THEN status * weight * scaling / (4 + exp(v1)) ** 2 * v1 ELSE 0 END', 'value')} FROM oo",
    )
    out["forward_prework_plain"] = (
        kernel(lambda obs, idx: obs.select("row_id", order.forward_prework(0, 1, F.col("status").cast("double"), F.lit(0.0), F.lit(4.0) + F.exp("v1")).alias("value"))),
        f"{n} SELECT row_id, {_r('status / (4 + exp(v1))', 'value')} FROM oo",
    )
    return out


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["cox_deviance_breslow"](spark, sf_dir)
