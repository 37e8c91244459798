"""The Cox deviance against its definition, over tie patterns, options and invariances."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from riskloom.api import CoxLikelihood
from riskloom.operators import order, timeline

NEG = float("-inf")
COLS = "i long, g int, start double, event double, status int, w double, eta double, v double, x double"


def tied_rows(rng, stratum, first_id):
    """A small stratum whose starts and events lie on a grid of whole numbers, so that they coincide in many ways."""
    grid, out = int(rng.integers(2, 7)), []
    for k in range(int(rng.integers(1, 16))):
        start = int(rng.integers(0, grid))
        event = start + int(rng.integers(1, grid + 1))
        weight = float(rng.integers(0, 4) / 2 + rng.random())
        out.append((first_id + k, stratum, float(start), float(event), int(rng.random() < 0.65), weight, *(float(x) for x in rng.normal(size=3))))
    return out


@pytest.fixture(scope="module")
def all_patterns():
    rng, rows = np.random.default_rng(0), []
    for g in range(220):
        rows += tied_rows(rng, g, len(rows))
    return rows


def with_zeros(rows):
    rng = np.random.default_rng(1)
    return [(*r[:5], 0.0 if rng.random() < 0.2 else r[5], *r[6:]) for r in rows]


def definition(rows, efron, starts=True, strata=True, ones=False):
    """Everything from risk sets looked up failure time by failure time: {i: (gradient, diag, iv)}, scalars, X'IX."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1] if strata else 0, []).append(r)
    per_row, dev, sat_all, quad = {}, 0.0, 0.0, np.zeros((2, 2))
    for rs in groups.values():
        ids = [r[0] for r in rs]
        start = np.array([r[2] if starts else NEG for r in rs])
        event, d = np.array([r[3] for r in rs]), np.array([r[4] for r in rs])
        w = np.ones(len(rs)) if ones else np.array([r[5] for r in rs])
        eta, v, x = (np.array([r[k] for r in rs]) for k in (6, 7, 8))
        c = eta - eta.mean()
        e = w * np.exp(np.minimum(c, 30))
        hit = (d == 1) & (w > 0)
        ll, sat, info = (w * d * c).sum(), 0.0, np.zeros((len(rs), len(rs)))
        grad = w * d
        for t in np.unique(event[hit]):
            risk, tie = (start < t) & (t <= event), hit & (event == t)
            k, total = int(tie.sum()), w[tie].sum()
            sat -= total * math.log(total)
            for m in range(k):
                s = m / k if efron else 0.0
                a = e * (risk - s * tie)
                ll -= total / k * math.log(a.sum())
                sat -= total / k * math.log(1 - s)
                p = a / a.sum()
                grad = grad - total / k * p
                info += total / k * (np.diag(p) - np.outer(p, p))
        dev += 2 * (sat - ll)
        sat_all += sat
        both = np.stack([v, x])
        quad += both @ info @ both.T
        per_row.update({i: (-2 * g, 2 * h, u) for i, g, h, u in zip(ids, grad, np.diag(info), info @ v)})
    return per_row, (dev, sat_all), quad


OPTIONS = list(itertools.product(["breslow", "efron"], [False, True], [False, True], ["ones", "positive", "zeros"]))


@pytest.mark.parametrize("ties, starts, strata, weight", OPTIONS)
def test_against_the_definition(spark, all_patterns, ties, starts, strata, weight):
    rows = with_zeros(all_patterns) if weight == "zeros" else all_patterns
    if not strata:
        rows = rows[:400]
    want, (dev, sat), quad = definition(rows, ties == "efron", starts, strata, weight == "ones")
    df = spark.createDataFrame(rows, COLS)
    cox = CoxLikelihood(df, "event", "status", strata="g" if strata else None, start="start" if starts else None, tie_breaking=ties, row_id="i", validate=starts)
    w = None if weight == "ones" else "w"
    result = cox("eta", w)
    assert result.deviance == pytest.approx(dev, rel=1e-10, abs=1e-8) and result.loglik_sat == pytest.approx(sat, rel=1e-10, abs=1e-8)
    info = cox.information("eta", w)
    got = {r.row_id: r for r in info.rows("v").collect()}
    assert got.keys() == want.keys()
    for i, (g, h, u) in want.items():
        assert (got[i].gradient, got[i].diag_hessian, got[i].iv_0) == pytest.approx((g, h, u), abs=1e-9)
    cells = {(r.i, r.j): r.value for r in info.quadratic_form(["v", "x"]).collect()}
    assert set(cells) == {(0, 0), (0, 1), (1, 1)}
    for (i, j), value in cells.items():
        assert value == pytest.approx(quad[i, j], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("inline, run", [(1, 2), (2, 3), (1024, 8192)])
def test_ties_are_summed_up_in_rows_or_in_runs(spark, all_patterns, monkeypatch, inline, run):
    monkeypatch.setattr(timeline, "INLINE", inline)
    monkeypatch.setattr(timeline, "RUN", run)
    want, (dev, sat), quad = definition(all_patterns[:300], True)
    cox = CoxLikelihood(spark.createDataFrame(all_patterns[:300], COLS), "event", "status", strata="g", start="start", row_id="i")
    assert cox("eta", "w").deviance == pytest.approx(dev) and cox("eta", "w").loglik_sat == pytest.approx(sat)
    for r in cox.information("eta", "w").rows("v").collect():
        assert (r.gradient, r.diag_hessian, r.iv_0) == pytest.approx(want[r.row_id], abs=1e-9)


def test_many_features_and_several_columns(spark, all_patterns, monkeypatch):
    cox = CoxLikelihood(spark.createDataFrame(all_patterns[:500], COLS), "event", "status", strata="g", start="start", row_id="i")
    info = cox.information("eta", "w")
    features = ["v", "x", F.col("v") * F.col("x")]
    few = {(r.i, r.j): r.value for r in info.quadratic_form(features).collect()}
    monkeypatch.setattr("riskloom.api.PAIRED", 2)
    assert {(r.i, r.j): r.value for r in info.quadratic_form(features).collect()} == pytest.approx(few, abs=1e-9)
    key = lambda r: r.row_id
    assert sorted((info @ ["v", "x"]).collect(), key=key) == sorted(info.matvec("v", "x").collect(), key=key)
    assert (info @ "v").columns == (info @ F.col("v")).columns == ["row_id", "iv_0"]


DOC = [(0, 1, 4, 0, 0.13, 1.03), (1, 0, 3, 0, -0.13, 1.12), (2, 1, 3, 0, 0.64, 1.67), (3, 2, 6, 1, 0.1, 1.65), (4, 5, 7, 1, -0.54, 1.62), (5, 5, 8, 1, 0.36, 1.38), (6, 1, 5, 0, 1.3, 2.0), (7, 2, 6, 1, 0.95, 1.98), (8, 3, 7, 1, -0.7, 1.69), (9, 5, 10, 1, -1.27, 1.65), (10, 0, 2, 1, -0.62, 1.69), (11, 4, 6, 1, 0.04, 1.39), (12, 5, 7, 0, -2.33, 1.14), (13, 5, 9, 0, -0.22, 1.72), (14, 1, 4, 0, -1.25, 1.53), (15, 0, 2, 1, -0.73, 1.31), (16, 3, 7, 0, -0.54, 1.49), (17, 0, 5, 1, -0.32, 1.89), (18, 0, 5, 1, 0.41, 1.93), (19, 0, 3, 0, 1.04, 1.36)]
# Golden values: ties, start: deviance, saturated, gradient, diagonal, information times 0..19 (first three rows), sum of the diagonal, the same in the reference's form.
GOLDEN = [
    ("breslow", None, 50.9086992466, -21.7476647084, (0.18646848, 0.15633984, 0.50347146), (0.18067339, 0.15226615, 0.46122421), (-0.83931084, -0.62552929, -1.76269738), 27.1607666517, 27.1607666517),
    ("efron", None, 59.8429408495, -15.7200513949, (0.18841070, 0.15796825, 0.50871553), (0.18249364, 0.15380881, 0.46557903), (-0.84503240, -0.62951219, -1.77290173), 27.2385892247, 40.8938074626),
    ("breslow", "start", 46.3285860898, -21.7476647084, (0.30909902, 0.25915636, 0.83457826), (0.29317532, 0.24796269, 0.71849145), (-1.52607743, -1.14992333, -3.28588458), 26.1961898764, 26.1961898764),
    ("efron", "start", 55.1456146561, -15.7200513949, (0.31450999, 0.26369304, 0.84918805), (0.29801902, 0.25210061, 0.72896575), (-1.54670259, -1.16494763, -3.32696344), 26.2001079125, 45.0123985778),
]


@pytest.mark.parametrize("golden", GOLDEN)
def test_golden(spark, golden):
    ties, start, dev, sat, grad, diag, iv, total, reference = golden
    df = spark.createDataFrame(DOC, "i long, start long, event long, status int, eta double, weight double")
    cox = CoxLikelihood(df, "event", "status", start=start, tie_breaking=ties, row_id="i")
    result = cox("eta", "weight")
    assert (round(result.deviance, 10), round(result.loglik_sat, 10)) == (dev, sat)
    got = cox.information("eta", "weight").rows("i").orderBy("row_id").collect()
    assert [round(r.gradient, 8) for r in got[:3]] == list(grad)
    assert [round(r.diag_hessian, 8) for r in got[:3]] == list(diag)
    assert [round(r.iv_0, 8) for r in got[:3]] == list(iv)
    assert sum(r.diag_hessian for r in got) == pytest.approx(total, abs=1e-9)
    other = CoxLikelihood(df, "event", "status", start=start, tie_breaking=ties, row_id="i", compat="reference")("eta", "weight").rows().collect()
    assert sum(r.diag_hessian for r in other) == pytest.approx(reference, abs=1e-9)


def test_documented_example(spark):
    event, status = [3, 6, 8, 4, 6, 4, 3, 2, 2, 5, 3, 4], [1, 1, 0, 1, 0, 1, 1, 0, 1, 1, 0, 1]
    rows = [(i, e, s, -1 + 2 * i / 11) for i, (e, s) in enumerate(zip(event, status))]
    df = spark.createDataFrame(rows, "i long, event long, status int, eta double")
    efron, breslow = (CoxLikelihood(df, "event", "status", tie_breaking=t)("eta") for t in ("efron", "breslow"))
    assert (efron.deviance, efron.loglik_sat) == pytest.approx((25.1942820963, -2.4849066498), abs=1e-9)
    assert (breslow.deviance, breslow.loglik_sat) == pytest.approx((22.2219212850, -4.6821312271), abs=1e-9)
    whole = [(i, 0, NEG, float(e), s, 1.0, eta, 0.0, 0.0) for i, e, s, eta in rows]
    for got, is_efron in ((efron, True), (breslow, False)):
        assert (got.deviance, got.loglik_sat) == pytest.approx(definition(whole, is_efron)[1], abs=1e-9)


@pytest.mark.parametrize("ties", ["breslow", "efron"])
def test_invariances(spark, all_patterns, ties):
    rows = with_zeros(all_patterns)[:900]
    make = lambda rs: CoxLikelihood(spark.createDataFrame(rs, COLS), "event", "status", strata="g", start="start", tie_breaking=ties, row_id="i")
    cox = make(rows)
    got = cox.information("eta", "w").rows(F.lit(1.0), "v", "x").collect()
    assert max(abs(r.iv_0) for r in got) < 1e-9  # I times 1
    v, x = {r[0]: r[7] for r in rows}, {r[0]: r[8] for r in rows}
    assert sum(r.iv_1 * x[r.row_id] for r in got) == pytest.approx(sum(r.iv_2 * v[r.row_id] for r in got))  # symmetry
    assert abs(sum(r.gradient for r in got)) < 1e-9
    dropped, full = make([r for r in rows if r[5] > 0])("eta", "w"), cox("eta", "w")
    assert dropped.deviance == pytest.approx(full.deviance)  # weight 0 is as good as gone
    shifted = cox(F.col("eta") + F.col("g"), "w")
    assert shifted.deviance == pytest.approx(full.deviance)
    parts = full.scalars(by_stratum=True).collect()
    assert sum(r.deviance for r in parts) == pytest.approx(full.deviance)


def test_without_ties_the_rules_agree(spark):
    rng = np.random.default_rng(3)
    rows = [(i, 0, float(-rng.random()), float(i + 1), int(rng.random() < 0.5), 1.0, float(rng.normal()), 0.0, 0.0) for i in range(60)]
    df = spark.createDataFrame(rows, COLS)
    a, b = (CoxLikelihood(df, "event", "status", start="start", tie_breaking=t, row_id="i") for t in ("efron", "breslow"))
    assert a("eta").deviance == pytest.approx(b("eta").deviance)
    assert np.allclose(*([r.diag_hessian for r in c("eta").rows().orderBy("row_id").collect()] for c in (a, b)))


def test_clipping_censoring_and_large_ties(spark):
    rows = [(i, i % 2, NEG, 1.0 + (i >= 20_000), int(i % 2 == 0), 1.0, 0.0, 0.0, 0.0) for i in range(40_000)]  # stratum 1 has no failure
    df = spark.createDataFrame(rows, COLS)
    got = CoxLikelihood(df, "event", "status", strata="g", row_id="i")("eta").scalars(by_stratum=True).collect()
    by = {r.stratum: r for r in got}
    assert (by[1].deviance, by[1].loglik_sat) == (0.0, 0.0)
    n = 10_000
    first = sum(math.log(2 * n - m) for m in range(n))
    ties = sum(math.log(1 - m / n) for m in range(n))
    assert by[0].loglik == pytest.approx(-first - sum(math.log(n - m) for m in range(n)))
    assert by[0].loglik_sat == pytest.approx(-2 * (n * math.log(n) + ties))
    big = spark.createDataFrame([(0, 0, NEG, 1.0, 1, 1.0, 100.0, 0.0, 0.0), (1, 0, NEG, 2.0, 1, 1.0, 0.0, 0.0, 0.0)], COLS)
    result = CoxLikelihood(big, "event", "status", row_id="i")("eta")
    assert result.clipped_rows == 1 and result.loglik == pytest.approx(50 - 50 - math.log(math.exp(30) + math.exp(-50)) - -50)


def test_covariance_and_score(spark, all_patterns):
    df = spark.createDataFrame(all_patterns[:500], COLS)
    cox = CoxLikelihood(df, "event", "status", strata="g", start="start", row_id="i")
    info = cox.information("eta", "w")
    m = info.covariance(["v", "x"])
    rows = info.rows("v", "x").collect()
    v, x = {r[0]: r[7] for r in all_patterns}, {r[0]: r[8] for r in all_patterns}
    full = np.array([[sum(f[r.row_id] * u for r, u in zip(rows, us)) for us in ([r.iv_0 for r in rows], [r.iv_1 for r in rows])] for f in (v, x)])
    assert np.allclose(np.linalg.inv(full), m)
    score = {r.i: r.value for r in info.score(["v", "x"]).collect()}
    assert score[0] == pytest.approx(sum(v[r.row_id] * r.gradient for r in rows)) and score[1] == pytest.approx(sum(x[r.row_id] * r.gradient for r in rows))


def test_results_are_bound_and_remembered(spark):
    df = spark.createDataFrame(DOC, "i long, start long, event long, status int, eta double, weight double")
    cox = CoxLikelihood(df, "event", "status", start="start", row_id="i")
    one, info = cox("eta", "weight"), cox.information("eta", "weight")
    before = info.matvec("i").orderBy("row_id").collect()
    assert cox(F.col("eta") * 2, "weight") is not one and cox("eta", "weight") is one
    assert info.matvec("i").orderBy("row_id").collect() == before and info.adjoint("i").orderBy("row_id").collect() == before
    weighted = CoxLikelihood(df, "event", "status", start="start", sample_weight="weight", row_id="i")
    assert weighted("eta").deviance == pytest.approx(cox("eta").deviance) and weighted("eta").deviance != pytest.approx(one.deviance)


@pytest.mark.parametrize(
    "change, text",
    [
        ({"status": "0.5"}, "status"),
        ({"status": "CAST(NULL AS INT)"}, "status"),
        ({"event": "CAST('NaN' AS DOUBLE)"}, "event"),
        ({"start": "event"}, "start must be before"),
        ({"start": "CAST(NULL AS DOUBLE)"}, "start must be a number"),
        ({"g": "1.5D"}, "strata"),
        ({"g": "CAST(NULL AS INT)"}, "strata"),
        ({"w": "-1D"}, "sample_weight"),
    ],
)
def test_validation(spark, change, text):
    df = spark.createDataFrame([(0, 0, 0.0, 1.0, 1, 1.0, 0.0, 0.0, 0.0)], COLS)
    for name, to in change.items():
        df = df.withColumn(name, F.expr(to))
    with pytest.raises(ValueError, match=text):
        CoxLikelihood(df, "event", "status", strata="g", start="start", sample_weight="w", row_id="i")


@pytest.mark.parametrize("change", [{"eta": "CAST(NULL AS DOUBLE)"}, {"eta": "CAST('NaN' AS DOUBLE)"}, {"eta": "CAST('-Infinity' AS DOUBLE)"}, {"w": "CAST(NULL AS DOUBLE)"}, {"w": "CAST('NaN' AS DOUBLE)"}, {"w": "-1D"}, {"w": "CAST('Infinity' AS DOUBLE)"}])
def test_calls_are_checked(spark, change):
    df = spark.createDataFrame([(i, 0, 0.0, 1.0 + i, 1, 1.0, 0.1 * i, 0.0, 0.0) for i in range(5)], COLS)
    for name, to in change.items():
        df = df.withColumn(name, F.when(F.col("i") == 3, F.expr(to)).otherwise(F.col(name)))
    cox = CoxLikelihood(df, "event", "status", row_id="i")
    text = "linear_predictor" if "eta" in change else "sample_weight"
    for use in (lambda: cox("eta", "w").deviance, lambda: cox("eta", "w").rows(), lambda: cox.information("eta", "w").matvec("v"), lambda: cox.information("eta", "w").quadratic_form(["v"])):
        with pytest.raises(ValueError, match=text):
            use()
    if "w" in change:
        assert cox("eta").deviance > 0
        with pytest.raises(ValueError, match=text):
            cox.risk_index("w")


def test_a_name_and_its_column_are_one_predictor(spark):
    df = spark.createDataFrame(DOC, "i long, start long, event long, status int, eta double, weight double")
    cox = CoxLikelihood(df, "event", "status", row_id="i")
    assert cox("eta", "weight") is cox(F.col("eta"), F.col("weight")) and cox("eta") is not cox("weight") and cox("eta") is not cox("eta", "weight")


def test_ids_must_be_unique_for_an_index(spark):
    rows = [(i, 0, 0.0, 1.0 + i, 1, 1.0, 0.1 * i, 0.0, 0.0) for i in range(5)]
    twice = CoxLikelihood(spark.createDataFrame([*rows, rows[0]], COLS), "event", "status", row_id="i")
    for use in (twice.risk_index, twice.preprocess):
        with pytest.raises(ValueError, match="unique"):
            use()
    assert twice("eta").rows().count() == 6
    unnamed = CoxLikelihood(spark.createDataFrame([*rows, rows[0]], COLS), "event", "status")
    assert unnamed("eta").deviance == pytest.approx(twice("eta").deviance) and unnamed.risk_index().count() == 6


def test_a_failure_without_a_positive_risk_sum(spark):
    """The last failure's risk score underflows to 0."""
    df = spark.createDataFrame([(0, 0, NEG, 1.0, 1, 1.0, 0.0, 1.0, 0.0), (1, 0, NEG, 2.0, 1, 1.0, -4000.0, 1.0, 0.0)], COLS)
    cox = CoxLikelihood(df, "event", "status", row_id="i")
    assert cox("eta").scalars().first().bad_times == 1
    info = cox.information("eta")
    for use in (lambda: cox("eta").deviance, lambda: cox("eta").rows(), lambda: info.matvec("v"), lambda: info.score(["v"])):
        with pytest.raises(ArithmeticError, match="1 failure times"):
            use()
    with pytest.raises(Exception, match="1 failure times"):
        info.quadratic_form(["v"]).collect()


def test_options_are_checked(spark):
    df = spark.createDataFrame([(0, 0, 0.0, 1.0, 1, 1.0, 0.0, 0.0, 0.0)], COLS)
    for bad in ({"tie_breaking": "exact"}, {"compat": "x"}):
        with pytest.raises(ValueError):
            CoxLikelihood(df, "event", "status", **bad)
    with pytest.raises(ValueError, match="strata"):
        CoxLikelihood(df, "event", "status", strata="w")
    flags = df.withColumn("status", F.col("status") == 1).withColumn("g", F.lit("north"))
    assert CoxLikelihood(flags, "event", "status", strata="g")("eta").deviance == 0.0


def brute_index(rows):
    out = {}
    for g in {r[1] for r in rows}:
        rs = [r for r in rows if r[1] == g]
        pts = sorted([(r[3], 1 - r[4], -r[5], 0, r[0]) for r in rs] + [(r[2], 1, -r[5], 1, r[0]) for r in rs])
        ev = [p[4] for p in pts if not p[3]]
        st = [p[4] for p in pts if p[3]]
        by = {r[0]: r for r in rs}
        hit = lambda i: by[i][4] == 1 and by[i][5] > 0
        for r in rs:
            i = r[0]
            own = [k for k, j in enumerate(ev) if j == i or (hit(i) and hit(j) and by[j][3] == r[3])]
            before = pts[: pts.index((r[3], 1 - r[4], -r[5], 0, i))]
            until = pts[: pts.index((r[2], 1, -r[5], 1, i))]
            k = ev.index(i)
            out[i] = (k, st.index(i), own[0], own[-1], (k - own[0]) / len(own), sum(p[3] for p in before), sum(1 - p[3] for p in until))
    return out


def test_index_and_kernels(spark, all_patterns):
    rows = with_zeros(all_patterns)[:700]
    df = spark.createDataFrame(rows, COLS)
    cox = CoxLikelihood(df, "event", "status", strata="g", start="start", sample_weight="w", row_id="i")
    idx = cox.risk_index()
    want = brute_index(rows)
    got = {r.row_id: (r.event_order, r.start_order, r["first"], r["last"], r.scaling, r.event_map, r.start_map) for r in idx.collect()}
    assert got.keys() == want.keys()
    for i in want:
        assert got[i] == pytest.approx(want[i])
    obs = cox.observations("eta", "w", {"v": F.col("v")})
    ordered = order.in_event_order(obs, idx, "v")
    back = {r.row_id: r.v for r in order.in_native_order(ordered, idx, "v").collect()}
    assert back == {r[0]: r[7] for r in rows}
    sums = {(r.stratum, r.position): r.value for r in order.forward_cumsum(ordered, F.col("v")).collect()}
    rev = {(r.stratum, r.position): (r.by_event, r.by_start) for r in order.reverse_cumsums(obs, idx, F.col("v")).collect()}
    risk = {r.row_id: r.value for r in order.sum_over_risk_set(obs, idx, F.col("v")).collect()}
    plain = {r.row_id: r.value for r in order.sum_over_risk_set(obs, idx, F.col("v"), efron=False).collect()}
    joint = {(r.stratum, r.position): (r.row_id, r.is_start) for r in order.lexsort(obs).collect()}
    assert len(joint) == 2 * len(rows)
    events = {r.row_id: r.value for r in order.sum_over_events(obs, idx, F.col("v")).collect()}
    for g in {r[1] for r in rows}:
        rs = [r for r in rows if r[1] == g]
        by_event, by_start = sorted(rs, key=lambda r: want[r[0]][0]), sorted(rs, key=lambda r: want[r[0]][1])
        for k in range(len(rs) + 1):
            assert sums[g, k] == pytest.approx(sum(r[7] for r in by_event[:k]), abs=1e-9)
            assert rev[g, k] == pytest.approx((sum(r[7] for r in by_event[k:]), sum(r[7] for r in by_start[k:])), abs=1e-9)
        points = sorted([(r[3], 1 - r[4], -r[5], 0, r[0]) for r in rs] + [(r[2], 1, -r[5], 1, r[0]) for r in rs])
        assert [joint[g, k] for k in range(len(points))] == [(p[4], p[3]) for p in points]
        hits = [r for r in rs if r[4] == 1 and r[5] > 0]
        for r in rs:
            w = want[r[0]]
            whole = sum(x[7] for x in by_event[w[2] :]) - sum(x[7] for x in by_start[w[5] :])
            assert plain[r[0]] == pytest.approx(whole, abs=1e-9)
            assert risk[r[0]] == pytest.approx(whole - w[4] * sum(x[7] for x in by_event[w[2] : w[3] + 1]), abs=1e-9)
        for r in hits:
            tie = sum(o[7] for o in hits if o[3] == r[3])
            assert risk[r[0]] == pytest.approx(sum(o[7] for o in rs if o[2] < r[3] <= o[3]) - want[r[0]][4] * tie, abs=1e-9)
        for r in rs:
            own = sum(o[7] * want[o[0]][4] for o in hits if o[3] == r[3]) if r in hits else 0.0
            assert events[r[0]] == pytest.approx(sum(o[7] for o in hits if r[2] < o[3] <= r[3]) - own, abs=1e-9)
