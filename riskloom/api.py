"""Cox partial likelihood of the rows of a DataFrame.

    cox = CoxLikelihood(df, event="time", status="died", start="entry", strata="site")
    result = cox("eta")                    # a column or an expression
    result.deviance                        # a number; runs the plan
    result.rows()                          # row_id, gradient, diag_hessian
    info = cox.information("eta", "w")
    info.matvec("v")                       # row_id, iv: information times v
    info.quadratic_form(["x1", "x2"])      # X' I X

The constructor and each new predictor check their input in one pass over the rows, which also
gives the predictor's means; what a result needs of the timeline is written once, when it is first
asked for.  All else is lazy.  Results are bound to the predictor and weights that they were made with.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from riskloom.operators import order, timeline as tl
from riskloom.plans.storage import materialise

TIES = ("efron", "breslow")
WEIGHT = "sample_weight must be a finite number, 0 or more"
# X' I X of up to so many features is summed up on the timeline, all pairs at once; of more, through products with each feature.
PAIRED = 8


def _column(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _no_weight(w: Column) -> Column:
    return w.isNull() | F.isnan(w) | (w < 0) | (w == float("inf"))


def _checked(terms: DataFrame) -> DataFrame:
    """The terms, written; ArithmeticError if a failure time has no positive risk sum."""
    written = materialise(terms, "terms")
    bad = written.where("k > 0 AND NOT r > 0").count()
    if bad:
        raise ArithmeticError(f"{bad}{tl.NOT_POSITIVE}")
    return written


class CoxLikelihood:
    """Deviance, gradient and information for given linear predictors.

    Parameters are column names or expressions over `df`.  `row_id` identifies rows in
    results; without one, rows get numbers in a table that is written when row results are first asked for.
    `sample_weight` here says, as at each call, which weights are zero; it is not
    a default for later calls: a call without weights has weights of one.
    Raises ValueError for a status other than 0 and 1, strata that aren't whole
    numbers (text is allowed), a null, a NaN, a start not before its event, or a weight that is negative or infinite;
    a call does for such weights and for a predictor that is null, NaN or infinite.  `validate=False` leaves all these checks out.
    Ids may repeat but in `risk_index` and `preprocess`, which raise ValueError then.
    """

    def __init__(self, df: DataFrame, event: str | Column, status: str | Column, strata: str | Column | None = None, start: str | Column | None = None, sample_weight: str | Column | None = None, tie_breaking: str = "efron", row_id: str | Column | None = None, compat: str | None = None, validate: bool = True):
        if tie_breaking not in TIES:
            raise ValueError(f"tie_breaking must be one of {TIES}")
        if compat not in (None, "reference"):
            raise ValueError("compat must be None or 'reference'")
        self.efron, self.compat, self.tie_breaking = tie_breaking == "efron", compat, tie_breaking
        stratum = F.lit(0) if strata is None else _column(strata)
        cols = {
            "stratum": stratum,
            "start": F.lit(float("-inf")) if start is None else _column(start).cast("double"),
            "event": _column(event).cast("double"),
            "status": _column(status).cast("double"),
        }
        self._ids = None if row_id is None else _column(row_id)
        self.df, self._cols, self.has_start, self.validate = df, cols, start is not None, validate
        if validate:
            self._validate(sample_weight)
        cols["status"] = cols["status"].cast("int")
        self._results: dict[str, CoxResult] = {}
        self._mean_tables: dict[str, DataFrame] = {}
        self._unique_ids = False
        self._construction_weight = sample_weight

    def _validate(self, weight: str | Column | None) -> None:
        c = self._cols
        kind = self.df.select(c["stratum"].alias("s")).schema["s"].dataType
        if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
            raise ValueError(f"strata must be whole numbers or text, got {kind.simpleString()}")
        bad = lambda x: F.coalesce(F.max(F.when(x, 1)), F.lit(0))
        gone = lambda x: x.isNull() | F.isnan(x)
        checks = {
            "status must be 0 or 1": c["status"].isNull() | ~c["status"].isin(0.0, 1.0),
            "event must be a number": gone(c["event"]),
            "start must be a number": gone(c["start"]),
            "start must be before event": c["start"] >= c["event"],
            "strata must not be null": c["stratum"].isNull(),
        }
        if weight is not None:
            w = _column(weight).cast("double")
            checks[WEIGHT] = _no_weight(w)
        found = self.df.agg(*(bad(x).alias(f"c{i}") for i, x in enumerate(checks.values())), bad(c["start"] > F.lit(float("-inf"))).alias("starts")).first()
        for i, text in enumerate(checks):
            if found[f"c{i}"]:
                raise ValueError(text)
        self.has_start = self.has_start and bool(found["starts"])

    def observations(self, linear_predictor: str | Column, sample_weight: str | Column | None = None, more: dict[str, Column] | None = None, ids: bool = True) -> DataFrame:
        """row_id (null if not `ids`), stratum, start, event, status, weight, eta and further columns."""
        if ids and self._ids is None:
            self.df = materialise(self.df.withColumn("_row", F.monotonically_increasing_id()), "rows")
            self._ids = F.col("_row")
        weight = F.lit(1.0) if sample_weight is None else _column(sample_weight).cast("double")
        extra = [v.cast("double").alias(k) for k, v in (more or {}).items()]
        return self.df.select((self._ids if ids else F.lit(None)).alias("row_id"), *(v.alias(k) for k, v in self._cols.items()), weight.alias("weight"), _column(linear_predictor).cast("double").alias("eta"), *extra)

    def _key(self, linear_predictor: str | Column, sample_weight: str | Column | None) -> str:
        """What tells inputs apart: their analysed expressions, so that a name and its column are one."""
        weight = [] if sample_weight is None else [_column(sample_weight).alias("w")]
        return self.df.select(_column(linear_predictor).alias("eta"), *weight)._jdf.queryExecution().analyzed().canonicalized().toString()

    def _means(self, linear_predictor: str | Column, sample_weight: str | Column | None) -> DataFrame:
        """stratum, mean of the predictor; checks predictor and weights in the same pass, once."""
        key = self._key(linear_predictor, sample_weight)
        if key not in self._mean_tables:
            obs = self.observations(linear_predictor, sample_weight, ids=False)
            bad = lambda x: F.sum(F.when(x, 1).otherwise(0))
            eta = F.col("eta")
            unfit = eta.isNull() | F.isnan(eta) | (F.abs(eta) == float("inf"))
            means = materialise(obs.groupBy("stratum").agg(F.avg("eta").alias("mean"), bad(unfit).alias("eta"), bad(_no_weight(F.col("weight"))).alias("weight")), "means")
            found = means.agg(F.sum("eta").alias("eta"), F.sum("weight").alias("weight")).first()
            if self.validate and found["eta"]:
                raise ValueError(f"linear_predictor must be a finite number: {found['eta']} rows")
            if self.validate and found["weight"]:
                raise ValueError(f"{WEIGHT}: {found['weight']} rows")
            self._mean_tables[key] = means
        return self._mean_tables[key]

    def scored(self, linear_predictor: str | Column, sample_weight: str | Column | None, more: dict[str, Column] | None = None, ids: bool = True) -> DataFrame:
        """The observations with their risk scores (see `operators.timeline`)."""
        return tl.scored(self.observations(linear_predictor, sample_weight, more, ids), self._means(linear_predictor, sample_weight))

    def __call__(self, linear_predictor: str | Column, sample_weight: str | Column | None = None) -> CoxResult:
        key = self._key(linear_predictor, sample_weight)
        if key not in self._results:
            self._results[key] = CoxResult(self, linear_predictor, sample_weight)
        return self._results[key]

    def information(self, linear_predictor: str | Column, sample_weight: str | Column | None = None) -> CoxInformation:
        return CoxInformation(self, linear_predictor, sample_weight)

    def risk_index(self, sample_weight: str | Column | None = None) -> DataFrame:
        """Positions, clusters and rank look-ups of each row (see `operators.order`)."""
        return order.risk_index(self._indexed(sample_weight))

    def preprocess(self, sample_weight: str | Column | None = None) -> DataFrame:
        """The observations in event order with their index, and first_start (see `operators.order`)."""
        return order.preprocess(self._indexed(sample_weight))

    def _indexed(self, sample_weight: str | Column | None) -> DataFrame:
        """Observations whose ids are known to be unique and whose weights have been checked."""
        weight = sample_weight if sample_weight is not None else self._construction_weight
        self._means(F.lit(0.0), weight)
        obs = self.observations(F.lit(0.0), weight)
        if not self._unique_ids:
            if not obs.groupBy("row_id").count().where("count > 1").isEmpty():
                raise ValueError("row_id must be unique")
            self._unique_ids = True
        return obs

    def strata(self) -> DataFrame:
        """stratum, n."""
        return self.df.groupBy(self._cols["stratum"].alias("stratum")).agg(F.count("*").alias("n"))

    def stratum_rows(self) -> DataFrame:
        """stratum, row_id."""
        return self.observations(F.lit(0.0)).select("stratum", "row_id")


class CoxResult:
    """What a linear predictor and weights give."""

    def __init__(self, cox: CoxLikelihood, linear_predictor: str | Column, sample_weight: str | Column | None):
        self.cox, self.linear_predictor, self.sample_weight = cox, linear_predictor, sample_weight
        self._terms: DataFrame | None = None
        self._written = False
        self._numbers: dict | None = None
        cox._means(linear_predictor, sample_weight)

    def _rows(self, ids: bool = False) -> DataFrame:
        return self.cox.scored(self.linear_predictor, self.sample_weight, ids=ids)

    def _timeline(self) -> DataFrame:
        """The terms of each time; the timeline under it is written once per result."""
        if self._terms is None:
            line = tl.timeline(self._rows(), self.cox.has_start)
            self._terms = tl.moments(tl.at_risk(line), self.cox.efron, tl.largest_tie(line) if self.cox.efron else 0)
        return self._terms

    def scalars(self, by_stratum: bool = False) -> DataFrame:
        return tl.scalars(self._rows(), self._timeline(), by_stratum)

    def rows(self) -> DataFrame:
        """row_id, gradient, diag_hessian; ArithmeticError if a failure time has no positive risk sum."""
        if not self._written:  # rows read the terms several times
            self._terms, self._written = _checked(self._timeline()), True
        out = tl.per_row(self._rows(ids=True), self._terms, self.cox.has_start, reference_diag=self.cox.compat == "reference", efron=self.cox.efron)
        return out.select("row_id", "gradient", "diag_hessian")

    def risk_sums(self) -> DataFrame:
        """stratum, t, r, d, w, k at each failure time."""
        return self._timeline().where("k > 0").select("stratum", "t", "r", "d", "w", "k")

    def _number(self, name: str):
        if self._numbers is None:
            numbers = self.scalars().first().asDict()
            if numbers["bad_times"]:
                raise ArithmeticError(f"{numbers['bad_times']}{tl.NOT_POSITIVE}")
            self._numbers = numbers
        return self._numbers[name]

    @property
    def deviance(self) -> float:
        return self._number("deviance")

    @property
    def loglik_sat(self) -> float:
        return self._number("loglik_sat")

    @property
    def loglik(self) -> float:
        return self._number("loglik")

    @property
    def clipped_rows(self) -> int:
        return self._number("clipped_rows")


class CoxInformation:
    """The information matrix at one predictor: products with it, never the matrix."""

    def __init__(self, cox: CoxLikelihood, linear_predictor: str | Column, sample_weight: str | Column | None):
        self.cox, self.linear_predictor, self.sample_weight = cox, linear_predictor, sample_weight
        cox._means(linear_predictor, sample_weight)

    def _terms(self, more: dict[str, Column], names: Sequence[str], pairs: bool = False, ids: bool = True) -> tuple[DataFrame, DataFrame]:
        rows = self.cox.scored(self.linear_predictor, self.sample_weight, more, ids)
        factors = {n: F.col(n) for n in names}
        if pairs:
            factors |= {f"p_{i}_{j}": F.col(names[i]) * F.col(names[j]) for i in range(len(names)) for j in range(i, len(names))}
        line = tl.timeline(rows, self.cox.has_start, factors)
        return rows, tl.moments(tl.at_risk(line, list(factors)), self.cox.efron, tl.largest_tie(line) if self.cox.efron else 0)

    def _per_row(self, vectors: Sequence[str | Column], names: Sequence[str], ids: bool) -> DataFrame:
        rows, terms = self._terms(dict(zip(names, map(_column, vectors))), names, ids=ids)
        return tl.per_row(rows, _checked(terms), self.cox.has_start, names, self.cox.compat == "reference", self.cox.efron)

    def rows(self, *vectors: str | Column) -> DataFrame:
        """row_id, gradient, diag_hessian and iv_0, iv_1, ...: all row-level results in one pass."""
        names = [f"v{i}" for i in range(len(vectors))]
        out = self._per_row(vectors, names, ids=True)
        return out.select("row_id", "gradient", "diag_hessian", *(F.col(f"iv_{n}").alias(f"iv_{i}") for i, n in enumerate(names)))

    def matvec(self, *vectors: str | Column) -> DataFrame:
        """row_id and iv_0, iv_1, ...: the information times each vector, all in one pass."""
        return self.rows(*vectors).drop("gradient", "diag_hessian")

    adjoint = matvec  # symmetric

    def __matmul__(self, vectors: str | Column | Sequence[str | Column]) -> DataFrame:
        """`info @ "v"`, or `info @ ["v1", "v2"]` for the columns of a matrix."""
        return self.matvec(*([vectors] if isinstance(vectors, (str, Column)) else vectors))

    def quadratic_form(self, features: Sequence[str | Column]) -> DataFrame:
        """i, j (i <= j) and value: X' I X over the features."""
        names = [f"x{i}" for i in range(len(features))]
        if len(names) > PAIRED:
            return tl.quadratic_form_by_rows(self._per_row(features, names, ids=False), names)
        _, terms = self._terms(dict(zip(names, map(_column, features))), names, pairs=True, ids=False)
        return tl.quadratic_form(terms, names)

    def score(self, features: Sequence[str | Column]) -> DataFrame:
        """i and value: X' times the gradient of the deviance."""
        names = [f"x{i}" for i in range(len(features))]
        more = dict(zip(names, map(_column, features)))
        _, terms = self._terms({}, [], ids=False)
        rows = self.cox.scored(self.linear_predictor, self.sample_weight, more, ids=False)
        out = tl.per_row(rows, _checked(terms), self.cox.has_start, efron=self.cox.efron)
        cells = F.array(*(F.struct(F.lit(i).alias("i"), F.sum(F.col(n) * F.col("gradient")).alias("value")) for i, n in enumerate(names)))
        return out.agg(cells.alias("cells")).select(F.explode("cells").alias("c")).select("c.*")

    def covariance(self, features: Sequence[str | Column]) -> np.ndarray:
        """The inverse of X' I X, a p x p matrix on the driver."""
        m = np.zeros((len(features), len(features)))
        for r in self.quadratic_form(features).collect():
            m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["value"]
        return np.linalg.inv(m)
