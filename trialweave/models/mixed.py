"""Random-intercept linear mixed model, fitted by maximum likelihood.

Model: y = X b + u_group + e, with theta = sd(u) / sd(e). Given theta, the likelihood
depends on the data only through the cross products of [1, X, y] and, for each group size
n, the sum over groups of that size of the outer products of their column sums. Spark
reduces the rows to those sums: one row per group, then one row per distinct group size. That
table is stored. The likelihood is searched in rounds: each round evaluates a grid of
thetas over the table in one small job, for all models of the statistics together, and the next grid
lies between the neighbours of the best one. Only sums per theta reach the driver, a few numbers
for each, whatever the number of rows, groups or group sizes.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.models.tails import chi2_tail, chi2_tail_column
from trialweave.operators.scans import stored

COEFFICIENT_SCHEMA = "term string, estimate double, std_error double, t_value double"
FIT_SCHEMA = ("model string, n bigint, groups bigint, log_likelihood double, deviance double, aic double, "
              "bic double, var_group double, var_residual double")


@dataclass(frozen=True)
class MixedModel:
    y: str
    xs: tuple[str, ...]
    group: str
    n: int
    groups: int
    theta: float
    deviance: float
    var_group: float
    var_residual: float
    terms: tuple[str, ...]
    estimates: tuple[float, ...]
    std_errors: tuple[float, ...]
    var_fixed: float = field(default=0.0)

    @property
    def n_params(self) -> int:
        return len(self.terms) + 2

    @property
    def log_likelihood(self) -> float:
        return -self.deviance / 2

    @property
    def aic(self) -> float:
        return self.deviance + 2 * self.n_params

    @property
    def bic(self) -> float:
        return self.deviance + self.n_params * math.log(self.n)

    def coefficients(self, spark: SparkSession) -> DataFrame:
        rows = [(t, b, s, b / s if s else None) for t, b, s in zip(self.terms, self.estimates, self.std_errors)]
        return spark.createDataFrame(rows, COEFFICIENT_SCHEMA)

    def fit_row(self, name: str) -> tuple:
        return (name, self.n, self.groups, self.log_likelihood, self.deviance, self.aic, self.bic,
                self.var_group, self.var_residual)


def _names(m: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(m) for j in range(i, m)]


def complete_rows(df: DataFrame, cols: Sequence[str], group: str) -> DataFrame:
    """Rows known in every listed column; nested models must share them to be compared."""
    return df.select(group, *[F.col(c).cast("double").alias(c) for c in cols]).dropna()


def size_statistics(rows: DataFrame, cols: Sequence[str], group: str,
                    center: Sequence[float] | None = None, scale: Sequence[float] | None = None) -> DataFrame:
    """One row per group size ``n``: number of groups, sums of outer products of the group
    sums (``b_i_j``) and cross products of the rows (``m_i_j``), column 0 being the constant 1."""
    center, scale = center or [0.0] * len(cols), scale or [1.0] * len(cols)
    z = [F.lit(1.0), *[(F.col(c) - F.lit(m)) / F.lit(s) for c, m, s in zip(cols, center, scale)]]
    per_group = rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(c).alias(f"s_{i}") for i, c in enumerate(z)],
        *[F.sum(z[i] * z[j]).alias(f"m_{i}_{j}") for i, j in _names(len(z))])
    return per_group.groupBy("n").agg(
        F.count(F.lit(1)).alias("groups"),
        *[F.sum(F.col(f"s_{i}") * F.col(f"s_{j}")).alias(f"b_{i}_{j}") for i, j in _names(len(z))],
        *[F.sum(f"m_{i}_{j}").alias(f"m_{i}_{j}") for i, j in _names(len(z))])


def _square(row, prefix: str, m: int) -> np.ndarray:
    out = np.zeros((m, m))
    for i, j in _names(m):
        out[i, j] = out[j, i] = row[f"{prefix}_{i}_{j}"]
    return out


#: The first grid of thetas; points of a later one, and the width (against 1 + theta) at which the search ends.
FIRST_GRID = (0.0, *(float(t) for t in np.logspace(-3, 3, 61)))
POINTS, PRECISION, MOST_ROUNDS = 33, 1e-9, 12


@dataclass(frozen=True)
class MixedStatistics:
    """What the fits need to know of the data: one stored table by group size for any number of models."""

    cols: tuple[str, ...]
    group: str
    n: int
    groups: int
    center: np.ndarray
    scale: np.ndarray
    by_size: DataFrame
    total: np.ndarray


def mixed_statistics(df: DataFrame, cols: Sequence[str], group: str) -> MixedStatistics:
    """Reduce the rows known in all of ``cols``: one pass for moments, one for the sums.

    Columns are centred and scaled first, to keep the cross products well conditioned.
    """
    cols = list(cols)
    rows = complete_rows(df, cols, group)
    moments = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                       *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    if not moments["n"]:
        raise ValueError("too few complete rows for the model")
    center = [moments[f"m{i}"] for i in range(len(cols))]
    scale = [moments[f"s{i}"] or 1.0 for i in range(len(cols))]
    by_size = stored(size_statistics(rows, cols, group, center, scale))
    m = len(cols) + 1
    sums = by_size.agg(F.sum("groups").alias("groups"), *[F.sum(f"m_{i}_{j}").alias(f"m_{i}_{j}") for i, j in _names(m)]).first()
    return MixedStatistics(tuple(cols), group, moments["n"], sums["groups"], np.array(center), np.array(scale), by_size, _square(sums, "m", m))


def _profiles(stats: MixedStatistics, thetas: Sequence[float]) -> dict[float, tuple[float, np.ndarray]]:
    """For each theta the log determinant and the weighted cross products of all columns, one row per theta."""
    theta2 = F.col("theta") * F.col("theta")
    weight = theta2 / (1 + F.col("n") * theta2)
    m = len(stats.cols) + 1
    grid = stats.by_size.withColumn("theta", F.explode(F.array(*[F.lit(float(t)) for t in thetas])))
    rows = grid.groupBy("theta").agg(
        F.sum(F.col("groups") * F.log1p(F.col("n") * theta2)).alias("logdet"),
        *[F.sum(weight * F.col(f"b_{i}_{j}")).alias(f"w_{i}_{j}") for i, j in _names(m)]).collect()
    return {r["theta"]: (r["logdet"], stats.total - _square(r, "w", m)) for r in rows}


def _solve(n: int, logdet: float, s: np.ndarray) -> tuple[float, np.ndarray, float]:
    """Deviance, the coefficients that minimise it, and the residual sum of squares."""
    beta = np.linalg.solve(s[:-1, :-1], s[:-1, -1])
    rss = float(s[-1, -1] - beta @ s[:-1, -1])
    return logdet + n * (1 + math.log(2 * math.pi * rss / n)), beta, rss


def fit_models(stats: MixedStatistics, models: Mapping[str, tuple[str, Sequence[str]]]) -> dict[str, MixedModel]:
    """Fit ``{name: (y, xs)}``, each ``y ~ xs + (1 | group)``, from the statistics; no pass over the data."""
    for _, xs in models.values():
        if stats.n <= len(xs) + 2:
            raise ValueError("too few complete rows for the model")
    at = {name: [stats.cols.index(c) for c in (*xs, y)] for name, (y, xs) in models.items()}
    pick = {name: [0, *[i + 1 for i in own]] for name, own in at.items()}
    grids = {name: FIRST_GRID for name in models}
    best: dict[str, tuple] = {}
    for _ in range(MOST_ROUNDS):
        found = _profiles(stats, sorted({t for grid in grids.values() for t in grid}))
        for name, grid in list(grids.items()):
            tried = []
            for theta in grid:
                logdet, s = found[theta]
                s = s[np.ix_(pick[name], pick[name])]
                tried.append((*_solve(stats.n, logdet, s), theta, s))
            k = min(range(len(tried)), key=lambda i: tried[i][0])
            if name not in best or tried[k][0] < best[name][0]:
                best[name] = tried[k]
            low, high = grid[max(k - 1, 0)], grid[min(k + 1, len(grid) - 1)]
            if high - low <= PRECISION * (1 + low):
                del grids[name]
            else:
                grids[name] = tuple(float(t) for t in np.linspace(low, high, POINTS))
        if not grids:
            break
    return {name: _model(stats, y, list(xs), at[name], pick[name], best[name]) for name, (y, xs) in models.items()}


def _model(stats: MixedStatistics, y: str, xs: list[str], at: list[int], pick: list[int], found: tuple) -> MixedModel:
    dev, beta, rss, theta, s = found
    n, total = stats.n, stats.total[np.ix_(pick, pick)]
    center, scale = stats.center[at], stats.scale[at]
    # back to the original units: y = my + sy (b0 + sum b_i (x_i - m_i) / s_i)
    sy, my = scale[-1], center[-1]
    back = np.zeros((len(xs) + 1, len(xs) + 1))
    back[0, 0] = sy
    for i in range(len(xs)):
        back[i + 1, i + 1] = sy / scale[i]
        back[0, i + 1] = -sy * center[i] / scale[i]
    estimates = back @ beta
    estimates[0] += my
    variance = float(rss / n)
    cov = back @ (variance * np.linalg.inv(s[:-1, :-1])) @ back.T
    fixed = total[:-1, :-1]
    mean_fit = (fixed[0] @ beta) / n
    var_fixed = float((beta @ fixed @ beta - n * mean_fit**2) / (n - 1) * sy**2)
    return MixedModel(
        y=y, xs=tuple(xs), group=stats.group, n=n, groups=stats.groups, theta=theta,
        deviance=float(dev + 2 * n * math.log(sy)), var_group=float(theta**2 * variance * sy**2),
        var_residual=float(variance * sy**2), terms=("(Intercept)", *xs), estimates=tuple(map(float, estimates)),
        std_errors=tuple(float(v) for v in np.sqrt(np.diag(cov))), var_fixed=var_fixed)


def fit_mixed(stats: MixedStatistics, y: str, xs: Sequence[str]) -> MixedModel:
    return fit_models(stats, {"model": (y, xs)})["model"]


def mixed_intercept(df: DataFrame, y: str, xs: Sequence[str], group: str) -> MixedModel:
    """Fit one model. To compare models, reduce the data once with ``mixed_statistics``."""
    return fit_mixed(mixed_statistics(df, [*xs, y], group), y, xs)


FITS_SCHEMA = ("model string, y string, xs array<string>, by string, n bigint, n_params int, deviance double, "
               "var_fixed double, var_group double, var_residual double")


def fits_table(spark: SparkSession, fits: Mapping[str, MixedModel]) -> DataFrame:
    """One row per fitted model, for tests and R² of any number of models as columns."""
    return spark.createDataFrame([(name, m.y, list(m.xs), m.group, m.n, m.n_params, m.deviance, m.var_fixed, m.var_group, m.var_residual)
                                  for name, m in fits.items()], FITS_SCHEMA)


def lr_tests(fits: DataFrame, pairs: DataFrame) -> DataFrame:
    """Likelihood-ratio test of each pair (``small``, ``large``) of nested models; raises at run time if a pair is none."""
    sides = [fits.select(*[F.col(c).alias(f"{side}_{c}") for c in fits.columns]) for side in ("small", "large")]
    both = pairs.join(sides[0], F.col("small") == F.col("small_model")).join(sides[1], F.col("large") == F.col("large_model"))
    alike = F.col("small_n") == F.col("large_n")
    nested = ((F.col("small_y") == F.col("large_y")) & (F.col("small_by") == F.col("large_by"))
              & (F.size(F.array_except("small_xs", "large_xs")) == 0) & (F.col("small_n_params") < F.col("large_n_params")))
    statistic = F.when(alike & nested, F.greatest(F.col("small_deviance") - F.col("large_deviance"), F.lit(0.0))).otherwise(
        F.raise_error(F.when(alike, "models are not nested").otherwise("models use different rows")))
    tested = both.select("small", "large", statistic.alias("statistic"), (F.col("large_n_params") - F.col("small_n_params")).cast("int").alias("df"))
    return tested.withColumn("p_value", chi2_tail_column(F.col("statistic"), F.col("df")))


def mixed_r2s(fits: DataFrame) -> DataFrame:
    """Marginal and conditional R² of each model."""
    total = F.col("var_fixed") + F.col("var_group") + F.col("var_residual")
    return fits.select("model", (F.col("var_fixed") / total).alias("r2_marginal"), ((F.col("var_fixed") + F.col("var_group")) / total).alias("r2_conditional"))


@dataclass(frozen=True)
class LikelihoodRatio:
    statistic: float
    df: int
    p_value: float


def lr_test(small: MixedModel, large: MixedModel) -> LikelihoodRatio:
    """Likelihood-ratio test of nested models fitted on the same rows."""
    if small.n != large.n:
        raise ValueError(f"models use different rows: {small.n} and {large.n}")
    if (small.y, small.group) != (large.y, large.group) or not set(small.xs) < set(large.xs):
        raise ValueError("models are not nested")
    statistic = max(small.deviance - large.deviance, 0.0)
    df = large.n_params - small.n_params
    return LikelihoodRatio(statistic, df, chi2_tail(statistic, df))


def mixed_r2(model: MixedModel) -> tuple[float, float]:
    """Marginal and conditional R²."""
    total = model.var_fixed + model.var_group + model.var_residual
    return model.var_fixed / total, (model.var_fixed + model.var_group) / total


def profile_grid(by_size: DataFrame, thetas: Sequence[float]) -> DataFrame:
    """Profile deviance of a one-predictor model on a theta grid, all in Spark.

    ``by_size`` is ``size_statistics`` of the columns (x, y). Each size row is exploded over
    the grid, then summed per theta; the 2 x 2 system is solved in closed form.
    """
    theta2 = F.col("theta") * F.col("theta")
    weight = theta2 / (1 + F.col("n") * theta2)
    grid = by_size.withColumn("theta", F.explode(F.array(*[F.lit(float(t)) for t in thetas])))
    names = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
    s = grid.groupBy("theta").agg(
        F.sum(F.col("n") * F.col("groups")).alias("rows"),
        F.sum(F.col("groups") * F.log1p(F.col("n") * theta2)).alias("logdet"),
        *[F.sum(F.col(f"m_{i}_{j}") - weight * F.col(f"b_{i}_{j}")).alias(f"s{i}{j}") for i, j in names])
    det = F.col("s00") * F.col("s11") - F.col("s01") * F.col("s01")
    s = s.withColumns({"b0": F.try_divide(F.col("s11") * F.col("s02") - F.col("s01") * F.col("s12"), det),
                       "b1": F.try_divide(F.col("s00") * F.col("s12") - F.col("s01") * F.col("s02"), det)})
    rss = F.col("s22") - F.col("b0") * F.col("s02") - F.col("b1") * F.col("s12")
    n = F.col("rows")
    return s.select("theta", "b0", "b1",
                    (F.col("logdet") + n * (1 + F.log(2 * math.pi * rss / n))).alias("deviance"))
