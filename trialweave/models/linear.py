"""Simple and multiple linear regression, and lines predicted from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.functions.scalars import perc_change
from trialweave.models.tails import t_tail
from trialweave.operators.scans import join_null_safe

#: Grid points of a line that are made from one row at a time.
GRID_RUN = 1000


def ols_by(df: DataFrame, y: str, x: str, keys: Sequence[str]) -> DataFrame:
    """Slope, intercept, R² and row count per group; rows with a missing value drop out.

    One aggregation with running moments, so a group of any size is reduced in many tasks.
    """
    return df.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def ols_summary(df: DataFrame, y: str, x: str, keys: Sequence[str] = ()) -> DataFrame:
    """Estimates with standard errors, t values, two-sided p-values, R² and residual standard error."""
    sums = df.groupBy(*keys).agg(
        F.regr_count(y, x).alias("n"), F.regr_sxx(y, x).alias("_sxx"), F.regr_syy(y, x).alias("_syy"),
        F.regr_sxy(y, x).alias("_sxy"), F.regr_avgx(y, x).alias("_mx"), F.regr_avgy(y, x).alias("_my"))
    n, sxx = F.col("n"), F.col("_sxx")
    fitted = sums.withColumns({"slope": F.try_divide(F.col("_sxy"), sxx)})
    fitted = fitted.withColumns({
        "intercept": F.col("_my") - F.col("slope") * F.col("_mx"),
        "df_residual": n - 2,
        "_sse": F.greatest(F.lit(0.0), F.col("_syy") - F.col("slope") * F.col("_sxy")),
        "r2": F.try_divide(F.col("slope") * F.col("_sxy"), F.col("_syy"))})
    fitted = fitted.withColumn("sigma", F.sqrt(F.try_divide(F.col("_sse"), F.col("df_residual").cast("double"))))
    fitted = fitted.withColumns({
        "se_slope": F.try_divide(F.col("sigma"), F.sqrt(sxx)),
        "se_intercept": F.col("sigma") * F.sqrt(F.try_divide(F.lit(1.0), n.cast("double"))
                                                + F.try_divide(F.col("_mx") * F.col("_mx"), sxx))})
    fitted = fitted.withColumns({
        "t_slope": F.try_divide(F.col("slope"), F.col("se_slope")),
        "t_intercept": F.try_divide(F.col("intercept"), F.col("se_intercept"))})
    return fitted.withColumns({f"p_{term}": t_tail(F.col(f"t_{term}"), F.col("df_residual"))
                               for term in ("slope", "intercept")}).drop("_sxx", "_syy", "_sxy", "_mx", "_my", "_sse")


def linear_model(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """Coefficient table of a multiple regression, with p-values.

    Fitted by the library's normal-equation solver: one distributed pass, then a solve of
    the size of ``xs``. The library gives the intercept's figures last.
    """
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in (y, *xs)]).dropna()
    rows = VectorAssembler(inputCols=list(xs), outputCol="_x").transform(rows)
    fit = LinearRegression(featuresCol="_x", labelCol=y, solver="normal").fit(rows)
    s = fit.summary
    estimates = [*fit.coefficients, fit.intercept]
    table = [(term, float(b), float(se), float(t), float(p), float(s.r2), int(s.degreesOfFreedom))
             for term, b, se, t, p in zip([*xs, "(Intercept)"], estimates, s.coefficientStandardErrors,
                                          s.tValues, s.pValues)]
    return df.sparkSession.createDataFrame(
        table, "term string, estimate double, std_error double, t_value double, p_value double, "
               "r2 double, df_residual int")


def unit_grid_column(n: int = 100):
    """Array 1/n, 2/n, ..., 1."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: k / F.lit(float(n)))


def fit_line(df: DataFrame, y: str, x: str, keys: Sequence[str], grid: str = "observed") -> DataFrame:
    """Predicted line per group as rows ``(keys, x, y)``.

    ``grid="observed"``: steps of 0.01 over the observed range of ``x``, as many as it
    holds. ``grid="unit"``: 0.01 to 1.00. The grid is exploded from the coefficient row, so
    its size depends on the range and never on the number of rows. A group with a single x
    gets its mean.
    """
    if grid not in ("observed", "unit"):
        raise ValueError(f"grid must be 'observed' or 'unit', not {grid!r}")
    fits = df.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"), F.regr_avgy(y, x).alias("_my"),
        (F.min(x) * 100).alias("_from"), (F.max(x) * 100).alias("_to")).where(F.col("_my").isNotNull())
    if grid == "unit":
        lines = fits.withColumn("x", F.explode(unit_grid_column()))
    else:  # runs of points first, so that a wide range makes no long array
        steps = F.floor(F.col("_to") - F.col("_from") + F.lit(1e-10)).cast("bigint")
        begin = F.col("_run") * GRID_RUN
        lines = fits.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(steps / GRID_RUN).cast("bigint"))))
        lines = lines.withColumn("x", F.explode(F.sequence(begin, F.least(steps, begin + GRID_RUN - 1))))
        lines = lines.withColumn("x", (F.col("_from") + F.col("x")) / 100)
    return (lines
            .select(*keys, "x", F.coalesce(F.col("_a") + F.col("_b") * F.col("x"), F.col("_my")).alias("y")))


def stack_curves(curves: Mapping[str, DataFrame], label: str = "study") -> DataFrame:
    """Union curves by name, with the name of each as a column."""
    named = [df.withColumn(label, F.lit(name)) for name, df in curves.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def pairwise_diff(df: DataFrame, key: str, metrics: Sequence[str], pairs: DataFrame) -> DataFrame:
    """Difference and percentage change of each metric for the listed key pairs.

    ``pairs`` has the columns ``a`` and ``b``. The table is turned long, then looked up
    twice by (key, metric): one row per (pair, metric).
    """
    long = df.unpivot([key], list(metrics), "metric", "value")
    left = long.select(F.col(key).alias("a"), "metric", F.col("value").alias("value_a"))
    right = long.select(F.col(key).alias("b"), "metric", F.col("value").alias("value_b"))
    both = join_null_safe(pairs.join(left, "a"), right, ["b", "metric"], "inner")
    return both.withColumns({"difference": F.col("value_a") - F.col("value_b"),
                             "perc_change": perc_change("value_a", "value_b")})
