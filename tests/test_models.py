import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialweave.models import linear, mixed, ranks, smooth, tails
from trialweave.models.tails import chi2_tail, t_tail

# Published base-running times, three methods by 22 players.
BASE_RUNNING = """5.40 5.50 5.55 5.85 5.70 5.75 5.20 5.60 5.50 5.55 5.50 5.40 5.90 5.85 5.70 5.45 5.55 5.60 5.40 5.40 5.35
5.45 5.50 5.35 5.25 5.15 5.00 5.85 5.80 5.70 5.25 5.20 5.10 5.65 5.55 5.45 5.60 5.35 5.45 5.05 5.00 4.95 5.50 5.50 5.40
5.45 5.55 5.50 5.55 5.55 5.35 5.45 5.50 5.55 5.50 5.45 5.25 5.65 5.60 5.40 5.70 5.65 5.55 6.30 6.30 6.25"""


def test_chi_square_tail():
    assert chi2_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert chi2_tail(5.991464547107979, 2) == pytest.approx(0.05)
    assert chi2_tail(7.814727903251179, 3) == pytest.approx(0.05)
    assert chi2_tail(18.307038053275146, 10) == pytest.approx(0.05)
    assert chi2_tail(0.0, 4) == 1.0
    with pytest.raises(ValueError):
        chi2_tail(1.0, 0)


def test_t_tail(spark):
    # published 97.5 % points, the normal one for very many degrees of freedom
    points = [(12.706204736, 1, 0.05), (-4.302652730, 2, 0.05), (2.228138852, 10, 0.05), (1.983971519, 100, 0.05),
              (1.959963985, 10**12, 0.05), (0.0, 7, 1.0), (1e9, 10**12, 0.0)]
    df = spark.createDataFrame(points, "t double, df bigint, p double").withColumn("got", t_tail(F.col("t"), F.col("df")))
    assert all(r.got == pytest.approx(r.p, abs=1e-8) for r in df.collect())
    none = spark.createDataFrame([(1.0, 0), (None, 4)], "t double, df bigint")
    assert [r[0] for r in none.select(t_tail(F.col("t"), F.col("df"))).collect()] == [None, None]


def base_running(spark):
    values = [float(v) for v in BASE_RUNNING.split()]
    return spark.createDataFrame([(i // 3, "abc"[i % 3], v) for i, v in enumerate(values)], "player int, method string, t double")


def test_friedman_published(spark):
    r = ranks.friedman(base_running(spark), "t", "method", "player")
    assert (round(r.statistic, 3), r.df, r.blocks, round(r.p_value, 4)) == (11.143, 2, 22, 0.0038)


def test_friedman_monotone_and_blocks(spark):
    df = base_running(spark)
    squared = df.withColumn("t", F.exp("t"))
    assert ranks.friedman(squared, "t", "method", "player") == ranks.friedman(df, "t", "method", "player")
    holes = df.where("not (player = 3 and method = 'a')")
    with pytest.raises(ValueError, match="lacks"):
        ranks.friedman(holes, "t", "method", "player")
    assert ranks.friedman(holes, "t", "method", "player", drop_incomplete=True).blocks == 21
    with pytest.raises(ValueError, match="more than one"):
        ranks.friedman(df.union(df.limit(1)), "t", "method", "player")
    with pytest.raises(ValueError, match="tied"):
        ranks.friedman(df.withColumn("t", F.lit(1.0)), "t", "method", "player")


def test_average_ranks(spark):
    df = spark.createDataFrame([(1, v) for v in (3.0, 1.0, 3.0, 2.0)], "b int, y double")
    assert sorted((r.y, r["rank"]) for r in ranks.average_ranks(df, "y", "b").collect()) == [
        (1.0, 1.0), (2.0, 2.0), (3.0, 3.5), (3.0, 3.5)]


@pytest.fixture(scope="module")
def grouped():
    """Twelve groups of one to eight rows."""
    rng = random.Random(11)
    rows = []
    for g, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 8, 3, 1, 4]):
        u = rng.gauss(0, 0.7)
        for _ in range(n):
            x, z = 100 + rng.random(), float(rng.random() > 0.5)
            rows.append((g, x, z, 1 + 2 * (x - 100) - 0.5 * z + u + rng.gauss(0, 0.3)))
    return rows


def dense_deviance(rows, theta, xs):
    g = np.array([r[0] for r in rows])
    X = np.column_stack([np.ones(len(rows)), *[np.array([r[1 + i] for r in rows]) for i in xs]])
    y = np.array([r[3] for r in rows])
    V = np.eye(len(rows)) + theta**2 * (g[:, None] == g[None, :])
    W = np.linalg.inv(V)
    b = np.linalg.solve(X.T @ W @ X, X.T @ W @ y)
    r = y - X @ b
    n = len(rows)
    return np.linalg.slogdet(V)[1] + n * (1 + math.log(2 * math.pi * (r @ W @ r) / n)), b


def test_mixed_model_equals_dense_fit(spark, grouped):
    df = spark.createDataFrame(grouped, "g int, x double, z double, y double")
    fits = {}
    for xs in ([], [0], [0, 1]):
        m = mixed.mixed_intercept(df, "y", [["x", "z"][i] for i in xs], "g")
        dev, b = dense_deviance(grouped, m.theta, xs)
        assert m.deviance == pytest.approx(dev, abs=1e-6)
        assert m.estimates == pytest.approx(b, rel=1e-6)
        for t in (0.0, m.theta * 0.9, m.theta * 1.1, 5.0):
            assert m.deviance <= dense_deviance(grouped, t, xs)[0] + 1e-9
        fits[len(xs)] = m
    test = mixed.lr_test(fits[0], fits[1])
    assert test.df == 1 and test.p_value == pytest.approx(math.erfc(math.sqrt(test.statistic / 2)))
    assert mixed.lr_test(fits[0], fits[2]).df == 2
    assert fits[2].aic == pytest.approx(fits[2].deviance + 10) and fits[2].n == len(grouped)
    marginal, conditional = mixed.mixed_r2(fits[2])
    X = np.array([[1, r[1], r[2]] for r in grouped])
    vf = np.var(X @ np.array(fits[2].estimates), ddof=1)
    assert marginal == pytest.approx(vf / (vf + fits[2].var_group + fits[2].var_residual))
    assert marginal < conditional < 1
    assert fits[2].coefficients(spark).count() == 3


def test_mixed_model_boundary_and_errors(spark):
    # groups with equal means: no group variance
    df = spark.createDataFrame([(g, v, float(i)) for g in range(4) for i, v in enumerate((1.0, -1.0, 2.0, -2.0))],
                               "g int, y double, x double")
    null = mixed.mixed_intercept(df, "y", [], "g")
    assert null.theta == 0.0 and null.var_group == 0.0 and null.var_residual == pytest.approx(2.5)
    short = mixed.mixed_intercept(df.withColumn("x", F.when(F.col("x") > 0, F.col("x"))), "y", ["x"], "g")
    with pytest.raises(ValueError, match="different rows"):
        mixed.lr_test(null, short)
    same = mixed.mixed_intercept(df, "y", ["x"], "g")
    with pytest.raises(ValueError, match="nested"):
        mixed.lr_test(same, null)
    with pytest.raises(ValueError, match="too few"):
        mixed.mixed_intercept(df.limit(1), "y", [], "g")


def test_profile_grid(spark, grouped):
    df = spark.createDataFrame(grouped, "g int, x double, z double, y double").withColumn("x", F.col("x") - 100)
    stats = mixed.size_statistics(mixed.complete_rows(df, ["x", "y"], "g"), ["x", "y"], "g")
    shifted = [(g, x - 100, z, y) for g, x, z, y in grouped]
    for r in mixed.profile_grid(stats, [0.0, 0.5, 2.0, 5.0]).collect():
        dev, b = dense_deviance(shifted, r.theta, [0])
        assert r.deviance == pytest.approx(dev, abs=1e-8) and (r.b0, r.b1) == pytest.approx(tuple(b))


def test_regression_agrees_with_library(spark):
    rng = random.Random(3)
    rows = [(x, 2 * x + 1 + rng.gauss(0, 0.1)) for x in (rng.random() for _ in range(40))] + [(None, 1.0)]
    df = spark.createDataFrame(rows, "x double, y double")
    s = linear.ols_summary(df, "y", "x").first()
    table = {r.term: r for r in linear.linear_model(df, "y", ["x"]).collect()}
    assert s.slope == pytest.approx(table["x"].estimate) and s.intercept == pytest.approx(table["(Intercept)"].estimate)
    assert s.se_slope == pytest.approx(table["x"].std_error) and s.t_intercept == pytest.approx(table["(Intercept)"].t_value)
    assert s.r2 == pytest.approx(table["x"].r2) and s.df_residual == table["x"].df_residual == 38
    assert table["x"].p_value < 1e-10 and s.p_slope < 1e-10
    weak = df.withColumn("y", F.col("y") - 2 * F.col("x"))
    flat, table = linear.ols_summary(weak, "y", "x").first(), {r.term: r for r in linear.linear_model(weak, "y", ["x"]).collect()}
    assert flat.p_slope == pytest.approx(table["x"].p_value) and flat.p_intercept == pytest.approx(table["(Intercept)"].p_value, abs=1e-12)
    by = linear.ols_by(df, "y", "x", []).first()
    assert (by.slope, by.n) == (pytest.approx(s.slope), 40)


def test_lines(spark):
    df = spark.createDataFrame([("a", 0.1, 1.0), ("a", 0.3, 2.0), ("b", 0.5, 4.0), ("b", 0.5, 6.0), ("b", None, 1.0)],
                               "k string, x double, y double")
    line = linear.fit_line(df, "y", "x", ["k"])
    a = sorted((round(r.x, 6), round(r.y, 6)) for r in line.where("k = 'a'").collect())
    assert len(a) == 21 and a[0] == (0.1, 1.0) and a[-1] == (0.3, 2.0)
    assert [(r.x, r.y) for r in line.where("k = 'b'").collect()] == [(0.5, 5.0)]
    unit = linear.fit_line(df, "y", "x", ["k"], grid="unit").where("k = 'a'").orderBy("x").collect()
    assert len(unit) == 100 and unit[0].x == 0.01 and unit[-1].x == 1.0
    stacked = linear.stack_curves({"one": line, "two": line.limit(2)})
    assert stacked.groupBy("study").count().count() == 2
    with pytest.raises(ValueError):
        linear.fit_line(df, "y", "x", ["k"], grid="other")


def test_pairwise(spark):
    df = spark.createDataFrame([("realbci", 0.97, -0.11), ("kiwisur", 0.72, -0.03)], "study string, s double, i double")
    pairs = spark.createDataFrame([("realbci", "kiwisur")], "a string, b string")
    out = {r.metric: (round(r.difference, 6), round(r.perc_change, 4)) for r in
           linear.pairwise_diff(df, "study", ["s", "i"], pairs).collect()}
    assert out == {"s": (0.25, 25.7732), "i": (-0.08, -266.6667)}


def line_pass(x, y, span, flat):
    """One pass over sorted x, window by window."""
    n = len(x)
    k = max(2, math.floor(0.5 * span * n + 0.5))
    fit = np.empty(n)
    for j in range(n):
        if 2 * k + 1 > n:
            low, high = 0, n
        else:
            c = min(max(j, k), n - k - 1)
            low, high = c - k, c + k + 1
        wx, wy = x[low:high], y[low:high]
        var = ((wx - wx.mean()) ** 2).sum()
        slope = ((wx - wx.mean()) * (wy - wy.mean())).sum() / var if var > flat else 0.0
        fit[j] = wy.mean() + slope * (x[j] - wx.mean())
    for v in np.unique(x):
        fit[x == v] = fit[x == v].mean()
    return fit


@pytest.mark.parametrize("pieces", [False, True])
def test_smoother_against_brute_force(spark, pieces):
    rng = random.Random(8)
    rows = []
    for k, n, levels in (("a", 90, 40), ("b", 7, 20), ("c", 60, 3), ("d", 12, 1)):
        rows += [(k, rng.randrange(levels) / levels, rng.random(), i) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, x double, y double, i int")
    got = {(r.k, r.x): r.y for r in smooth.running_line_smooth(df, "y", "x", ["k"], "i", pieces=pieces).collect()}
    want = {}
    for k in "abcd":
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[3]))
        x, y = np.array([r[1] for r in mine]), np.array([r[2] for r in mine])
        n = len(x)
        low, high = max(n // 4, 1) - 1, min(3 * max(n // 4, 1) if n >= 4 else 1, n) - 1
        scale = x[high] - x[low]
        while scale <= 0 and (high < n - 1 or low > 0):
            high, low = min(high + 1, n - 1), max(low - 1, 0)
            scale = x[high] - x[low]
        flat = (1e-3 * scale) ** 2
        out = line_pass(x, line_pass(x, y, 0.5, flat), 0.05, flat)
        want |= {(k, v): o for v, o in zip(x, out)}
    assert got.keys() == want.keys()
    for key, value in want.items():
        assert got[key] == pytest.approx(value, abs=1e-9), key


def plain_lines(x, y, span, flat):
    """Running line with leave-one-out residuals, and its average over tied x."""
    n, k = len(x), max(2, int(np.floor(0.5 * span * len(x) + 0.5)))
    fit, left = np.empty(n), np.empty(n)
    for j in range(n):
        c = max(k, min(n - 1 - k, j))
        part = slice(0, n) if 2 * k + 1 > n else slice(c - k, c + k + 1)
        mx, my = x[part].mean(), y[part].mean()
        var = ((x[part] - mx) ** 2).sum()
        slope = ((x[part] - mx) * (y[part] - my)).sum() / var if var > flat else 0.0
        fit[j] = my + slope * (x[j] - mx)
        hold = 1 / len(x[part]) + ((x[j] - mx) ** 2 / var if var > flat else 0.0)
        left[j] = abs(y[j] - fit[j]) / (1 - hold) if 1 - hold > 1e-12 else 0.0
    return np.array([fit[x == v].mean() for v in x]), left


@pytest.mark.parametrize("bass", [0, 5, 9.5])
def test_super_smoother_against_brute_force(spark, bass):
    rng = random.Random(21)
    rows = [("a", (v := rng.random() * 6), math.sin(v) * (1 if v < 3 else 4) + rng.gauss(0, 0.3), i) for i in range(160)]
    rows += [("b", rng.randrange(25) / 25, rng.random(), i) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, x double, y double, i int")
    got = {(r.k, r.x): r.y for r in smooth.running_line_smooth(df, "y", "x", ["k"], "i", bass=bass).collect()}
    for k in "ab":
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[3]))
        x, y = np.array([r[1] for r in mine]), np.array([r[2] for r in mine])
        n = len(x)
        flat = (1e-3 * (x[3 * (n // 4) - 1] - x[n // 4 - 1])) ** 2
        lines = [plain_lines(x, y, span, flat) for span in smooth.SPANS]
        errors = [plain_lines(x, left, 0.2, flat)[0] for _, left in lines]
        span = np.array([smooth.SPANS[int(np.argmin(e))] for e in zip(*errors)])
        for j in range(n):
            least, last = min(e[j] for e in errors), errors[2][j]
            if bass and 0 < least < last:
                span[j] += (0.5 - span[j]) * max(1e-7, least / last) ** (10 - bass)
        span = np.clip(plain_lines(x, span, 0.2, flat)[0], 0.05, 0.5)
        value = np.array([np.interp(s, smooth.SPANS, [line[j] for line, _ in lines]) for j, s in enumerate(span)])
        for v, out in zip(x, plain_lines(x, value, 0.05, flat)[0]):
            assert got[k, v] == pytest.approx(out, abs=1e-8), (k, v)
    with pytest.raises(ValueError):
        smooth.running_line_smooth(df, "y", "x", ["k"], "i", bass=11)


def test_chi_square_tail_as_a_column(spark):
    cases = [(x, df) for x in (0.0, 1e-6, 0.3, 1.0, 3.84, 11.0, 40.0, 200.0) for df in (1, 2, 3, 4, 5, 8, 9, 30, 101)]
    got = spark.createDataFrame(cases, "x double, df int").withColumn("p", tails.chi2_tail_column(F.col("x"), F.col("df"))).collect()
    for r in got:
        assert r.p == pytest.approx(tails.chi2_tail(r.x, r.df), rel=1e-9, abs=1e-15), r
    assert spark.sql("select 1.0D x, 0 df").select(tails.chi2_tail_column(F.col("x"), F.col("df"))).first()[0] is None


def test_tests_and_r2_of_many_models_as_columns(spark, grouped):
    df = spark.createDataFrame(grouped, "g int, x double, z double, y double")
    stats = mixed.mixed_statistics(df, ["x", "z", "y"], "g")
    models = {"none": ("y", []), "x": ("y", ["x"]), "both": ("y", ["x", "z"])}
    fits = mixed.fit_models(stats, models)
    for name, (y, xs) in models.items():
        alone = mixed.fit_mixed(stats, y, xs)
        assert alone.deviance == pytest.approx(fits[name].deviance) and alone.estimates == pytest.approx(fits[name].estimates, rel=1e-5)
    table = mixed.fits_table(spark, fits)
    pairs = spark.createDataFrame([("none", "x"), ("none", "both"), ("x", "both")], "small string, large string")
    for r in mixed.lr_tests(table, pairs).collect():
        want = mixed.lr_test(fits[r.small], fits[r.large])
        assert (r.statistic, r.df) == (pytest.approx(want.statistic), want.df) and r.p_value == pytest.approx(want.p_value)
    for r in mixed.mixed_r2s(table).collect():
        assert (r.r2_marginal, r.r2_conditional) == pytest.approx(mixed.mixed_r2(fits[r.model]))
    with pytest.raises(Exception, match="not nested"):
        mixed.lr_tests(table, spark.createDataFrame([("x", "none")], "small string, large string")).collect()
