"""Super smoother: running lines of three spans, a span chosen for each point by its residuals, and a narrow pass.

Each running line fits a line through the 2k + 1 nearest ranks of every row and averages the fit over tied x. The
residuals leave the row itself out. ``bass`` (0 to 10) pulls the chosen spans towards the widest; at 10 all are the widest, and two
passes are left. A row that its window's line must pass through counts as fitted without error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.operators.scans import join_null_safe, ordered_scan, stored

# Spans of the published smoother, and the share of the x scale under which
# a window counts as having a single x.
NARROW_SPAN, MIDDLE_SPAN, WIDE_SPAN, FLAT = 0.05, 0.2, 0.5, 1e-3
SPANS, MOST_BASS, LEAST_RATIO = (NARROW_SPAN, MIDDLE_SPAN, WIDE_SPAN), 10, 1e-7


def _with_ranks(df: DataFrame, y: str, x: str, tie: str, keys: list[str], pieces) -> DataFrame:
    """Number the rows by x, centre x and y, and find the x scale of each group.

    The scale is the distance between the quarter ranks, widened rank by rank on both
    sides while it is zero.
    """
    rn, xs, n = F.col("_rn"), F.col(x), F.col("_n")

    def build(rows, scan):
        rows = scan.running_sum(rows, _rn=F.lit(1))
        rows = scan.whole(rows, _n=F.count(F.lit(1)), _mx=F.avg(x), _my=F.avg(y))
        quarter = F.greatest(F.floor(n / 4), F.lit(1))
        upper = F.least(F.greatest(3 * F.floor(n / 4), F.lit(1)), n)
        rows = scan.whole(rows, _xi=F.max(F.when(rn == quarter, xs)), _xj=F.max(F.when(rn == upper, xs)))
        low, high = F.col("_xi"), F.col("_xj")
        rows = scan.whole(rows, _above=F.min(F.when(xs > high, xs)), _above_rn=F.min(F.when(xs > high, rn)),
                          _below=F.max(F.when(xs < low, xs)), _below_rn=F.max(F.when(xs < low, rn)))
        up = F.coalesce(F.col("_above_rn") - upper, n + 1)
        down = F.coalesce(quarter - F.col("_below_rn"), n + 1)
        scale = (F.when(high > low, high - low)
                 .when(up < down, F.col("_above") - low).when(down < up, high - F.col("_below"))
                 .otherwise(F.col("_above") - F.col("_below")))
        return rows.withColumns({"_flat": F.pow(F.lit(FLAT) * F.coalesce(scale, F.lit(0.0)), F.lit(2.0)),
                                 "_x": xs - F.col("_mx"), "_y": F.col(y) - F.col("_my")}).drop(
            "_mx", "_xi", "_xj", "_above", "_above_rn", "_below", "_below_rn")

    return ordered_scan(df, keys, [x, tie], build, pieces)


def _half_width(span: float) -> Column:
    return F.greatest(F.lit(2), F.floor(0.5 * span * F.col("_n") + 0.5))


def _pass(df: DataFrame, x: str, tie: str, fits: dict[str, tuple[str, float]], keys: list[str], pieces, residuals: bool = False) -> DataFrame:
    """One pass of running lines: ``fits`` is ``{out: (value, span)}``; ``residuals`` adds ``<out>_r``.

    A window is the difference of two running sums, looked up by rank with two equi-joins for each span,
    so it costs the same for any width.
    """
    px, values = F.col("_x"), sorted({value for value, _ in fits.values()})
    sums = {"_sx": px, "_sxx": px * px}
    for i, value in enumerate(values):
        sums |= {f"_s{i}": F.col(value), f"_sx{i}": px * F.col(value)}
    # stored, because the lookups below read it once for each edge
    base = stored(ordered_scan(df, keys, [x, tie], lambda part, scan: scan.running_sum(part, **sums), pieces))
    prefix, rows, n = base.select(*keys, "_rn", *sums), base.drop(*sums), F.col("_n")
    for span in sorted({span for _, span in fits.values()}):
        k = _half_width(span)
        centre = F.greatest(k + 1, F.least(n - k, F.col("_rn")))
        whole = 2 * k + 1 > n
        rows = rows.withColumns({
            "_from": F.when(whole, 0).otherwise(centre - k - 1).cast("bigint"),
            "_to": F.when(whole, n).otherwise(centre + k).cast("bigint")})
        for edge, mark in (("_to", "h"), ("_from", "l")):
            side = prefix.withColumnsRenamed({"_rn": edge, **{s: f"{s}{mark}" for s in sums}})
            rows = join_null_safe(rows, side, [*keys, edge])
        m = (F.col("_to") - F.col("_from")).cast("double")
        total = {s: F.col(f"{s}h") - F.coalesce(F.col(f"{s}l"), F.lit(0.0)) for s in sums}
        mean_x = total["_sx"] / m
        var = total["_sxx"] - m * mean_x * mean_x
        made = {}
        for out, (value, own) in fits.items():
            if own == span:
                i = values.index(value)
                mean_y = total[f"_s{i}"] / m
                slope = F.when(var > F.col("_flat"), (total[f"_sx{i}"] - m * mean_x * mean_y) / var).otherwise(0.0)
                fit = mean_y + slope * (px - mean_x)
                made[f"_fit_{out}"] = fit
                if residuals:
                    hold = 1 / m + F.when(var > F.col("_flat"), (px - mean_x) * (px - mean_x) / var).otherwise(0.0)
                    made[f"{out}_r"] = F.when(1 - hold > 1e-12, F.abs(F.col(value) - fit) / (1 - hold)).otherwise(0.0)
        rows = rows.withColumns(made).drop("_from", "_to", *[f"{s}{mark}" for s in sums for mark in "hl"])
    tied = ordered_scan(rows, [*keys, x], [tie],
                        lambda part, scan: scan.whole(part, **{out: F.avg(f"_fit_{out}") for out in fits}), pieces)
    return tied.drop(*[f"_fit_{out}" for out in fits])


def _chosen_span(bass: float) -> Column:
    """The span with the least smoothed residual, pulled towards the widest where that is little worse."""
    errors = [F.col(f"_e{i}") for i in range(len(SPANS))]
    least, last = F.least(*errors), errors[-1]
    span = F.lit(SPANS[-1])
    for error, own in reversed(list(zip(errors[:-1], SPANS[:-1]))):
        span = F.when(error == least, F.lit(own)).otherwise(span)
    if not bass:
        return span
    pull = F.pow(F.greatest(F.lit(LEAST_RATIO), least / last), F.lit(float(MOST_BASS - bass)))
    return F.when((least < last) & (least > 0), span + (F.lit(WIDE_SPAN) - span) * pull).otherwise(span)


def _between_spans() -> Column:
    """The fit at a span between those of the three fits."""
    span = F.greatest(F.lit(NARROW_SPAN), F.least(F.lit(WIDE_SPAN), F.col("_span")))
    off = span - MIDDLE_SPAN
    below, above = -off / (MIDDLE_SPAN - NARROW_SPAN), off / (WIDE_SPAN - MIDDLE_SPAN)
    return F.when(off < 0, (1 - below) * F.col("_f1") + below * F.col("_f0")).otherwise((1 - above) * F.col("_f1") + above * F.col("_f2"))


def running_line_smooth(df: DataFrame, y: str, x: str, keys: Sequence[str], tie: str,
                        pieces: bool = True, bass: float = MOST_BASS) -> DataFrame:
    """Smoothed curve per group as rows ``(keys, x, y)``, one per distinct x.

    Rows with a missing value drop out. ``tie`` is a unique column that orders equal x.
    """
    if not 0 <= bass <= MOST_BASS:
        raise ValueError(f"bass must be from 0 to {MOST_BASS}, not {bass!r}")
    keys = list(keys)
    rows = df.select(*keys, F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y), tie)
    rows = stored(rows.dropna(subset=[x, y]))
    rows = stored(_with_ranks(rows, y, x, tie, keys, pieces))
    if bass == MOST_BASS:
        rows = _pass(rows, x, tie, {"_value": ("_y", WIDE_SPAN)}, keys, pieces)
    else:
        rows = _pass(rows, x, tie, {f"_f{i}": ("_y", span) for i, span in enumerate(SPANS)}, keys, pieces, residuals=True)
        rows = _pass(rows, x, tie, {f"_e{i}": (f"_f{i}_r", MIDDLE_SPAN) for i in range(len(SPANS))}, keys, pieces)
        rows = _pass(rows.withColumn("_best", _chosen_span(bass)), x, tie, {"_span": ("_best", MIDDLE_SPAN)}, keys, pieces)
        rows = rows.withColumn("_value", _between_spans())
    rows = _pass(rows, x, tie, {"_narrow": ("_value", NARROW_SPAN)}, keys, pieces)
    return rows.groupBy(*keys, F.col(x).alias("x")).agg((F.max("_narrow") + F.max("_my")).alias("y"))
