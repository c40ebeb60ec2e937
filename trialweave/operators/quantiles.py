"""Exact quantiles of groups of any size by radix selection.

A number becomes a 64-bit pattern that sorts as the number does. Values are counted by group and pattern, these
counts are rolled up to the leading 48, 32 and 16 bits, and each wanted rank is followed down: the 16-bit digit
that holds it, then the next 16 bits below that prefix, and so on. A prefix has at most 65,536 digits, so no
window and no join key ever sees more rows than one digit table, whatever the size of a group. All groups,
probabilities and both ranks of an interpolation go down together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.operators.scans import stored

DIGIT_BITS, DIGITS = 16, 4
#: Parts of a group when its quantiles are joined back to its counted values.
SALTS = 32

# Layout of a double.
MANTISSA_BITS, LEAST_EXPONENT, BIAS = 52, -1022, 1023
INFINITE, NOT_A_NUMBER = 0x7FF0000000000000, 0x7FF8000000000000


def order_bits(value: Column) -> Column:
    """The bit pattern of a double as a long that sorts as the number does; both zeros are 0, not-a-number is last.

    Exponent and mantissa are found by exact arithmetic with powers of two.
    """
    x = value.cast("double")
    size = F.abs(x)
    two = F.lit(2.0)
    guess = F.greatest(F.floor(F.log2(size)).cast("int"), F.lit(LEAST_EXPONENT))
    # the logarithm may round across a power of two
    low = F.when(F.pow(two, guess) > size, guess - 1).when(F.pow(two, guess + 1) <= size, guess + 1).otherwise(guess)
    exponent = F.greatest(low, F.lit(LEAST_EXPONENT))
    scaled = size / F.pow(two, exponent)  # in [1, 2), below 1 for a denormal
    normal = F.when(scaled >= 1, 1).otherwise(0)
    mantissa = ((scaled - normal) * F.lit(2.0**MANTISSA_BITS)).cast("bigint")
    bits = (normal * (exponent + BIAS)).cast("bigint") * F.lit(1 << MANTISSA_BITS) + mantissa
    bits = F.when(size == 0, F.lit(0).cast("bigint")).when(size == F.lit(float("inf")), F.lit(INFINITE)).otherwise(bits)
    return F.when(F.isnan(x), F.lit(NOT_A_NUMBER)).when(x < 0, -bits).otherwise(bits)


def _prefix(level: int) -> Column:
    return F.shiftright("_bits", DIGIT_BITS * level)


def counted_values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per group (``_k``) and known value: ``_v``, its pattern ``_bits`` and its number ``_n``. Stored, as each level reads it."""
    group = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    rows = df.select(group.alias("_k"), F.col(value).alias("_v")).where("_v is not null")
    return stored(rows.groupBy("_k", "_v").agg(F.count(F.lit(1)).alias("_n")).withColumn("_bits", order_bits(F.col("_v"))))


def select_ranks(counted: DataFrame, probs: Sequence[float]) -> DataFrame:
    """``_k`` and, for each probability, ``_q<i>``: the interpolated value at rank p (n - 1)."""
    tables = {0: counted}
    for level in range(1, DIGITS):  # digit tables, each rolled up from the one below
        below = tables[level - 1].withColumn("_bits", F.shiftright("_bits", DIGIT_BITS))
        tables[level] = below.groupBy("_k", "_bits").agg(F.sum("_n").alias("_n"))

    top = tables[DIGITS - 1]
    whole = Window.partitionBy("_k")
    along = whole.orderBy("_bits").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    top = top.withColumns({"_upto": F.sum("_n").over(along), "_total": F.sum("_n").over(whole)})
    rank = [(F.col("_total") - 1) * F.lit(float(p)) for p in probs]
    wanted = F.array(*[F.struct(F.lit(2 * i + up).alias("i"), (F.ceil(r) if up else F.floor(r)).cast("bigint").alias("rank")) for i, r in enumerate(rank) for up in (0, 1)])
    inside = F.filter(wanted, lambda w: (w["rank"] < F.col("_upto")) & (w["rank"] >= F.col("_upto") - F.col("_n")))
    found = top.select("_k", "_bits", "_total", (F.col("_upto") - F.col("_n")).alias("_before"), F.explode(inside).alias("_w"))
    found = found.select("_k", F.col("_bits").alias("_cell"), "_total", F.col("_w.i").alias("_i"), (F.col("_w.rank") - F.col("_before")).alias("_rest"))

    for level in range(DIGITS - 2, -1, -1):
        cell = tables[level].withColumn("_cell", F.shiftright("_bits", DIGIT_BITS))
        order = ["_bits", "_v"] if level == 0 else ["_bits"]
        along = Window.partitionBy("_k", "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        want = found.groupBy("_k", "_cell", "_total").agg(F.collect_list(F.struct("_i", "_rest")).alias("_wants"))  # two a probability at most
        here = cell.join(want, ["_k", "_cell"]).withColumn("_upto", F.sum("_n").over(along))
        before = F.col("_upto") - F.col("_n")
        inside = F.filter("_wants", lambda w: (w["_rest"] < F.col("_upto")) & (w["_rest"] >= before))
        here = here.where(F.size(inside) > 0).withColumn("_w", F.explode(inside))
        left = (F.col("_w._rest") - before).alias("_rest")
        found = here.select("_k", F.col("_bits").alias("_cell"), "_total", F.col("_w._i").alias("_i"), left, *(["_v"] if level == 0 else []))

    def at(i: int) -> Column:
        return F.max(F.when(F.col("_i") == i, F.col("_v")))

    total = F.max("_total")
    share = [(total - 1) * F.lit(float(p)) - F.floor((total - 1) * F.lit(float(p))) for p in probs]
    def between(low: Column, high: Column, part: Column) -> Column:
        return F.when(low == high, low).otherwise(low + (high - low) * part)

    return found.groupBy("_k").agg(*[between(at(2 * i), at(2 * i + 1), s).alias(f"_q{i}") for i, s in enumerate(share)])


def _named(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(f"_k.k{i}").alias(k) for i, k in enumerate(keys)], *[c for c in df.columns if c != "_k"])


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float],
                    na: str = "propagate", pieces: bool = True) -> DataFrame:
    """Exact interpolated quantiles ``{name: probability}`` per group, with min and max.

    ``pieces=False`` states that groups are small by construction; each is then one aggregate.
    """
    ends = {"min_value": F.min(value), "max_value": F.max(value)}
    fine = F.lit(True) if na == "skip" else F.count(value) == F.count(F.lit(1))
    if not pieces:
        found = F.percentile(value, F.array(*[F.lit(float(p)) for p in probs.values()]))
        ends = {name: found[i] for i, name in enumerate(probs)} | ends
        return df.groupBy(*keys).agg(*[F.when(fine, a).alias(n) for n, a in ends.items()])
    group = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).alias("_k")
    whole = df.groupBy(group).agg(fine.alias("_fine"), *[F.when(fine, a).alias(n) for n, a in ends.items()])
    ranked = select_ranks(counted_values(df, keys, value), list(probs.values()))
    out = whole.join(ranked, "_k", "left").withColumns({n: F.when(F.col("_fine"), F.col(f"_q{i}")) for i, n in enumerate(probs)})
    return _named(out.select("_k", *probs, *ends), keys)


def box_stats(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Quartiles, whiskers at 1.5 times the quartile range, and outlier count per group.

    Exact; missing values are left out.
    """
    counted = counted_values(df, by, value)
    ranked = select_ranks(counted, [0.25, 0.5, 0.75])
    salted = ranked.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = counted.withColumn("_salt", F.pmod(F.xxhash64("_bits"), F.lit(SALTS)).cast("int")).join(salted, ["_k", "_salt"])
    q1, q3, v, n = (F.col(c) for c in ("_q0", "_q2", "_v", "_n"))
    inside = v.between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    out = rows.groupBy("_k").agg(
        F.sum(n).alias("n"), F.min(v).alias("min_value"), F.max("_q0").alias("q1"), F.max("_q1").alias("median_value"),
        F.max("_q2").alias("q3"), F.max(v).alias("max_value"), F.min(F.when(inside, v)).alias("whisker_low"),
        F.max(F.when(inside, v)).alias("whisker_high"), F.coalesce(F.sum(F.when(~inside, n)), F.lit(0)).alias("outliers"))
    return _named(out, by)
