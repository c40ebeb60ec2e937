"""Mixing sources to target weights by pivotal dependent rounding. DataFrame functions only.

Each source gets a target in words; each of its documents is wanted target / size of the source times. The whole part is
taken as it is. Fractions are rounded in pairs: mass in words moves from one document to the other, by chance and without
bias, until one fraction is 0 or 1; the other goes on to the next pair. Buckets of a few hundred documents are folded at
once, and the fraction left of each bucket goes to the next level of a reduction tree, until one is left in each source.
That one takes its words in part, so that a source's taken words sum to its target.

Defined results: null text has size 0 and takes 0. Null sources are one source and come last. Empty tables give empty
results. Rows that repeat a doc_id, or have none, are documents of their own. Chance comes from hashes of doc_id, size, a
number among the rows equal in doc_id, source and size, and a seed. Such rows are alike in the result, so reruns agree, and any
number of rows with one id, or without one, spreads over all buckets. Only sizes are taken from texts, of any length. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.llm.common import hot_keys, known_key, split_join, stored, unit, words

WEIGHTS, BUDGET, MOST, SEED = (5.0, 2.0, 1.0), 1.5, 2.0, 20
BUCKET = 256
#: Equal rows that one task numbers at a time.
COPIES = 1 << 16
DONE = "array<struct<doc_id:{0},mark:bigint,size:bigint,whole:double,part:double>>"


def marked_rows(sized: DataFrame, seed: int, copies: int = COPIES) -> DataFrame:
    """The rows of `sized` (doc_id, source, size), each with a `mark`: equal rows are counted, then numbered in slices of `copies`."""
    same = stored(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("_n")))
    first = same.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("_n"), F.lit(copies)) - 1)))
    many = same.where(F.col("_n") > copies)
    slices = many.withColumn("_slice", F.explode(F.sequence(F.lit(1).cast("long"), F.floor((F.col("_n") - 1) / copies)))).repartition("_slice", "size")
    start = F.col("_slice") * copies
    more = slices.withColumn("_copy", F.explode(F.sequence(start, F.least(F.col("_n"), start + copies) - 1))).drop("_slice")
    return first.unionByName(more).withColumn("mark", F.xxhash64("doc_id", "size", "_copy", F.lit(seed))).drop("_n", "_copy")


def numbered(table: DataFrame, by: Sequence[Column]) -> DataFrame:
    """`rank` from 0 in the order of `by`: sorted over all tasks, then shifted by the counts of the tasks before."""
    at = stored(table.orderBy(*by).withColumn("_at", F.monotonically_increasing_id()))
    task = F.shiftright("_at", 33)
    tasks = at.groupBy(task.alias("_task")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = tasks.select("_task", before.alias("_before"))
    ranked = at.withColumn("_task", task).join(F.broadcast(shifts), "_task")
    return ranked.withColumn("rank", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_task", "_before")


def targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """`_source`, docs, source_size, target. What exceeds `most` times a size is shared again among the others by weight."""
    sums = sized.groupBy("_source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    turn = F.col("rank") % len(weights) + 1
    weighed = numbered(sums, [F.col("_source") == "", F.col("_source")]).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), turn.cast("int"))
    )
    table = stored(weighed.drop("rank"))
    total = float(table.agg(F.sum("source_size")).first()[0] or 0)
    top, level, full = F.col("source_size") * F.lit(float(most)), 0.0, -1
    wanted = min(budget, most) * total
    while True:  # each round fills at least one more source, or is the last
        reached = top <= F.col("weight") * F.lit(level)
        row = table.agg(F.sum(F.when(reached, top)), F.sum(F.when(~reached, F.col("weight"))), F.count_if(reached)).first()
        if row[2] == full or not row[1]:
            break
        full, level = row[2], max(0.0, wanted - (row[0] or 0.0)) / row[1]
    return table.select("_source", "docs", "source_size", F.least(top, F.col("weight") * F.lit(level)).alias("target"))


def _fold(doc_type: str, seed: int) -> str:
    """SQL of the fold of a bucket's items (doc_id, mark, size, whole, mass), 0 < mass < size, in their given order.

    State: `left`, the item not yet integral (mass -1: none), and `done`. With x words to give to the one, or y to the
    other, before one of the two is 0 or full, the first happens with probability y / (x + y).
    """
    item = f"struct<doc_id:{doc_type},mark:bigint,size:bigint,whole:double,mass:double>"
    none = f"CAST(named_struct('doc_id', NULL, 'mark', 0L, 'size', 0L, 'whole', 0D, 'mass', -1D) AS {item})"
    draw = f"(shiftrightunsigned(xxhash64(s.left.mark, i.mark, {seed}L), 11) / 9007199254740992D)"
    to_left, to_new = "least(s.left.size - s.left.mass, i.mass)", "least(s.left.mass, i.size - i.mass)"
    gives = f"{draw} * ({to_left} + {to_new}) < {to_new}"
    moved = f"CASE WHEN {gives} THEN {to_left} ELSE -{to_new} END"

    def with_mass(of: str, mass: str) -> str:
        return f"named_struct('doc_id', {of}.doc_id, 'mark', {of}.mark, 'size', {of}.size, 'whole', {of}.whole, 'mass', {mass})"

    def settled(of: str) -> str:  # 0 or full, within rounding
        return f"({of}.mass <= 1e-6 OR {of}.mass >= {of}.size - 1e-6)"

    def ended(of: str) -> str:
        return f"named_struct('doc_id', {of}.doc_id, 'mark', {of}.mark, 'size', {of}.size, 'whole', {of}.whole, 'part', round({of}.mass / {of}.size) * {of}.size)"

    pair = f"transform(array({moved}), m -> named_struct('a', {with_mass('s.left', 's.left.mass + m')}, 'b', {with_mass('i', 'i.mass - m')}))[0]"
    step = (
        f"transform(array({pair}), p -> named_struct("
        f"'left', CASE WHEN NOT {settled('p.a')} THEN p.a WHEN NOT {settled('p.b')} THEN p.b ELSE {none} END, "
        f"'done', concat(s.done, CASE WHEN {settled('p.a')} THEN array({ended('p.a')}) ELSE array() END, "
        f"CASE WHEN {settled('p.b')} THEN array({ended('p.b')}) ELSE array() END)))[0]"
    )
    first = "named_struct('left', i, 'done', s.done)"
    state = f"struct<left:{item},done:{DONE.format(doc_type)}>"
    start = f"CAST(named_struct('left', {none}, 'done', array()) AS {state})"
    return f"aggregate(items, {start}, (s, i) -> CAST(CASE WHEN s.left.mass < 0 THEN {first} ELSE {step} END AS {state}))"


def pivotal_mix(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most: float = MOST, seed: int = SEED, bucket: int = BUCKET,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target (of the source), taken (words, repeats counted)."""
    rows = docs.select(F.col(doc).alias("doc_id"), F.col(source).alias("source"), words(text).alias("size"))
    sized = stored(marked_rows(rows, seed).withColumn("_source", known_key("source")))
    doc_type = dict(sized.dtypes)["doc_id"]
    goals = stored(targets(sized, weights, budget, most))
    rows = split_join(sized, goals, "_source", hot_keys(goals, "_source", "docs"), "mark")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    wanted = F.col("size") * share
    whole = F.floor(share + 1e-12) * F.col("size")
    row = rows.withColumn("whole", whole.cast("double")).withColumn("mass", F.greatest(wanted - whole, F.lit(0.0)))
    open_ = (F.col("mass") > 1e-6) & (F.col("mass") < F.col("size") - 1e-6)
    pieces = F.greatest(F.ceil(F.col("docs") / bucket), F.lit(1))
    placed = row.select(
        "doc_id", "mark", "_source", "size", "whole", "mass", open_.alias("open"), F.pmod("mark", pieces).alias("bucket"),
    )
    settled = placed.where("not open").select("_source", "doc_id", "mark", "size", (F.col("whole") + F.round(F.when(F.col("size") > 0, F.col("mass") / F.col("size")).otherwise(0.0)) * F.col("size")).alias("taken"))
    taken = [settled]
    level = placed.where("open").select("_source", "bucket", "doc_id", "mark", "size", "whole", "mass")
    depth = 0
    while True:
        item = F.struct("doc_id", "mark", "size", "whole", "mass")
        grouped = level.groupBy("_source", "bucket").agg(F.collect_list(item).alias("items"))
        ordered = grouped.withColumn("items", F.transform(F.array_sort(F.transform("items", lambda x: F.struct(F.xxhash64(x["mark"], F.lit(seed)), x.alias("item")))), lambda x: x["item"]))
        folded = stored(ordered.select("_source", "bucket", F.expr(_fold(doc_type, seed + depth)).alias("end")))
        done = folded.select("_source", F.inline("end.done"))
        taken.append(done.select("_source", "doc_id", "mark", "size", (F.col("whole") + F.col("part")).alias("taken")))
        left = folded.where("end.left.mass >= 0").select("_source", F.floor(F.col("bucket") / bucket).alias("bucket"), "end.left.*")
        if not folded.where("bucket > 0").limit(1).count():
            break
        level, depth = left, depth + 1
    last = left.select("_source", "doc_id", "mark", "size", (F.col("whole") + F.round("mass")).alias("taken"))
    all_taken = last
    for part in taken:
        all_taken = all_taken.unionByName(part)
    named = F.when(F.col("_source") != "", F.substring(F.col("_source"), 2, 1 << 30))
    out = split_join(all_taken, goals, "_source", hot_keys(goals, "_source", "docs"), "mark")
    return out.select("doc_id", named.alias("source"), "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))
