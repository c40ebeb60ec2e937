"""Benchmark decontamination by template canonicalisation.

Numbers, units after numbers, and names become typed placeholders; a name is a capitalised word inside a sentence. Each
benchmark item has template windows of WINDOW tokens, in a view with names as placeholders and in one with names as words.
Windows of documents are hash-joined to them. Windows of one item at one shift are one occurrence; its slots must map
item values to document values one to one. That finds copies and re-parameterised questions alike.

A document is contaminated by an item when consistent occurrences cover MIN_COVERAGE of the item's tokens, or LONG_RUN tokens.

Exact and cheap search: every benchmark window names its longest word as its anchor, so only windows of a document around
an anchor are made. The benchmark is taken in blocks of bounded size, each against all documents; each block is broadcast.

Defined results: null and empty texts and items match nothing; empty tables give an empty result. An item of fewer than WINDOW
tokens is one window. Windows of fewer than MIN_WORDS words outside placeholders identify nothing and are left out; an item that has
no other window is searched for by its tokens as they stand, from MIN_TOKENS tokens on. `unsearched` returns the items below that.
Whole texts are read, however long. Rows that repeat doc_id and text, or item_id, count as one; rows of one doc_id (null too) with different texts
are documents of their own. Case and punctuation do not matter. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, MIN_WORDS, MIN_TOKENS, MIN_COVERAGE, LONG_RUN = 8, 4, 4, 0.5, 25
#: Characters of benchmark texts in one block: at most about two million windows, some 300 MB on the driver and in a task.
BLOCK_CHARS = 4_000_000
TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+")
NUMBER, UNIT, NAME = "<num>", "<unit>", "<name>"
# Written numbers and units of measure, in English.
NUMBERS = frozenset("one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split())
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles g kg mg lb lbs pound pounds ounce ounces ton tons l ml liter liters litre litres"
    " gallon gallons second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros"
    " percent degree degrees mph kmh kph w kw v hz".split()
)


@dataclass(frozen=True)
class Template:
    """Two views of a text's tokens; the views differ only where a token is a name."""

    plain: list[str]
    named: list[str]
    values: list[str]


def template(text: str) -> Template:
    plain, named, values = [], [], []
    end, after_number = 0, False
    for m in TOKEN.finditer(text):
        raw, gap = m[0], text[end : m.start()]
        word = raw.lower()
        number = raw[0].isdigit() or word in NUMBERS
        form = NUMBER if number else UNIT if after_number and word in UNITS else word
        inside = bool(end) and not any(c in gap for c in ".!?:\n")
        name = form is word and inside and len(raw) > 1 and raw[0].isupper() and raw[1:].islower()
        plain.append(form)
        named.append(NAME if name else form)
        values.append(word)
        end, after_number = m.end(), number
    return Template(plain, named, values)


def windows(text: str | None, window: int = WINDOW) -> Iterator[tuple[str, int, int, list[str], str]]:
    """key, start, size, values of the slots and anchor of each window of a benchmark item."""
    made = template(text or "")
    size = min(window, len(made.plain))
    found = list(_template_windows(made, size))
    if not found and size >= MIN_TOKENS:
        for start in range(len(made.plain) - size + 1):
            part = made.values[start : start + size]
            found.append((f"x {' '.join(part)}", start, size, [], max(part, key=lambda w: (len(w), w))))
    yield from found


def _template_windows(made: Template, size: int) -> Iterator[tuple[str, int, int, list[str], str]]:
    for start in range(len(made.plain) - size + 1 if size else 0):
        for view, forms in (("p", made.plain), ("n", made.named)):
            part = forms[start : start + size]
            literal = [w for w in part if w[0] != "<"]
            if len(literal) >= MIN_WORDS and (view == "p" or NAME in part):
                slots = [v for v, w in zip(made.values[start : start + size], part, strict=True) if w[0] == "<"]
                yield f"{view} {' '.join(part)}", start, size, slots, max(literal, key=lambda w: (len(w), w))


def _benchmark_windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(item, *w) for item, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True) for w in windows(text)]
        columns = list(zip(*rows, strict=True)) or [()] * 6
        types = [batch.column(0).type, pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.string()]
        made = [pa.array([x.as_py() for x in columns[0]], types[0]), *(pa.array(c, t) for c, t in zip(columns[1:], types[1:], strict=True))]
        yield pa.RecordBatch.from_arrays(made, ["item_id", "key", "at", "size", "slots", "anchor"])


def _document_windows(anchors: dict[str, list[tuple[int, int]]], keys: frozenset[str]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The windows of documents that are in `keys`. anchors: by word, the (size, offset) that windows have it at."""
    views = {k[0] for k in keys}

    def found(text: str) -> Iterator[tuple[str, int, list[str]]]:
        low = [w.lower() for w in TOKEN.findall(text)]
        starts = {(at - off, size) for at, w in enumerate(low) if w in anchors for size, off in anchors[w] if 0 <= at - off <= len(low) - size}
        if not starts:
            return
        made = None
        for start, size in sorted(starts):
            part = low[start : start + size]
            if "x" in views and (key := "x " + " ".join(part)) in keys:
                yield key, start, []
            if not views & {"n", "p"}:
                continue
            if "n" not in views and not any(w[0].isdigit() or w in NUMBERS for w in part) and (start == 0 or low[start] not in UNITS):
                if (key := "p " + " ".join(part)) in keys:
                    yield key, start, []
                continue
            made = made or template(text)
            for view, forms in (("p", made.plain), ("n", made.named)):
                part = forms[start : start + size]
                if view in views and (key := f"{view} {' '.join(part)}") in keys:
                    yield key, start, [v for v, w in zip(made.values[start : start + size], part, strict=True) if w[0] == "<"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *w) for k, text in enumerate(batch.column(1).to_pylist()) if text for w in found(text)]
            at, key, start, slots = list(zip(*rows, strict=True)) or [()] * 4
            ids = batch.column(0).take(pa.array(at, pa.int64()))
            made = [ids, pa.array(key, pa.string()), pa.array(start, pa.int32()), pa.array(slots, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "key", "doc_at", "doc_slots"])

    return run


def contaminated(
    docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """One row per contaminated document (doc_id and text) and item: doc_id, item_id, n_windows, covered, n_tokens, coverage, new_values."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item).alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    chars = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    blocks = -(-chars // block_chars) or 1
    source = docs.select(F.struct(F.col(doc).alias("id"), F.xxhash64(text).alias("hash")).alias("doc_id"), F.col(text).alias("text"))
    types = {"doc": dict(source.dtypes)["doc_id"], "item": dict(items.dtypes)["item_id"]}
    result = None
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        made = part.mapInArrow(_benchmark_windows, f"item_id {types['item']}, key string, at int, size int, slots array<string>, anchor string")
        rows = made.select("key", "size", "anchor").distinct().toArrow()
        keys = frozenset(rows.column("key").to_pylist())
        anchors: dict[str, set[tuple[int, int]]] = {}
        for key, size, anchor in zip(*(rows.column(c) for c in ("key", "size", "anchor")), strict=True):
            anchor = anchor.as_py()
            places = enumerate(key.as_py().split(" ")[1:])
            anchors.setdefault(anchor, set()).update((size.as_py(), k) for k, w in places if w == anchor)
        held = spark.sparkContext.broadcast(({w: sorted(x) for w, x in anchors.items()}, keys))
        run = lambda batches, held=held: _document_windows(*held.value)(batches)
        hits = source.mapInArrow(run, f"doc_id {types['doc']}, key string, doc_at int, doc_slots array<string>")
        joined = hits.join(F.broadcast(made.drop("anchor").distinct()), "key")
        result = joined if result is None else result.unionByName(joined)
    sizes = items.mapInArrow(_token_counts, f"item {types['item']}, n_tokens int").groupBy("item").agg(F.max("n_tokens").alias("n_tokens"))
    found = _occurrences(result).join(sizes, F.col("item_id").eqNullSafe(F.col("item"))).withColumn("coverage", F.col("covered") / F.col("n_tokens"))
    enough = (F.col("coverage") >= MIN_COVERAGE) | (F.col("covered") >= LONG_RUN)
    return found.where(enough).select(F.col("doc_id.id").alias("doc_id"), "item_id", "n_windows", "covered", "n_tokens", "coverage", "new_values")


def unsearched(benchmark: DataFrame, item: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id of the items that have no window: empty ones and those too short to identify anything."""
    items = benchmark.select(F.col(item).alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            none = [next(windows(t), None) is None for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(none, pa.bool_()))], ["item_id"])

    return items.mapInArrow(run, f"item_id {dict(items.dtypes)['item_id']}")


def _token_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [len(TOKEN.findall(t)) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32())], ["item", "n_tokens"])


def _occurrences(joined: DataFrame) -> DataFrame:
    """Consistent occurrences, summed by document and item. A group holds windows of one item at one shift of one document."""
    slots = F.transform(F.arrays_zip("slots", "doc_slots"), lambda z: F.struct(z["slots"].alias("i"), z["doc_slots"].alias("d")))
    spans = F.sequence(F.col("at"), F.col("at") + F.col("size") - 1)
    shifts = joined.groupBy("doc_id", "item_id", (F.col("doc_at") - F.col("at")).alias("shift")).agg(
        F.array_distinct(F.flatten(F.collect_set(spans))).alias("tokens"),
        F.array_distinct(F.flatten(F.collect_set(slots))).alias("pairs"),
        F.count_distinct("at").alias("n_windows"),
    )
    one_to_one = (F.size("pairs") == F.size(F.array_distinct(F.col("pairs.i")))) & (F.size("pairs") == F.size(F.array_distinct(F.col("pairs.d"))))
    return shifts.where(one_to_one).groupBy("doc_id", "item_id").agg(
        F.sum("n_windows").alias("n_windows"),
        F.size(F.array_distinct(F.flatten(F.collect_set("tokens")))).alias("covered"),
        F.bool_or(F.exists("pairs", lambda p: p["i"] != p["d"])).alias("new_values"),
    )
