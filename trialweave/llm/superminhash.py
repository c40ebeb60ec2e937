"""Near duplicates by SuperMinHash signatures, bands, verification on whole shingle sets and union of the links found.

Every element of a set draws a random permutation of the slots and offers its j-th slot the rank j plus a fraction; a slot
keeps the least offer. The ranks of one element are therefore all different, which lowers the variance against independent
draws, and once no slot is above rank j, later ranks need not be drawn.

Documents of one set are one class. Classes that share a band meet in buckets, where the share of equal slots links them
loosely; loosely linked classes form clusters, and the links inside a cluster are confirmed on the whole sets. Buckets and
clusters may be of any size: `block_links` compares them in blocks of bounded bytes. Within a block a member is compared with
those that no component has yet. Some members are common to all blocks, so that a large component is known after one
step; only members outside of it are then compared with all blocks. Links are given out where they join components, never
as all pairs.

Defined results: null texts and texts without words have the empty set, which links with nothing. Rows that repeat a text are
one class; rows that repeat a doc_id share its links. A null doc_id is never the smallest one: a component without any other
id has the id null and its rows are kept. Whole texts are read, however long. An empty table gives an empty result; columns
besides `doc` and `text` are not read. Shingles are compared by their XXH64.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm.common import components, hot_keys, split_join, stored

SHINGLE, THRESHOLD = 5, 85
#: A pair at the threshold shares none of 32 bands of 5 slots with a chance of 7e-9; one at 0.3 meets with a chance of 7 %.
BANDS, BAND_ROWS = 32, 5
#: Share of equal slots of a loose link. A pair at the threshold is 7 deviations of 160 slots above it.
LOOSE = 0.65
#: Smaller sets are at the threshold with none but themselves.
SMALLEST = -(-THRESHOLD // (100 - THRESHOLD))
#: Bytes of the members of a block, and members common to all blocks of a group.
BLOCK_BYTES, COMMON = 1 << 22, 16
DRAWN, SEED = 1 << 15, 42
MIX_A, MIX_B, GOLDEN = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15  # fixed values: a 64-bit mixer


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 of the shingles. Splits at ASCII white space, lowers A-Z."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    size = min(shingle, len(found))
    joined, ends = b" ".join(found), list(accumulate(len(w) + 1 for w in found))
    starts, hashed = [0, *ends[:-1]], xxhash.xxh64_intdigest
    spans = zip(starts, ends[size - 1 :], strict=False)
    return np.unique(np.fromiter((hashed(joined[s : e - 1], SEED) for s, e in spans), np.uint64, len(found) - size + 1))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_A)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(31))


def signatures(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """One row of `slots` numbers per set (infinite for an empty set), all sets drawn together rank by rank."""
    out = np.full((len(sets), slots), np.inf)
    flat = out.reshape(-1)
    elements = np.concatenate([*sets, np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    places: np.ndarray | None = None
    for rank in range(slots):
        if not len(elements):
            break
        drawn = mix(elements + np.uint64(GOLDEN * (2 * rank + 1) & (1 << 64) - 1))
        other = rank + (mix(drawn + np.uint64(GOLDEN)) % np.uint64(slots - rank)).astype(np.int64)
        if places is None:
            at = other
        else:
            rows = np.arange(len(elements))
            at = places[rows, other].astype(np.int64)
            places[rows, other] = places[rows, rank]
        np.minimum.at(flat, owner * slots + at, rank + (drawn >> np.uint64(11)) * 2.0**-53)
        still = (out.max(axis=1) >= rank + 1)[owner]
        if not still.all():
            elements, owner, at, other = elements[still], owner[still], at[still], other[still]
            places = places[still] if places is not None else None
        if places is None:  # later ranks need what the first one swapped
            places = np.tile(np.arange(slots, dtype=np.uint16), (len(elements), 1))
            places[np.arange(len(elements)), other] = 0
    return out


def _signed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        texts = batch.column("text")
        while at < batch.num_rows:
            sets, size, start = [], 0, at
            while at < batch.num_rows and size < DRAWN:  # a few sets at a time, or one long one
                sets.append(shingle_hashes(texts[at].as_py()))
                size += len(sets[-1])
                at += 1
            drawn = signatures([s if len(s) >= SMALLEST else s[:0] for s in sets], BANDS * BAND_ROWS).view(np.uint64)
            keys = band_keys(drawn)
            short = (mix(drawn) & np.uint64(0xFF)).astype(np.uint8)
            columns = [
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([k if len(s) >= SMALLEST else k[:0] for s, k in zip(sets, keys, strict=True)], pa.list_(pa.int64())),
                pa.array([k.tobytes() for k in short], pa.binary()),
            ]
            part = batch.slice(start, at - start)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), *columns], ["doc_id", "mark", "set", "n", "bands", "slots"])


def band_keys(drawn: np.ndarray) -> np.ndarray:
    """A key per row and band, of the slots of the band and its number."""
    bands = mix(drawn.reshape(len(drawn), BANDS, BAND_ROWS))
    keys = np.tile(np.arange(BANDS, dtype=np.uint64), (len(drawn), 1))
    for k in range(BAND_ROWS):
        keys = mix(keys * np.uint64(GOLDEN) + bands[:, :, k])
    return keys.view(np.int64)


def signed(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, mark (hash of the text), set (digest of its shingles), n, bands and slots (a byte each)."""
    source = _texts(docs, doc, text)
    return source.mapInArrow(_signed, f"doc_id {dict(source.dtypes)['doc_id']}, mark long, set binary, n long, bands array<long>, slots binary")


def _texts(docs: DataFrame, doc: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(doc).alias("doc_id"), F.xxhash64(whole).alias("mark"), whole.cast("binary").alias("text"))


#: Items, flags of those that ask, flags of those at home: index pairs; see _search.
Linker = Callable[[list[bytes], np.ndarray, np.ndarray], Iterator[tuple[int, int]]]


def slot_links(items: list[bytes], asks: np.ndarray, home: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links at a share of LOOSE or more equal slots, a byte each."""
    table = np.frombuffer(b"".join(items), np.uint8).reshape(len(items), -1)
    least = LOOSE * table.shape[1]
    return _search(len(items), asks, home, lambda k, others: others[(table[others] == table[k]).sum(axis=1) >= least])


def set_links(items: list[bytes], asks: np.ndarray, home: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links at THRESHOLD or more of sets of 64-bit hashes."""
    sets = [np.frombuffer(s, np.uint64) for s in items]
    size = np.array([len(s) for s in sets])
    names, at = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(at, kind="stable")
    holder = np.repeat(np.arange(len(sets)), size)[order]
    ends = np.cumsum(np.bincount(at, minlength=len(names)))
    starts = np.cumsum(size) - size

    def near(k: int, others: np.ndarray) -> np.ndarray:
        own = at[starts[k] : starts[k] + size[k]]
        last, first = ends[own], np.where(own > 0, ends[own - 1], 0)
        width = last - first
        spots = np.repeat(last - np.cumsum(width), width) + np.arange(width.sum())
        shared = np.bincount(holder[spots], minlength=len(sets))[others]
        return others[100 * shared >= THRESHOLD * (size[k] + size[others] - shared)]

    return _search(len(items), asks, home, near)


def _search(n: int, asks: np.ndarray, home: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, int]]:
    """Links that join the components that all pairs of `home` members do, or all pairs of one that asks and one at home.

    Members are searched breadth first, each compared with those that no component has yet: a pair goes uncompared only
    if one component has both.
    """
    if asks.any():
        others = np.flatnonzero(home)
        for k in np.flatnonzero(asks):
            yield from ((int(k), int(x)) for x in near(int(k), others[others != k]))
        return
    left = np.ones(n, bool)
    for start in range(n):
        waiting = [start] if left[start] else []
        left[start] = False
        while waiting:
            k = waiting.pop()
            found = near(k, np.flatnonzero(left))
            left[found] = False
            waiting.extend(found.tolist())
            yield from ((k, x) for x in found.tolist())


def _forest(n: int, links: Iterable[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The links that join two components of those before."""
    parent = list(range(n))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x, y in links:
        a, b = top(x), top(y)
        if a != b:
            parent[max(a, b)] = min(a, b)
            yield x, y


def _task(links: Linker) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        nodes = rows.column("node").to_numpy()
        asks, home = (np.array(rows.column(c).to_pylist(), bool) for c in ("asks", "home"))
        found = list(_forest(len(nodes), links(rows.column("item").to_pylist(), asks, home))) if len(nodes) > 1 else []
        return pa.table({"a": pa.array([nodes[x] for x, _ in found], pa.int64()), "b": pa.array([nodes[y] for _, y in found], pa.int64())})

    return run


LINKS = "a long, b long"


def block_links(members: DataFrame, items: DataFrame, links: Linker, block_bytes: int = BLOCK_BYTES, common: int = COMMON) -> DataFrame:
    """Links (a, b) that join the same components as all links inside the groups do. Stored.

    `members`: group, node, bytes; a node once a group. `items`: node, item; once a node. A group is dealt to blocks of
    about `block_bytes`.
    """
    sizes = members.groupBy("group").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).where("n > 1")
    dealt = sizes.select("group", F.ceil(F.col("bytes") / block_bytes).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node", "group"), "blocks").cast("int")
    placed = stored(members.select("group", "node").join(dealt, "group").withColumn("block", block))
    many = placed.where("blocks > 1")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    draw = F.xxhash64("group", "node", F.lit("common"))
    least = [F.min_by("node", F.when(F.pmod(draw, F.lit(common)) == k, draw)) for k in range(common)]
    shared = many.groupBy("group", "blocks").agg(F.array_compact(F.array(*least)).alias("nodes")).select("group", "blocks", F.explode("nodes").alias("node"))
    flags = [F.lit(False).alias("asks"), F.lit(True).alias("home")]
    rows = placed.select("group", "block", "node").unionByName(shared.select("group", every, "node").join(many.select("group", "node", "block"), ["group", "node", "block"], "left_anti"))
    task = _task(links)
    near = stored(rows.join(items, "node").select("group", "block", "node", "item", *flags).groupBy("group", "block").applyInArrow(task, LINKS))
    if many.isEmpty():
        return near
    roots = components(near)
    here = many.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    largest = here.groupBy("group", "root").agg(F.count("*").alias("n")).groupBy("group").agg(F.max(F.struct("n", "root"))["root"].alias("largest"))
    outside = here.join(largest, "group").where("root <> largest").select("group", "blocks", F.col("block").alias("ask"), "node")
    asking = outside.select("group", "ask", every, "node", F.lit(True).alias("asks"), F.lit(False).alias("home"))
    held = many.select("group", "block", "node").join(outside.select("group", "ask").distinct(), "group")
    both = asking.unionByName(held.withColumns({"asks": F.lit(False), "home": F.lit(True)}))
    once = both.groupBy("group", "ask", "block", "node").agg(F.max("asks").alias("asks"), F.max("home").alias("home"))
    more = once.join(items, "node").groupBy("group", "ask", "block").applyInArrow(task, LINKS)
    return stored(near.unionByName(more))


def near_components(docs: DataFrame, doc: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, common: int = COMMON) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    rows = stored(signed(docs, doc, text))
    alike = rows.where("n > 0").groupBy("set", "n", "bands", "slots")
    classes = alike.agg(F.count("*").alias("rows"), F.min("doc_id").alias("first_id"), F.min_by("mark", "doc_id").alias("first_mark"), F.min("mark").alias("mark"))
    classes = stored(classes.withColumn("mark", F.coalesce("first_mark", "mark")).drop("first_mark").withColumn("node", F.monotonically_increasing_id()))

    bands = classes.select("node", F.explode("bands").alias("group"), F.octet_length("slots").alias("bytes"))
    loose = block_links(bands, classes.select("node", F.col("slots").alias("item")), slot_links, block_bytes, common)
    clusters = components(loose)
    members = stored(clusters.join(classes.select("node", "first_id", "mark", "n"), "node"))
    wanted = members.select("node", F.col("first_id").alias("doc_id"), "mark")
    texts = _texts(docs, doc, text)
    same = (texts["mark"] == wanted["mark"]) & texts["doc_id"].eqNullSafe(wanted["doc_id"])
    sets = texts.join(wanted, same).select("node", "text").mapInArrow(_hashed, "node long, item binary").dropDuplicates(["node"])
    groups = members.select(F.col("root").alias("group"), "node", (F.col("n") * 8).alias("bytes"))
    links = block_links(groups, stored(sets), set_links, block_bytes, common)

    roots = components(links)
    joined = classes.select("set", "node", "rows", "first_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = joined.select("set", "root").join(first, "root").select("set", "component_id")
    known = rows.select("doc_id", "n", "set")
    found = split_join(known, named, "set", hot_keys(classes.select("set", F.col("rows").alias("n")), "set"), F.monotonically_increasing_id())
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 64):
            part = batch.slice(k, 64)
            made = [shingle_hashes(t).tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(made, pa.binary())], ["node", "item"])
