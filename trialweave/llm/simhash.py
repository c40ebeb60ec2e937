"""SimHash near-duplicates, linked by a self-join of binary tries.

Defined results: null and empty texts have fingerprint zero and link like any other; fewer words than a shingle make one
shingle. Equal fingerprints are joined once. Rows that repeat a doc_id share its component. A null doc_id is never the
smallest one; a component without any other id has the id null. Other columns are not read.
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

SHINGLE, MAX_BITS, SEED = 3, 3, 42
#: Fingerprints below one trie node of the first cut (about 0.5 MB); more make the cut deeper.
NODE_SIZE = 1 << 16
LEAF_PAIRS, CHUNK = 64, 1 << 17


def fingerprint(text: bytes, shingle: int = SHINGLE) -> bytes:
    """Eight bytes: a bit is set if over half of the shingles' XXH64 have it. Splits at ASCII white space, lowers A-Z."""
    found = text.lower().split()
    if not found:
        return bytes(8)
    size = min(shingle, len(found))
    joined, ends = b" ".join(found), list(accumulate(len(w) + 1 for w in found))
    starts = [0, *ends[:-1]]
    votes, hashed = np.zeros(64, np.int64), xxhash.xxh64_digest
    for k in range(0, len(found) - size + 1, CHUNK):
        spans = zip(starts[k : k + CHUNK], ends[k + size - 1 : k + size - 1 + CHUNK], strict=False)
        bits = np.unpackbits(np.frombuffer(b"".join([hashed(joined[s : e - 1], SEED) for s, e in spans]), np.uint8).reshape(-1, 8), axis=1)
        votes += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * votes > len(found) - size + 1).tobytes()


def fingerprints(docs: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and the fingerprint as a long."""
    source = docs.select(F.col(doc).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = b"".join([fingerprint(t, shingle) for t in batch.column("text").to_pylist()])
            prints = np.frombuffer(made, ">u8").astype(np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints)], ["doc_id", "print"])

    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, print long")


def trie_links(a: np.ndarray, b: np.ndarray, same: bool, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs at `bits` or fewer differing bits of two sorted arrays, found by walking both tries together.

    A frontier holds pairs of nodes (ranges of equal prefix) with the error budget left; children that differ spend one,
    and a pair without budget is dropped. Small pairs are compared at once. `same`: a and b are one array; pairs come once.
    """
    start = np.array([[0], [len(a)], [0], [len(b)], [bits]], np.int64)
    stack = [(63, start)] if len(a) and len(b) else []
    zeros_of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    while stack:
        bit, nodes = stack.pop()
        if nodes.shape[1] > CHUNK:
            stack.extend((bit, part) for part in np.array_split(nodes, -(-nodes.shape[1] // CHUNK), axis=1))
            continue
        small = ((nodes[1] - nodes[0]) * (nodes[3] - nodes[2]) <= LEAF_PAIRS) | (bit < 0)
        if small.any():
            yield from _leaf_links(a, b, nodes[:, small], same, bits)
            nodes = nodes[:, ~small]
        if not nodes.shape[1]:
            continue
        if bit not in zeros_of:
            zeros_of[bit] = tuple(np.concatenate([[0], np.cumsum((x >> np.uint64(bit)) & np.uint64(1) == 0)]) for x in (a, b))
        za, zb = zeros_of[bit]
        la, ha, lb, hb, left = nodes
        ma, mb = la + za[ha] - za[la], lb + zb[hb] - zb[lb]
        kids = [(la, ma, lb, mb, left), (ma, ha, mb, hb, left), (la, ma, mb, hb, left - 1), (ma, ha, lb, mb, left - 1)]
        made = [np.stack(k) for k in kids]
        if same:  # the pair of a node with itself gives its mixed children once
            made[3] = made[3][:, la != lb]
        grown = np.concatenate(made, axis=1)
        stack.append((bit - 1, grown[:, (grown[0] < grown[1]) & (grown[2] < grown[3]) & (grown[4] >= 0)]))


def _leaf_links(a: np.ndarray, b: np.ndarray, nodes: np.ndarray, same: bool, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    width = nodes[3] - nodes[2]
    sizes = (nodes[1] - nodes[0]) * width
    cuts = np.searchsorted(np.cumsum(sizes), np.arange(CHUNK * 8, sizes.sum() + CHUNK * 8, CHUNK * 8))
    begin = 0
    for end in [*(cuts + 1), len(sizes)]:
        end = min(end, len(sizes))
        if end <= begin:
            continue
        part = slice(begin, end)
        n = sizes[part]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        w = np.repeat(width[part], n)
        i, j = np.repeat(nodes[0][part], n) + at // w, np.repeat(nodes[2][part], n) + at % w
        near = np.bitwise_count(a[i] ^ b[j]) <= bits
        if same:
            near &= i < j
        if near.any():
            yield i[near], j[near]
        begin = end


def spanning_links(a: np.ndarray, b: np.ndarray, same: bool, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same components as all links do, fewer than there are fingerprints."""
    values = a if same else np.concatenate([a, b])
    root, shift = np.arange(len(values)), 0 if same else len(a)
    parent = root.tolist()

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, j in trie_links(a, b, same, bits):
        ri, rj = root[i], root[j + shift]
        apart = ri != rj
        if apart.any():
            for x, y in zip(*np.divmod(np.unique(ri[apart] * len(values) + rj[apart]), len(values)), strict=True):
                x, y = top(int(x)), top(int(y))
                parent[max(x, y)] = min(x, y)
            root = np.array(parent)
            while (root != (up := root[root])).any():
                root = up
    moved = np.flatnonzero(root != np.arange(len(values)))
    return values[moved], values[root[moved]]


def _join_nodes(bits: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, same in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), strict=True):
                a, b = (np.sort(v.values.to_numpy().view(np.uint64)) for v in (x, y))
                links = spanning_links(a, b, same, bits)
                yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)) for v in links], ["a", "b"])

    return run


def near_links(prints: DataFrame, bits: int = MAX_BITS, node_size: int = NODE_SIZE) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct fingerprints at `bits` or fewer differing bits.

    The tries are cut at a depth that grows with the logarithm of the number of fingerprints. A node of the cut meets only
    nodes whose path differs from its own in the budget at most; dense nodes are split into pieces that all meet.
    """
    distinct = prints.select("print").distinct()
    number = distinct.count()
    depth = 0 if number < 2048 else max(5, int(np.ceil(np.log2(number / node_size))))
    node = F.shiftrightunsigned("print", 64 - depth) if depth else F.lit(0).cast("long")
    placed = distinct.withColumn("node", node)
    hot = hot_keys(placed.groupBy("node").agg(F.count("*").alias("n")), "node", parts=2 << depth)
    pieces = F.coalesce("_pieces", F.lit(1))
    cut = placed.join(F.broadcast(hot), "node", "left").withColumn("piece", F.pmod(F.xxhash64("print"), pieces).cast("int"))
    nodes = stored(cut.groupBy("node", "piece").agg(F.collect_list("print").alias("prints")))
    flips = [0] + [f for n in range(1, min(bits, depth) + 1) for f in _masks(depth, n)]
    partner = F.explode(F.array(*[F.col("node").bitwiseXOR(F.lit(f).cast("long")) for f in flips]))
    left = nodes.select("node", "piece", F.col("prints").alias("x"), partner.alias("other")).where("other >= node")
    right = nodes.select(F.col("node").alias("other"), F.col("piece").alias("other_piece"), F.col("prints").alias("y"))
    met = left.join(right, "other").where("other > node or other_piece >= piece")
    pairs = met.select("x", "y", ((F.col("node") == F.col("other")) & (F.col("piece") == F.col("other_piece"))).alias("same"))
    dealt = pairs.repartition(prints.sparkSession.sparkContext.defaultParallelism * 4)
    return dealt.mapInArrow(_join_nodes(bits), "a long, b long")


def _masks(width: int, ones: int) -> list[int]:
    if not ones:
        return [0]
    return [(1 << i) | rest for i in range(width) for rest in _masks(i, ones - 1)]


def simhash_components(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = SHINGLE, bits: int = MAX_BITS, node_size: int = NODE_SIZE
) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    prints = stored(fingerprints(docs, doc, text, shingle))
    groups = stored(prints.groupBy("print").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")))
    roots = components(near_links(groups, bits, node_size))
    joined = groups.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    first = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = joined.select("print", "root").join(first, "root").select("print", "component_id")
    all_rows = split_join(prints, named, "print", hot_keys(groups, "print"), "doc_id")
    return all_rows.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
