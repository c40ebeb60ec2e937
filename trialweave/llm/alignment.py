"""Alignment of two tokenizers over a corpus, with corpus-wide counts of the token pairs that overlap.

Texts are tokenised once and their ids stored. A first alignment finds the distinct id pairs of each document; a minimal
perfect hash over the distinct pairs of the corpus gives every pair an index, the counts are dense vectors over that index,
summed up a tree, and a second alignment looks the counts up. Every lookup compares the stored key, so a pair that is not
in the table cannot take another one's count.

Defined results: null and empty texts, and texts that either tokenizer does not give back byte by byte, have no tokens: all
numbers are 0 and the digest is ''. Whole texts are read, however long. Rows that repeat a doc_id or a text are documents of
their own and count each; null ids are kept. An empty table gives an empty result. Columns besides `doc` and `text` are not read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm.common import shared_folder, stored

FOLDER = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Keys of one shard of the hash, keys that a broadcast table holds (24 bytes each), pairs a task gathers before it emits them.
SHARD_KEYS, TABLE_KEYS, HELD_PAIRS = 1 << 15, 1 << 22, 1 << 21
LANE_ROWS, FAN_IN = 1 << 18, 16

# The words' pattern of the byte-level vocabulary; constants of a 64-bit mixer.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MIX_A, MIX_B, GOLDEN = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15


def byte_vocabulary(path: str) -> dict[bytes, int]:
    """Token bytes to id of a byte-level vocabulary file. Ids are ranks: merges come in the order of their ids."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    decoded = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(visible))}
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    special = {t["id"] for t in made["added_tokens"]}
    return {bytes(decoded[c] for c in token): i for token, i in made["model"]["vocab"].items() if i not in special}


def piece_bytes(model) -> list[bytes]:
    """Bytes of every piece: <0xHH> is a byte, U+2581 a space."""
    ids = range(model.get_piece_size())
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, model.id_to_piece(i)) for i in ids)]


class Tokenizers:
    """Both tokenizers, the bytes of their ids and the lengths of these."""

    def __init__(self, folder: str = FOLDER):
        import sentencepiece
        import tiktoken

        ranks = byte_vocabulary(f"{folder}/{BYTE_BPE}")
        self.a = tiktoken.Encoding("byte_bpe", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{PIECE_BPE}")
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b_bytes = piece_bytes(self.b)

    def encode(self, text: str | None) -> tuple[bytes, bytes]:
        """Ids of both as little-endian 16-bit numbers; empty if a text has no tokens."""
        if not text:
            return b"", b""
        want = b" " + text.encode()
        a, b = self.a.encode_ordinary(" " + text), self.b.encode(text)
        if b"".join([self.a_bytes[i] for i in a]) != want or b"".join([self.b_bytes[i] for i in b]) != want:
            return b"", b""
        return np.array(a, "<u2").tobytes(), np.array(b, "<u2").tobytes()


def lengths(tokens: list[bytes]) -> np.ndarray:
    return np.array([len(t) for t in tokens], np.int64)


class Alignment:
    """Token a[i] overlaps b[j] for each (i, j) of `links`; byte offsets where both end close the groups."""

    def __init__(self, a: np.ndarray, b: np.ndarray, a_len: np.ndarray, b_len: np.ndarray):
        self.a, self.b = a, b
        a_end, b_end = np.cumsum(a_len[a]), np.cumsum(b_len[b])
        marks = np.zeros(a_end[-1] + 1 if len(a) else 1, np.uint8)
        marks[a_end] |= 1
        marks[b_end] |= 2
        ends = marks[np.flatnonzero(marks)]
        self.is_a, self.is_b, self.both = ends & 1 > 0, ends & 2 > 0, ends == 3
        self.i = np.cumsum(self.is_a) - self.is_a
        self.j = np.cumsum(self.is_b) - self.is_b

    def keys(self) -> np.ndarray:
        """One number for the id pair of each link."""
        return (self.a[self.i].astype(np.int64) << 32) | self.b[self.j]

    def groups(self, names: list[str], a_size: int, b_size: int) -> str:
        """`a1,a2|b1;a3|b2,b3`. `names` has each id with the sign after it, see group_names."""
        group = np.cumsum(self.both) - self.both
        a_before, b_before = (np.concatenate([[0], np.cumsum(own)[self.both]]) for own in (self.is_a, self.is_b))
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        codes[np.arange(len(self.a)) + b_before[group[self.is_a]]] = self.a + a_size * self.both[self.is_a]
        codes[np.arange(len(self.b)) + a_before[group[self.is_b] + 1]] = 2 * a_size + self.b + b_size * self.both[self.is_b]
        return "".join([names[c] for c in codes.tolist()])[:-1]


def group_names(a_size: int, b_size: int) -> list[str]:
    return [f"{i}{sign}" for size, signs in ((a_size, ",|"), (b_size, ",;")) for sign in signs for i in range(size)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_A)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(31))


def hashed(keys: np.ndarray, seed: int | np.ndarray) -> np.ndarray:
    return mix(keys.astype(np.uint64) + np.asarray(seed).astype(np.uint64) * np.uint64(GOLDEN))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (hashed(keys, 1) % np.uint64(shards)).astype(np.int64)


def place_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A minimal perfect hash of distinct keys: a seed per bucket, and the keys in the order of their places.

    Buckets of several keys, large ones first, try seeds until all keys fall on free places; a bucket of one key takes
    any free place, which its seed names as -1 - place.
    """
    n = len(keys)
    bucket = (hashed(keys, 2) % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    size = np.bincount(bucket, minlength=n)
    start = np.cumsum(size) - size
    seeds, placed, used = np.zeros(n, np.int64), np.empty(n, np.int64), np.zeros(n, bool)
    for bag in np.argsort(-size, kind="stable"):
        if size[bag] < 2:
            break
        own, seed = keys[order[start[bag] : start[bag] + size[bag]]], 3
        while True:
            at = (hashed(own, seed) % np.uint64(n)).astype(np.int64)
            if not used[at].any() and len(set(at.tolist())) == len(at):
                break
            seed += 1
        seeds[bag], used[at], placed[at] = seed, True, own
    single = np.flatnonzero(size == 1)
    free = np.flatnonzero(~used)
    seeds[single], placed[free] = -1 - free, keys[order[start[single]]]
    return seeds, placed


class PairTable:
    """Shards of the hash with their keys and counts, put one after the other."""

    def __init__(self, parts: list[tuple[int, bytes, bytes, bytes]], shards: int):
        """`parts`: shard, seeds, keys and counts of it as 64-bit numbers."""
        self.shards, self.size, self.first = shards, np.zeros(shards, np.int64), np.zeros(shards, np.int64)
        join = lambda k: np.concatenate([np.frombuffer(p[k], np.int64) for p in parts] or [np.zeros(0, np.int64)])
        self.seeds, self.keys, self.counts = join(1).astype(np.int32), join(2), join(3)
        at = 0
        for shard, seeds, _, _ in parts:
            self.size[shard], self.first[shard] = len(seeds) // 8, at
            at += len(seeds) // 8

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 for a key that the table does not hold."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        shard = shard_of(keys, self.shards)
        first, size = self.first[shard], np.maximum(self.size[shard], 1).astype(np.uint64)
        bucket = first + (hashed(keys, 2) % size).astype(np.int64)
        seed = self.seeds[np.minimum(bucket, len(self.seeds) - 1)].astype(np.int64)
        at = first + np.where(seed < 0, -1 - seed, (hashed(keys, np.maximum(seed, 0)) % size).astype(np.int64))
        at = np.minimum(at, len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def lookup(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the table holds the key, and its count (0 if not)."""
        at = self.places(keys)
        return at >= 0, np.where(at >= 0, self.counts[at] if len(self.counts) else 0, 0)


def _encode(folder: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Tokenizers(folder)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                made = [both.encode(t) for t in part.column("text").to_pylist()]
                sides = [pa.array([m[s] for m in made], pa.binary()) for s in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), *sides], ["doc_id", "row", "a", "b"])

    return run


def encode(docs: DataFrame, doc: str = "doc_id", text: str = "text", folder: str = FOLDER) -> DataFrame:
    """doc_id, a row number and the ids of both tokenizers, written to the shared folder and read from there."""
    source = docs.select(F.col(doc).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text).cast("string").alias("text"))
    made = source.mapInArrow(_encode(folder), f"doc_id {dict(source.dtypes)['doc_id']}, row long, a binary, b binary")
    path = f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    made.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def _aligned(batch: pa.RecordBatch, a_len: np.ndarray, b_len: np.ndarray) -> Iterator[Alignment]:
    for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
        yield Alignment(np.frombuffer(x, "<u2").astype(np.int64), np.frombuffer(y, "<u2").astype(np.int64), a_len, b_len)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(at, np.concatenate(counts), len(distinct)).astype(np.int64)


def document_pairs(encoded: DataFrame, a_len: np.ndarray, b_len: np.ndarray) -> DataFrame:
    """key and n: distinct id pairs and the documents that hold them linked, summed within a task (pairs may repeat)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, waiting = [], [], 0
        for batch in batches:
            for one in _aligned(batch, a_len, b_len):
                keys.append(np.unique(one.keys()))
                counts.append(np.ones(len(keys[-1])))
                waiting += len(keys[-1])
                if waiting > HELD_PAIRS:
                    keys, counts = ([x] for x in _merged(keys, counts))
                    waiting = len(keys[0])
                    if waiting > HELD_PAIRS // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(counts[0])], ["key", "n"])
                        keys, counts, waiting = [], [], 0
        if waiting:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _merged(keys, counts)], ["key", "n"])

    return encoded.select("a", "b").mapInArrow(run, "key long, n long")


def _with_shard(shards: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = shard_of(batch.column("key").to_numpy(), shards)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard)], [*batch.schema.names, "shard"])

    return run


def _build(found: pa.Table) -> pa.Table:
    seeds, keys = place_keys(np.sort(found.column("key").to_numpy()))
    row = {"shard": found.column("shard")[:1], "seeds": [seeds.tobytes()], "keys": [keys.tobytes()]}
    return pa.table({k: pa.array(v.to_pylist() if isinstance(v, pa.ChunkedArray) else v) for k, v in row.items()})


def _count(shards: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def run(key: tuple, rows: pa.Table, hashes: pa.Table) -> pa.Table:
        shard, lane = (k.as_py() for k in key)
        seeds, keys = hashes.column("seeds")[0].as_py(), hashes.column("keys")[0].as_py()
        index = PairTable([(shard, seeds, keys, b"")], shards)
        at = index.places(rows.column("key").to_numpy())
        if (at < 0).any():
            raise ValueError("a pair is missing from the hash")
        vector = np.bincount(at, rows.column("n").to_numpy(), len(keys) // 8).astype(np.int64)
        return pa.table({"shard": [shard], "lane": pa.array([lane], pa.int64()), "counts": [vector.tobytes()]})

    return run


def _sum(rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(v, np.int64) for v in rows.column("counts").to_pylist())
    return pa.table({"shard": rows.column("shard")[:1], "lane": rows.column("lane")[:1], "counts": pa.array([total.tobytes()])})


def pair_counts(pairs: DataFrame, shard_keys: int = SHARD_KEYS, lane_rows: int = LANE_ROWS) -> tuple[DataFrame, int]:
    """One row per shard of a minimal perfect hash (shard, seeds, keys, counts) and the number of shards.

    `pairs` (key, n) is stored. A shard's rows are dealt to lanes, each lane makes a dense vector over the hash, and the
    vectors are summed up a tree of FAN_IN.
    """
    distinct = stored(pairs.select("key").distinct())
    shards = max(1, -(-distinct.count() // shard_keys))
    hashes = stored(distinct.mapInArrow(_with_shard(shards), "key long, shard long").groupBy("shard").applyInArrow(_build, "shard long, seeds binary, keys binary"))
    lanes = max(1, -(-pairs.count() // (shards * lane_rows)))
    dealt = pairs.withColumn("lane", F.spark_partition_id().cast("long") % lanes).mapInArrow(_with_shard(shards), "key long, n long, lane long, shard long")
    every = hashes.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))))
    held = dealt.select("shard", "lane").distinct()
    counts = dealt.groupBy("shard", "lane").cogroup(every.join(held, ["shard", "lane"], "left_semi").groupBy("shard", "lane"))
    vectors = counts.applyInArrow(_count(shards), "shard long, lane long, counts binary")
    while lanes > 1:
        lanes = -(-lanes // FAN_IN)
        up = vectors.withColumn("lane", F.floor(F.col("lane") / FAN_IN).cast("long"))
        vectors = up.groupBy("shard", "lane").applyInArrow(_sum, "shard long, lane long, counts binary")
    return stored(hashes.join(vectors.drop("lane"), "shard")), shards


def _best(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            ids, at = np.unique(np.frombuffer(keys, np.int64) >> 32, return_inverse=True)
            top = np.zeros(len(ids), np.int64)
            np.maximum.at(top, at, np.frombuffer(counts, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(top)], ["a", "top"])


def _slices(counts: DataFrame, table_keys: int) -> list[list[int]]:
    """Shards whose tables are sent together, at most `table_keys` keys (or one shard)."""
    sizes = counts.select("shard", (F.octet_length("keys") / 8).alias("n")).orderBy("shard").collect()
    out: list[list[int]] = []
    held = 0
    for shard, n in sizes:
        if not out or held + n > table_keys:
            out.append([])
            held = 0
        out[-1].append(shard)
        held += n
    return out or [[]]


def _measure(a_len: np.ndarray, b_len: np.ndarray, shared) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, shards, best, digest = shared.value
        pairs = PairTable(parts, shards)
        names = group_names(len(a_len), len(b_len)) if digest else []
        for batch in batches:
            out = []
            for one in _aligned(batch, a_len, b_len):
                if not len(one.a):
                    out.append((0, 0, 0, 0, 0, 0, ""))
                    continue
                known, counts = pairs.lookup(one.keys())
                n_best = int((known & (counts == best[one.a[one.i]])).sum())
                sha = hashlib.sha256(one.groups(names, len(a_len), len(b_len)).encode()).hexdigest() if digest else ""
                out.append((len(one.a), len(one.b), int(one.both.sum()), len(one.i), n_best, int(counts.sum()), sha))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 6 + [pa.string()], strict=True)] if out else []
            if out:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), *columns], ["doc_id", "row", *RESULTS])

    return run


RESULTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def align(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", folder: str = FOLDER, shard_keys: int = SHARD_KEYS, table_keys: int = TABLE_KEYS, lane_rows: int = LANE_ROWS
) -> DataFrame:
    """One row per document: doc_id and the columns of RESULTS.

    The table of counts is sent to the executors in slices of at most `table_keys` keys; each slice is one more alignment
    of the stored ids, and what the slices find is added up, so any number of pairs fits.
    """
    spark, both = docs.sparkSession, Tokenizers(folder)
    a_len, b_len = lengths(both.a_bytes), lengths(both.b_bytes)
    encoded = encode(docs, doc, text, folder)
    counts, shards = pair_counts(stored(document_pairs(encoded, a_len, b_len)), shard_keys, lane_rows)
    best = np.zeros(len(a_len), np.int64)
    for a, top in counts.mapInArrow(_best, "a long, top long").groupBy("a").agg(F.max("top")).collect():  # one row an id of A at most
        best[a] = top
    kind = dict(docs.select(F.col(doc).alias("doc_id")).dtypes)["doc_id"]
    schema = f"doc_id {kind}, row long, " + ", ".join(f"{c} long" for c in RESULTS[:-1]) + f", {RESULTS[-1]} string"
    found = []
    for k, own in enumerate(_slices(counts, table_keys)):
        parts = [tuple(r) for r in counts.where(F.col("shard").isin(own)).select("shard", "seeds", "keys", "counts").collect()] if own else []
        shared = spark.sparkContext.broadcast((parts, shards, best, k == 0))
        found.append(encoded.mapInArrow(_measure(a_len, b_len, shared), schema))
    if len(found) == 1:
        return found[0].drop("row")
    more = found[1]
    for other in found[2:]:
        more = more.unionByName(other)
    added = more.groupBy("row").agg(F.sum("n_best").alias("more_best"), F.sum("count_sum").alias("more_sum"))
    whole = found[0].join(added, "row")
    return whole.withColumns({"n_best": F.col("n_best") + F.col("more_best"), "count_sum": F.col("count_sum") + F.col("more_sum")}).select("doc_id", *RESULTS)
