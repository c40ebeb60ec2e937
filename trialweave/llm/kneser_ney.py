"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is of order ORDER over UTF-16 code units, case and white space included; a document starts after ORDER - 1
zeros. It is trained on the whole text of all trusted documents, so its counts grow with the input. An n-gram is one long.

Counts are summed by n-gram. The distinct n-grams of all documents are joined, shard by shard, to the discounted counts of
each order and the back-off weights of their contexts. Scoring deals the documents, packed, to blocks of about BLOCK_CHARS
characters by the hash of their id; the distinct n-grams of a block fetch their log probabilities in one more join and
return to the block, where they are summed by document. The texts are shuffled once: both uses of the blocks read the same
exchange.

A document is kept if its perplexity is between two quantiles of the trusted documents of its language: junk has a high
perplexity, endless repetition a low one. Languages with under MIN_TRUSTED trusted documents use those of all languages.

Defined results: null and empty texts have no perplexity and are not kept. A null language is one of its own. Without
trusted text all n-grams have one probability, and documents are kept. Labels that differ for a doc_id: the lowest counts.
Rows that repeat a doc_id are scored on their own. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.llm.common import hot_keys, known_key, split_join, stored

ORDER, UNIT = 4, 16
BLOCK_CHARS, CHUNK = 12_000_000, 1 << 20
LOW, HIGH, MIN_TRUSTED = 0.001, 0.995, 50
#: Up to this many trusted ids (about 50 MB) are broadcast to select the training texts; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def grams(texts: Sequence[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks of (n-gram of each position, number of its document); long texts are cut with their contexts kept."""
    pieces: list[np.ndarray] = []
    owners: list[int] = []
    size = 0
    for k, text in enumerate(texts):
        if not text:
            continue
        units = np.frombuffer(("\0" * (ORDER - 1) + text).encode("utf-16-le", "surrogatepass"), "<u2")
        for start in range(0, len(units) - ORDER + 1, CHUNK):
            pieces.append(units[start : start + CHUNK + ORDER - 1])
            owners.append(k)
            size += len(pieces[-1])
            if size >= CHUNK:
                yield _keys(pieces, owners)
                pieces, owners, size = [], [], 0
    if pieces:
        yield _keys(pieces, owners)


def _keys(pieces: list[np.ndarray], owners: list[int]) -> tuple[np.ndarray, np.ndarray]:
    units = np.concatenate(pieces).astype(np.uint64)
    lengths = np.array([len(p) for p in pieces])
    keys = units.copy()
    for back in range(1, ORDER):
        keys[back:] |= units[:-back] << np.uint64(UNIT * back)
    starts = np.cumsum(lengths) - lengths
    inside = np.ones(len(units), bool)
    for k in range(ORDER - 1):
        inside[starts + k] = False
    return keys[inside].view(np.int64), np.repeat(np.array(owners), lengths - ORDER + 1)


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for keys, _ in grams(batch.column(0).to_pylist()):
            codes, found = pd.factorize(keys)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.bincount(codes).astype(np.int64))], ["gram", "n"])


def trusted_texts(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """Texts of the documents with a trusted id. `docs`: doc_id, text; `trusted`: distinct doc_id."""
    few = trusted.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(trusted) if few else trusted, "doc_id", "left_semi").select("text")


def _suffix(gram: str, order: int) -> Column:
    return F.col(gram).bitwiseAND(F.lit((1 << UNIT * order) - 1)) if order < ORDER else F.col(gram)


def _context(gram: str, order: int) -> Column:
    """The first order - 1 units of the n-gram of this order that ends `gram`."""
    return F.shiftrightunsigned(_suffix(gram, order), UNIT)


def train(texts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1: (gram, alpha) and (context, gamma), stored. p(w | h) = alpha(h w) + gamma(h) p(w | h')."""
    counts = stored(texts.mapInArrow(_count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    model = []
    for order in range(ORDER, 0, -1):
        seen = {r["n"]: r["types"] for r in counts.where("n <= 4").groupBy("n").agg(F.count("*").alias("types")).collect()}
        cut = discounts([seen.get(k, 0) for k in (1, 2, 3, 4)])
        taken = F.when(F.col("n") == 1, cut[0]).when(F.col("n") == 2, cut[1]).otherwise(cut[2])
        each = counts.withColumn("context", _context("gram", order)).withColumn("taken", taken)
        totals = stored(each.groupBy("context").agg(F.sum("n").alias("total"), (F.sum("taken") / F.sum("n")).alias("gamma")))
        alphas = each.join(totals, "context").select("gram", ((F.col("n") - F.col("taken")) / F.col("total")).alias("alpha"))
        model.append((stored(alphas), totals.select("context", "gamma")))
        if order > 1:  # below the highest order: the number of different units before the n-gram
            counts = stored(counts.groupBy(_suffix("gram", order - 1).alias("gram")).agg(F.count("*").alias("n")))
    return model[::-1]


def discounts(seen: Sequence[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more, from the numbers of types with counts 1 to 4."""
    n1, n2, n3, n4 = (max(1, n) for n in seen)
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.1), k - 0.1) for k, d in enumerate(found, 1))


def log_probabilities(wanted: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(gram, logp) of distinct n-grams. Tables with one unit as their key have 65,536 rows at most and are broadcast."""
    found, p = wanted, F.lit(1.0 / (1 << UNIT))
    for order, (alphas, gammas) in enumerate(model, 1):
        a, g = alphas.select(F.col("gram").alias("_a"), F.col("alpha").alias(f"alpha{order}")), gammas.select(F.col("context").alias("_g"), F.col("gamma").alias(f"gamma{order}"))
        found = found.withColumn("_a", _suffix("gram", order)).join(F.broadcast(a) if order == 1 else a, "_a", "left").drop("_a")
        found = found.withColumn("_g", _context("gram", order)).join(F.broadcast(g) if order <= 2 else g, "_g", "left").drop("_g")
        p = F.coalesce(F.col(f"alpha{order}"), F.lit(0.0)) + F.coalesce(F.col(f"gamma{order}"), F.lit(1.0)) * p
    return found.select("gram", F.log(p).alias("logp"))


def _distinct_grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for keys, _ in grams(batch.column(0).to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(pd.unique(keys))], ["gram"])


def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, docs): the rows of a batch that go to one block, compressed together."""
    for batch in batches:
        blocks = batch.column("block").to_numpy()
        order = np.argsort(blocks, kind="stable")
        rows, at = batch.select(["doc_id", "lang", "text"]).take(pa.array(order)), blocks[order]
        cuts = [*np.flatnonzero(np.diff(at, prepend=-1)).tolist(), len(at)]
        packed = [_packed(rows.slice(i, j - i)) for i, j in zip(cuts, cuts[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array(at[cuts[:-1]]), pa.array(packed, pa.binary())], ["block", "docs"])


def _packed(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(docs: bytes) -> pa.Table:
    return pa.ipc.open_stream(docs).read_all()


def _block_grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct n-grams of each block of a task: fewer than the characters of a block."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, docs in zip(batch.column("block").to_pylist(), batch.column("docs"), strict=True):
            for keys, _ in grams(_unpacked(docs.as_py()).column("text").to_pylist()):
                found = pd.unique(keys)
                held[block] = pd.unique(np.concatenate([held[block], found])) if block in held else found
    for block, found in held.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), block)), pa.array(found)], ["block", "gram"])


def _score(packed: pa.Table, known: pa.Table) -> pa.Table:
    order = np.argsort(known.column("gram").to_numpy(), kind="stable")
    table, logp = known.column("gram").to_numpy()[order], known.column("logp").to_numpy()[order]
    scored = []
    for part in packed.column("docs"):
        docs = _unpacked(part.as_py())
        sums, n = np.zeros(docs.num_rows), np.zeros(docs.num_rows)
        for keys, owner in grams(docs.column("text").to_pylist()):
            codes, found = pd.factorize(keys)
            each = logp[np.searchsorted(table, found)][codes]
            sums += np.bincount(owner, each, minlength=docs.num_rows)
            n += np.bincount(owner, minlength=docs.num_rows)
        value = pa.array(np.exp(-sums / np.maximum(n, 1)), pa.float64(), mask=n == 0)
        scored.append(pa.table({"doc_id": docs.column("doc_id"), "lang": docs.column("lang"), "perplexity": value}))
    return pa.concat_tables(scored)


def perplexities(docs: DataFrame, model: list[tuple[DataFrame, DataFrame]], block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, lang and perplexity of each row of `docs` (doc_id, lang, text)."""
    chars = docs.agg(F.sum(F.char_length("text"))).first()[0] or 0
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(chars // block_chars + 1))
    blocks = docs.withColumn("block", block).mapInArrow(_pack, "block long, docs binary").repartition("block")
    known = stored(log_probabilities(docs.select("text").mapInArrow(_distinct_grams, "gram long").distinct(), model))
    wanted = blocks.mapInArrow(_block_grams, "block long, gram long")
    fetched = wanted.join(known, "gram").select("block", "gram", "logp")
    kinds = dict(docs.dtypes)
    schema = f"doc_id {kinds['doc_id']}, lang {kinds['lang']}, perplexity double"
    return blocks.groupBy("block").cogroup(fetched.groupBy("block")).applyInArrow(_score, schema)


def classify(
    docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "quality",
    low: float = LOW, high: float = HIGH,
) -> DataFrame:
    """One row per document: doc_id, lang, perplexity, low, high, kept."""
    source = docs.select(F.col(doc).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    marked = labels.where(F.col(doc).isNotNull()).groupBy(F.col(doc).alias("doc_id")).agg(F.min(label).alias("label"))
    trusted = stored(marked.where("label > 0").select("doc_id"))
    model = train(trusted_texts(source.select("doc_id", "text"), trusted))
    scored = stored(perplexities(source, model).withColumn("_lang", known_key("lang")))
    limits = F.percentile_approx("perplexity", [low, high], 100_000)
    good = scored.join(trusted, "doc_id", "left_semi").where("perplexity is not null")
    by_lang = good.groupBy("_lang").agg(F.count("*").alias("n"), limits.alias("limits")).where(F.col("n") >= MIN_TRUSTED).drop("n")
    overall = good.agg(limits).first()[0] or [0.0, float("inf")]
    rows = scored.groupBy("_lang").agg(F.count("*").alias("n"))
    joined = split_join(scored, by_lang, "_lang", hot_keys(rows, "_lang"), "doc_id")
    bounds = [F.coalesce(F.get("limits", F.lit(k)), F.lit(float(overall[k]))) for k in (0, 1)]
    kept = F.coalesce(F.col("perplexity").between(*bounds), F.lit(False))
    return joined.select("doc_id", "lang", "perplexity", bounds[0].alias("low"), bounds[1].alias("high"), kept.alias("kept"))
