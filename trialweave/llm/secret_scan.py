"""Secret scan with character Markov models. DataFrame functions only.

Fixed patterns find the base spans (kinds assign, access, hex). Two first-order character models, of random strings and of
ordinary identifiers, then score every other token of 16 or more characters that has a letter and a digit; those whose log
likelihood ratio exceeds MIN_RATIO are found as kind `random`.

Labelled samples, bounded by SAMPLE: random strings are the values of base spans and generated SHA-256 digests in hex and
base64; ordinary ones are words of SAMPLE_DOCS documents and identifiers joined of them. Samples are those with the smallest
hashes. Only the table of transition counts (at most 80 x 80) reaches the driver. Scanning reads whole texts.

Defined results: null and empty texts have no spans; positions are code points, end exclusive. Rows that repeat a doc_id are
documents of their own. Whole texts are read; thousands of matches in one text cost little more each than a few do. An empty
corpus leaves the generated strings against a uniform model. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"(?<![0-9a-f])[0-9a-f]{24,}"
TOKEN = r"(?<![\p{L}\p{N}+/_=-])[A-Za-z0-9+/_=-]{16,}+(?!\p{L}|\p{N})"
WORD = r"(?<![\p{L}\p{N}])[A-Za-z]{4,}+(?!\p{L}|\p{N})"
SAMPLE, SAMPLE_DOCS, GENERATED = 20_000, 2_000, 2_000
MIN_RATIO, SMOOTHING, BACK_OFF = 8.0, 0.5, 8.0
#: Matches of a text are collected in chunks of this many.
CHUNK = 128
#: Tokens are made of characters from + (43) to z (122).
FIRST, WIDTH = 43, 80


def spans_of(text: Column, regex: str, kind: str, group: int = 0, least: int = 0) -> Column:
    """Array of (start, kind, end, value) of the matches, left to right, whose group has `least` or more characters."""
    hits, gaps = F.regexp_extract_all(text, F.lit(regex), F.lit(0)), F.split(text, regex, -1)
    values = F.regexp_extract_all(text, F.lit(regex), F.lit(group))
    parts = F.arrays_zip(F.transform(F.slice(gaps, F.lit(1), F.size(hits)), F.char_length).alias("gap"), hits.alias("hit"), values.alias("value"))
    span = "struct<start:int,kind:string,end:int,value:string>"
    none = F.array().cast(f"array<{span}>")

    def total(done: Column, part: Column) -> Column:
        return done + part["gap"] + F.char_length(part["hit"])

    def before(done: Column, width: Column) -> Column:
        return F.struct((done["at"] + width).alias("at"), F.concat(done["starts"], F.array(done["at"])).alias("starts"))

    def step(done: Column, part: Column) -> Column:
        begin = done["at"] + part["gap"]
        end = begin + F.char_length(part["hit"])
        made = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), part["value"].alias("value")).cast(span)
        return F.struct(end.alias("at"), F.when(F.char_length(part["value"]) >= least, F.concat(done["spans"], F.array(made))).otherwise(done["spans"]).alias("spans"))

    def spans(chunk: Column) -> Column:
        return F.aggregate(chunk["parts"], F.struct(chunk["start"].alias("at"), none.alias("spans")), step, lambda done: done["spans"])

    def placed(chunks: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), total)), first, before, lambda done: done["starts"])
        return F.flatten(F.transform(F.arrays_zip(chunks.alias("parts"), starts.alias("start")), spans))

    # matches in chunks: a chunk's spans are collected by copying an array that stays small
    return F.when(text.rlike(regex), once(once(parts, chunked), placed)).otherwise(none)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed one time for a row, however often `use` and its lambdas mention it."""
    return F.transform(F.array(value), use)[0]


def chunked(items: Column) -> Column:
    """An array cut into arrays of CHUNK items."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(items) - 1) / CHUNK).cast("int"), F.lit(0))), lambda c: F.slice(items, c * CHUNK + 1, F.lit(CHUNK)))


def apart_from(tokens: Column, base: Column) -> Column:
    """The tokens that overlap no base span. Tokens are in order and go in chunks, each compared with the spans in its reach."""

    def reach(chunk: Column) -> Column:
        return F.struct(chunk.alias("tokens"), F.array_min(chunk["start"]).alias("a"), F.array_max(chunk["end"]).alias("b"))

    def near(r: Column) -> Column:
        return F.struct(r["tokens"].alias("tokens"), F.filter(base, lambda b: (b["start"] < r["b"]) & (b["end"] > r["a"])).alias("base"))

    def apart(r: Column) -> Column:
        return F.filter(r["tokens"], lambda s: ~F.exists(r["base"], lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"])))

    return once(once(tokens, chunked), lambda chunks: F.flatten(F.transform(F.transform(F.transform(chunks, reach), near), apart)))


def base_spans(text: Column) -> Column:
    return F.array_sort(F.concat(spans_of(text, ASSIGN, "assign", 2, 6), spans_of(text, ACCESS, "access"), spans_of(text, HEX, "hex")))


def samples(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(random, ordinary): bounded tables of the labelled strings `s`. `docs` has doc_id, text and base."""
    spark = docs.sparkSession
    values = docs.select(F.explode("base.value").alias("s")).distinct().orderBy(F.xxhash64("s"), "s").limit(SAMPLE)
    digest = F.sha2(F.col("id").cast("string"), 256)
    made = spark.range(GENERATED).select(F.explode(F.array(digest, F.rtrim(F.base64(F.unhex(digest)), F.lit("=")))).alias("s"))
    ids = docs.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    found = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    some = docs.join(F.broadcast(ids), "doc_id").select(found.alias("words"))
    joined = F.transform("words", lambda w, k: F.concat_ws("_", w, F.get("words", k + 1), F.get("words", k + 2)))
    numbered = F.transform("words", lambda w, k: F.concat(w, (k % 100).cast("string")))
    words = some.select(F.explode(F.concat("words", joined, numbered)).alias("s")).distinct().orderBy(F.xxhash64("s"), "s").limit(SAMPLE)
    return values.unionByName(made), words


def transitions(strings: DataFrame) -> dict[tuple[int, int], int]:
    """Counts of pairs of neighbouring characters (codes from FIRST)."""
    chars = strings.select(F.transform(F.split("s", ""), lambda c: F.ascii(c) - FIRST).alias("c")).where(F.size("c") > 1)
    pairs = chars.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda k: F.struct(F.get("c", k - 1).alias("a"), F.get("c", k).alias("b")))).alias("p"))
    inside = pairs.select("p.*").where(F.col("a").between(0, WIDTH - 1) & F.col("b").between(0, WIDTH - 1))
    return {(r["a"], r["b"]): r["n"] for r in inside.groupBy("a", "b").agg(F.count("*").alias("n")).collect()}


def probabilities(counts: dict[tuple[int, int], int]) -> list[float]:
    """P(b | a) at a * WIDTH + b: counts of the pair, backed off to those of b, which are smoothed."""
    before, after = [0] * WIDTH, [0] * WIDTH
    for (a, b), n in counts.items():
        before[a] += n
        after[b] += n
    plain = [(n + SMOOTHING) / (sum(after) + SMOOTHING * WIDTH) for n in after]
    return [(counts.get((a, b), 0) + BACK_OFF * plain[b]) / (before[a] + BACK_OFF) for a in range(WIDTH) for b in range(WIDTH)]


def ratios(random: dict[tuple[int, int], int], ordinary: dict[tuple[int, int], int]) -> list[float]:
    """log P(b | a, random) - log P(b | a, ordinary) at a * WIDTH + b."""
    return [math.log(r / o) for r, o in zip(probabilities(random), probabilities(ordinary), strict=True)]


def ratio_of(token: Column, table: list[float]) -> Column:
    """Log likelihood ratio of a token, summed over its transitions; linear in its length."""
    model = F.split(F.lit(",".join(f"{x:.4f}" for x in table)), ",").cast("array<double>")
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))

    def step(done: Column, char: Column) -> Column:
        code = F.ascii(char) - FIRST
        more = F.when(done["last"] < 0, F.lit(0.0)).otherwise(F.get(model, done["last"] * WIDTH + code))
        return F.struct(code.alias("last"), (done["sum"] + more).alias("sum"))

    return F.aggregate(F.split(token, ""), start, step, lambda done: done["sum"])


def find_secrets(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_ratio: float = MIN_RATIO) -> DataFrame:
    """One row per document: doc_id, base and added, arrays of (start, kind, end) in order."""
    whole = docs.select(F.col(doc).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    scanned = whole.withColumn("base", base_spans(F.col("text")))
    random, ordinary = samples(scanned)
    table = ratios(transitions(random), transitions(ordinary))
    tokens = F.filter(spans_of(F.col("text"), TOKEN, "random"), lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))
    apart = apart_from(tokens, F.col("base"))
    added = F.filter(apart, lambda s: ratio_of(s["value"], table) > min_ratio)
    bare = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return scanned.select("doc_id", bare(F.col("base")).alias("base"), bare(added).alias("added"))
