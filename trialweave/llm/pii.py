"""Personal data by bootstrapped contextual extraction.

Fixed patterns find the seed entities (kinds email, ip, card, phone). The words around them make lexical patterns: the two
words before, and the word on each side. Other tokens with a digit or an @ in such contexts are candidates. Spark scores
the graph of patterns and instances in rounds: a pattern by the share of its distinct instances that are known, an instance
by the noisy-or of its patterns. Candidates that stand in a pattern of high confidence are found as `context_<kind>`.

Defined results: null and empty texts have no spans. Positions are code points, end exclusive. Rows that repeat a doc_id
are documents of their own. Repeated instances count once in a pattern. Whole texts are read, in time linear in their length;
a word of a pattern is cut to the WORD_CHARS characters next to the span. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
ROUNDS, MIN_KNOWN, CONFIDENCE, DOUBT = 3, 5, 0.6, 2.0
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT, MARK = re.compile(r"[0-9]"), re.compile(r"[0-9@]")
EDGE = ".,;:!?\"'()[]{}<>|*#$%&="
MIN_CHARS = 5
#: A word of a pattern is at most so many characters next to the span, so that contexts take time by the number of spans.
WORD_CHARS = 40
AFTER = re.compile(rf"\s*(\S{{1,{WORD_CHARS}}})")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ that ends no earlier match, with all local characters before it and a domain after it."""
    at, end = text.find("@"), 0
    while at >= 0:
        found = DOMAIN.match(text, at + 1) if at >= end else None
        if found:
            start = at
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                end = found.end()
                yield start, end
        at = text.find("@", at + 1)


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order; kinds by their place in KINDS."""
    found = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if len(m[0]) >= 14 and 14 <= len(digits := re.sub(r"[^0-9]", "", m[0])) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
        for m in PHONE.finditer(text):
            if 10 <= len(re.findall(r"[0-9]", m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def _word_before(text: str, at: int) -> tuple[str, int]:
    """The characters before `at` up to white space, at most WORD_CHARS, and where they start (-1: there are more)."""
    end = at
    while end and text[end - 1].isspace():
        end -= 1
    start, least = end, max(end - WORD_CHARS, 0)
    while start > least and not text[start - 1].isspace():
        start -= 1
    cut = start > 0 and not text[start - 1].isspace()
    return _plain(text[start:end]), -1 if cut else start


def _word_after(text: str, at: int) -> str:
    found = AFTER.match(text, at)
    return _plain(found[1]) if found else ""


def _plain(word: str) -> str:
    """Lower case without edge punctuation."""
    return word.lower().strip(EDGE)


def contexts(text: str, start: int, end: int) -> list[str]:
    one, at = _word_before(text, start)
    two = _word_before(text, at)[0] if at >= 0 else ""
    after = _word_after(text, end)
    return [f"{two} {one} _"] * bool(one and two) + [f"{one} _ {after}"] * bool(one and after)


def candidates(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Tokens with a digit or an @ outside the base spans, without edge punctuation."""
    taken, k = [(s, e) for s, _, e in base], 0
    for mark in _marked_tokens(text):
        start, end = mark
        while start < end and text[start] in EDGE:
            start += 1
        while end > start and text[end - 1] in EDGE:
            end -= 1
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if end - start >= MIN_CHARS and not any(s < end and e > start for s, e in taken[k : k + 4]):
            yield start, end


def _marked_tokens(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for m in MARK.finditer(text):
        if m.start() < done:
            continue
        start, end = m.start(), m.end()
        while start > done and not text[start - 1].isspace():
            start -= 1
        while end < len(text) and not text[end].isspace():
            end += 1
        done = end
        yield start, end


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    seen = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])
    for batch in batches:
        bases, founds = [], []
        for text in batch.column(1).to_pylist():
            base = base_spans(text) if text else []
            rows = []
            if text and MARK.search(text):
                for start, end, kind in [*((s, e, k) for s, k, e in base), *((s, e, -1) for s, e in candidates(text, base))]:
                    made = contexts(text, start, end)
                    if made:
                        value = hashlib.blake2b(text[start:end].lower().encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
                        rows.append({"start": start, "end": end, "kind": kind, "instance": value, "patterns": made})
            bases.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
            founds.append(rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bases, pa.list_(span)), pa.array(founds, pa.list_(seen))], ["doc_id", "base", "found"])


def pattern_scores(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """pattern, kind, confidence of the patterns with MIN_KNOWN or more known instances.

    `edges`: distinct (pattern, instance, kind), kind -1 for candidates. Patterns with a third of all edges are summed
    before the shuffle and their joins can be split.
    """
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    seeds = edges.where("kind >= 0").withColumn("score", F.lit(1.0))
    open_ = edges.where("kind < 0").select("pattern", "instance")
    known, scored = seeds, None
    for _ in range(rounds):
        sums = known.groupBy("pattern", "kind").agg(F.sum("score").alias("sum"), F.count("*").alias("known"))
        scored = stored(sums.where(F.col("known") >= MIN_KNOWN).join(sizes, "pattern").select("pattern", "kind", (F.col("sum") / (F.col("n") + DOUBT)).alias("confidence")))
        reached = open_.join(scored, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("score"))
        known = seeds.unionByName(open_.join(reached, "instance").select("pattern", "instance", "kind", "score"))
    return scored


def find_personal_data(docs: DataFrame, doc: str = "doc_id", text: str = "text", confidence: float = CONFIDENCE) -> DataFrame:
    """One row per document: doc_id, base and added, arrays of (start, kind, end) in order; kind is the kind's name."""
    source = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    schema = (
        f"doc_id {dict(source.dtypes)['doc_id']}, base array<struct<start:int,kind:int,end:int>>, "
        "found array<struct<start:int,end:int,kind:int,instance:string,patterns:array<string>>>"
    )
    scanned = stored(source.mapInArrow(_scan, schema).withColumn("_row", F.monotonically_increasing_id()))
    seen = scanned.select("_row", F.inline("found"))
    edges = stored(seen.select(F.explode("patterns").alias("pattern"), "instance", "kind").distinct())
    sure = pattern_scores(edges).where(F.col("confidence") >= confidence)
    placed = seen.where("kind < 0").select("_row", "start", "end", F.explode("patterns").alias("pattern")).join(sure, "pattern")
    best = placed.groupBy("_row", "start", "end").agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"))
    added = best.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("added"))
    name = F.array(*[F.lit(k) for k in KINDS])

    def named(spans: str, prefix: str) -> Column:
        return F.transform(F.coalesce(F.col(spans), F.array()), lambda s: F.struct(s["start"].alias("start"), F.concat(F.lit(prefix), F.element_at(name, s["kind"] + 1)).alias("kind"), s["end"].alias("end")))

    return scanned.join(added, "_row", "left").select("doc_id", named("base", "").alias("base"), named("added", "context_").alias("added"))
