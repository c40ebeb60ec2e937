"""Toxicity by cumulative-link ordinal regression on sparse word features.

P(grade <= k) = sigmoid(threshold_k - w . x): one weight vector for all thresholds, which are kept in order by summing
positive gaps. x is log(1 + count) of the features chosen for the model: words, and word beginnings
of three to five letters, which also catch altered endings. The labels are 0/1, so grades are made of them:
0 is a document that is not toxic, and toxic ones are graded 1 to 3 by the tercile of their sum of x over toxic-leaning features.

Fitted on a bounded sample: the SAMPLE labelled doc_ids with the smallest hashes, one row each, however often an id repeats (the text
with the smallest hash). Scoring reads whole texts.

Defined results: null and empty texts have no words and get the intercepts. Null labels are not used; where labels of a
doc_id differ, toxic wins. Without labels of both kinds every document gets the same severity, and none is toxic unless
all labels are. Columns of `docs` pass through whatever their names, but for the three that are added.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Container, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialweave.llm.common import stored

SAMPLE, VOCABULARY, MIN_DOCS, GRADES = 20_000, 1024, 4, 4
#: Words whose features a task remembers at once.
REMEMBERED = 100_000
ROUNDS, RATE, PENALTY, CUTOFF, LEANING, LIFT = 400, 0.1, 2e-4, 0.15, 10, 2.0
ADDED = ("severity", "p_toxic", "toxic")
TOKEN = re.compile(r"[^\W_]+")


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def features(word: str) -> list[str]:
    """The word, and its beginnings where they are shorter than the word."""
    return [word, *(f"{word[:n]}-" for n in (3, 4, 5) if n < len(word))]


def counted(text: str | None, chosen: Container[str], memory: dict[str, list[str]]) -> Counter:
    """How often the text has each chosen feature. `memory` keeps the chosen features of words seen before."""
    found: Counter = Counter()
    if len(memory) > REMEMBERED:
        memory.clear()
    for word, n in Counter(tokens(text)).items():
        if (own := memory.get(word)) is None:
            own = memory[word] = [f for f in features(word) if f in chosen]
        for f in own:
            found[f] += n
    return found


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def grades_over(self, counts: dict[str, int]) -> list[float]:
        """P(grade > k) for each threshold k."""
        score = sum(self.weights[w] * float(np.log1p(n)) for w, n in counts.items())
        return [float(1 / (1 + np.exp(np.clip(t - score, -500, 500)))) for t in self.thresholds]


def labelled_sample(docs: DataFrame, labels: DataFrame, doc: str, text: str, label: str, size: int = SAMPLE) -> DataFrame:
    """toxic and text of at most `size` labelled documents, one row an id; at most `size` ids are broadcast."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc).isNotNull()).groupBy(doc).agg((F.max(F.col(label)) > 0).alias("_toxic"))
    ids = known.orderBy(F.xxhash64(doc), doc).limit(size)
    rows = docs.select(F.col(doc).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(ids.withColumnRenamed(doc, "_id")), "_id")
    return rows.groupBy("_id", "_toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("_toxic", "text")


def _word_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either kind that have each word, summed over a partition of the sample."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    docs = [0, 0]
    for batch in batches:
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen[toxic].update({f for w in set(tokens(text)) for f in features(w)})
            docs[toxic] += 1
    names = list(seen[0] | seen[1])
    columns = [pa.array([*names, ""]), *(pa.array([*(seen[k][w] for w in names), docs[k]], pa.int64()) for k in (0, 1))]
    yield pa.RecordBatch.from_arrays(columns, ["word", "clean", "toxic"])


def leanings(sample: DataFrame, size: int = VOCABULARY, min_docs: int = MIN_DOCS) -> list[tuple[str, float]]:
    """The `size` features with the largest G-test statistic among those LIFT times as frequent in toxic documents, and it."""
    counts = stored(sample.mapInArrow(_word_counts, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")))
    total = counts.where("word = ''").first()
    n_clean, n_toxic = (float(total["c"]), float(total["t"])) if total else (0.0, 0.0)
    share = F.lit(n_toxic / max(1.0, n_clean + n_toxic))

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    with_it, t = F.col("c") + F.col("t"), F.col("t").cast("double")
    without, rest = F.lit(n_clean + n_toxic) - with_it, F.lit(n_toxic) - F.col("t")
    g = part(t, with_it * share) + part(with_it - t, with_it * (1 - share)) + part(rest, without * share) + part(without - rest, without * (1 - share))
    lifted = t * n_clean > F.lit(LIFT * n_toxic) * F.col("c")
    chosen = counts.where((F.col("word") != "") & (with_it >= min_docs) & lifted).select("word", g.alias("g"))
    return [(r["word"], r["g"]) for r in chosen.orderBy(F.desc("g"), "word").limit(size).collect()]


def fit(
    docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "toxic",
    size: int = SAMPLE, vocabulary: int = VOCABULARY,
) -> Model:
    """The model. Only counts of the chosen words of the bounded sample reach the driver."""
    sample = stored(labelled_sample(docs, labels, doc, text, label, size))
    chosen = leanings(sample, vocabulary)
    index = {w: k for k, (w, _) in enumerate(chosen)}

    def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, list[str]] = {}
        for batch in batches:
            rows = [counted(t, index, memory) for t in batch.column(1).to_pylist()]
            at = pa.array([[index[f] for f in r] for r in rows], pa.list_(pa.int32()))
            n = pa.array([list(r.values()) for r in rows], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), at, n], ["toxic", "at", "n"])

    rows = sample.mapInArrow(rows_of, "toxic boolean, at array<int>, n array<int>").collect()
    rows.sort()  # sums of the fit do not depend on the order the rows came in
    leans = np.array([g for _, g in chosen]) > LEANING
    strength = np.array([sum(float(np.log1p(n)) for k, n in zip(r["at"], r["n"], strict=True) if leans[k]) for r in rows])
    toxic = np.array([r["toxic"] for r in rows], bool)
    grade = np.zeros(len(rows), np.int64)
    if toxic.any():
        grade[toxic] = 1 + np.searchsorted(np.quantile(strength[toxic], np.arange(1, GRADES - 1) / (GRADES - 1)), strength[toxic], side="left")
    weights, thresholds = fit_cumulative_links(
        np.repeat(np.arange(len(rows)), [len(r["at"]) for r in rows]), np.array([k for r in rows for k in r["at"]], np.int64),
        np.log1p(np.array([n for r in rows for n in r["n"]], float)), grade, len(chosen), GRADES,
    )
    return Model({w: float(weights[k]) for w, k in index.items()}, tuple(map(float, thresholds)))


def fit_cumulative_links(
    row: np.ndarray, column: np.ndarray, value: np.ndarray, grade: np.ndarray, n_columns: int, grades: int,
    rounds: int = ROUNDS, rate: float = RATE, penalty: float = PENALTY,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds with the largest penalised likelihood, by Adam on the whole (bounded) sample."""
    n = max(1, len(grade))
    share = (np.bincount(grade, minlength=grades) + 0.5) / (len(grade) + 0.5 * grades)
    start = np.log(np.cumsum(share)[:-1] / (1 - np.cumsum(share)[:-1]))
    theta = np.concatenate([np.zeros(n_columns), start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    over = (grade[:, None] > np.arange(grades - 1)).astype(float)

    def cuts(t: np.ndarray) -> np.ndarray:
        return t[n_columns] + np.concatenate([[0.0], np.cumsum(np.exp(t[n_columns + 1 :]))])

    for k in range(1, rounds + 1):
        score = np.bincount(row, value * theta[column], minlength=len(grade)) if len(row) else np.zeros(len(grade))
        below = np.concatenate([np.zeros((len(grade), 1)), 1 / (1 + np.exp(np.clip(score[:, None] - cuts(theta), -500, 500))), np.ones((len(grade), 1))], axis=1)
        likely = np.maximum(below[np.arange(len(grade)), grade + 1] - below[np.arange(len(grade)), grade], 1e-12)
        slope = below[:, 1:-1] * (1 - below[:, 1:-1]) / likely[:, None]  # of each threshold that bounds the grade
        signed = slope * ((over == 0) & (np.arange(grades - 1) == grade[:, None])) - slope * ((over == 1) & (np.arange(grades - 1) == grade[:, None] - 1))
        by_score = -signed.sum(axis=1)
        up = np.bincount(column, value * by_score[row], minlength=n_columns) if len(row) else np.zeros(n_columns)
        by_cut = signed.sum(axis=0)
        tails = np.cumsum(by_cut[::-1])[::-1]
        gradient = np.concatenate([up, tails[:1], tails[1:] * np.exp(theta[n_columns + 1 :])]) / n
        gradient[:n_columns] -= penalty * theta[:n_columns]
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        theta = theta + rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
    return theta[:n_columns], cuts(theta)


def with_severity(docs: DataFrame, model: Model, text: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """The columns of `docs`, plus severity (expected grade), p_toxic = P(grade > 0) and toxic."""
    source = docs.select(*[c for c in docs.columns if c not in ADDED])
    at = source.columns.index(text)
    schema = T.StructType([*source.schema.fields, T.StructField("severity", T.DoubleType()), T.StructField("p_toxic", T.DoubleType()), T.StructField("toxic", T.BooleanType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, list[str]] = {}
        for batch in batches:
            over = [model.grades_over(counted(t, model.weights, memory)) for t in batch.column(at).to_pylist()]
            first = np.array([p[0] for p in over])
            made = [pa.array([sum(p) for p in over], pa.float64()), pa.array(first, pa.float64()), pa.array(first >= cutoff)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *ADDED])

    return source.mapInArrow(run, schema)
