import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialweave.llm import kneser_ney as kn
from trialweave.llm import ordinal, pivotal


def mix_docs(spark, rows):
    return spark.createDataFrame([(i, s, t, 1.0, 2, 3) for i, s, t in rows], "doc_id long, source string, text string, target double, size int, bucket int")


def brute_targets(sizes, weights=(5, 2, 1), budget=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    full, left = {}, budget * sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in full]
        rest = left - sum(full.values())
        over = [s for s in open_ if rest * weight[s] / sum(weight[t] for t in open_) >= most * sizes[s]]
        if not over:
            return full | {s: rest * weight[s] / sum(weight[t] for t in open_) for s in open_}
        full |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("bucket", [4, 256])
def test_mix_meets_targets(spark, bucket):
    rng = np.random.default_rng(3)
    rows = [(k, ["a", "b", None, "é", "d"][min(4, k % 7)], "w " * int(rng.integers(0, 60))) for k in range(700)]
    rows += [(1000, "a", None), (1001, "a", ""), (1002, "b", "w " * 5000), (5, "b", "again again"), (None, "d", "one two three")]
    got = pivotal.pivotal_mix(mix_docs(spark, rows), bucket=bucket).collect()
    again = pivotal.pivotal_mix(mix_docs(spark, rows).repartition(5), bucket=bucket).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    sizes, taken, parts = Counter(), Counter(), Counter()
    for _, s, t in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(sizes)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        parts[r.source] += bool(r.size and r.taken % r.size)
    assert all(abs(taken[s] - want[s]) <= 1 for s in want) and max(parts.values()) <= 1


def test_rounding_is_unbiased(spark):
    rows = [(k, s, "w " * (1 + k % 5)) for k in range(60) for s in ("a", "b", "c")]
    taken, runs = Counter(), 12
    for seed in range(runs):
        for r in pivotal.pivotal_mix(mix_docs(spark, rows), seed=seed, bucket=8).where("source = 'c'").collect():
            taken[r.size] += r.taken / (r.size * r.target / r.source_size * 12 * runs)
    assert all(v == pytest.approx(1, abs=0.35) for v in taken.values())


@pytest.mark.parametrize("copies", [3, 1 << 16])
def test_rows_of_one_id_or_none_spread_over_the_buckets(spark, copies):
    """A third of the rows has no id, a third one id; many of them are equal."""
    rows = [(k, "a", "w " * (1 + k % 9)) for k in range(300)]
    rows += [(None, "a", "w " * (1 + k % 2)) for k in range(300)] + [(7, "a", "w w w")] * 300
    docs = mix_docs(spark, rows).select("doc_id", "source", F.lit(3).cast("long").alias("size"))
    marks = pivotal.marked_rows(docs, 1, copies)
    assert marks.count() == len(rows) and marks.select("mark").distinct().count() == len(rows)
    share = marks.groupBy(F.pmod("mark", F.lit(16)).alias("bucket")).count().agg(F.max("count")).first()[0]
    assert share < 3 * len(rows) / 16
    got = pivotal.pivotal_mix(mix_docs(spark, rows), bucket=8).collect()
    again = pivotal.pivotal_mix(mix_docs(spark, rows).repartition(7), bucket=8).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    assert abs(sum(r.taken for r in got) - got[0].target) <= 1 and all(0 <= r.taken <= 2 * r.size for r in got)
    for part in ([r for r in got if r.doc_id is None], [r for r in got if r.doc_id == 7]):
        wanted = sum(r.size for r in part) * got[0].target / got[0].source_size
        assert len({r.taken / r.size for r in part}) > 1 and sum(r.taken for r in part) == pytest.approx(wanted, rel=0.2)


def test_mix_of_nothing(spark):
    assert pivotal.pivotal_mix(mix_docs(spark, [])).count() == 0
    assert [r.taken for r in pivotal.pivotal_mix(mix_docs(spark, [(1, "a", None), (2, None, "")])).collect()] == [0, 0]


def toxic_rows(n=400):
    rng = np.random.default_rng(5)
    rows, marks = [], []
    for k in range(n):
        toxic = k % 5 == 0
        text = " ".join(f"w{rng.integers(0, 50)}" for _ in range(30)) + (" nasty" * int(rng.integers(1, 5)) + " vile" if toxic else "")
        rows.append((k, text, 1))
        marks.append((k, int(toxic)))
    return rows, marks


def test_toxicity_on_held_out_documents(spark):
    rows, marks = toxic_rows()
    docs = spark.createDataFrame([*rows, (1000, None, 1), (1001, "", 1), (1001, "", 1)], "doc_id long, text string, severity int")
    labels = spark.createDataFrame([*marks, (3, None), (None, 1)], "doc_id long, toxic int")
    model = ordinal.fit(docs, labels.where("doc_id % 2 = 0 or doc_id is null"))
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == 3
    got = {r.doc_id: r for r in ordinal.with_severity(docs, model).collect()}
    truth = dict(marks)
    held = [k for k in truth if k % 2]
    assert sum(got[k].toxic == bool(truth[k]) for k in held) / len(held) > 0.98
    assert not got[1000].toxic and not got[1001].toxic and got[1000].severity == got[1001].severity
    count = {k: rows[k][1].count("nasty") for k in held if truth[k]}
    most, least = ([got[k].severity for k in count if count[k] == n] for n in (4, 1))
    assert np.mean(most) > np.mean(least)


def test_sample_takes_one_row_of_an_id(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (3, "c"), (None, "d")] + [(1, "b")] * 500, "doc_id long, text string").repartition(6)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1)], "doc_id long, toxic int")
    got = [tuple(r) for r in ordinal.labelled_sample(docs, labels, "doc_id", "text", "toxic").collect()]
    assert sorted(got) in ([(False, ""), (True, "a")], [(False, ""), (True, "b")])
    again = ordinal.labelled_sample(docs.repartition(2), labels, "doc_id", "text", "toxic").collect()
    assert sorted(got) == sorted(map(tuple, again))
    assert ordinal.labelled_sample(docs, labels, "doc_id", "text", "toxic", size=1).count() == 1


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for labels in ([], [(1, 0)]):
        model = ordinal.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert len({r.severity for r in ordinal.with_severity(docs, model).collect()}) == 1
    assert ordinal.with_severity(docs.where("doc_id > 9"), model).count() == 0


def test_cumulative_links_recover_thresholds():
    rng = np.random.default_rng(1)
    x, w, cuts = rng.normal(size=(6000, 2)), np.array([1.5, -1.0]), np.array([-1.0, 0.5, 2.0])
    grade = (x @ w + rng.logistic(size=6000) > cuts[:, None]).sum(axis=0)
    row, column = np.repeat(np.arange(6000), 2), np.tile([0, 1], 6000)
    weights, thresholds = ordinal.fit_cumulative_links(row, column, x.ravel(), grade, 2, 4, rounds=1500, penalty=0.0)
    assert np.abs(weights - w).max() < 0.15 and np.abs(thresholds - cuts).max() < 0.15


def brute_model(texts):
    counts = [Counter() for _ in range(5)]
    for t in texts:
        s = "\0" * 3 + t
        for k in range(3, len(s)):
            counts[4][s[k - 3 : k + 1]] += 1
    for order in (3, 2, 1):
        for g in counts[order + 1]:
            counts[order][g[1:]] += 1
    table = {}
    for order in range(1, 5):
        seen = Counter(counts[order].values())
        cut = kn.discounts([seen[k] for k in (1, 2, 3, 4)])
        total, taken = Counter(), Counter()
        for g, n in counts[order].items():
            total[g[:-1]] += n
            taken[g[:-1]] += cut[min(n, 3) - 1]
        table[order] = (counts[order], cut, total, taken)

    def p(g):
        if not g:
            return 1 / 65536
        n, cut, total, taken = table[len(g)]
        if g[:-1] not in total:
            return p(g[1:])
        alpha = (n[g] - cut[min(n[g], 3) - 1]) / total[g[:-1]] if n[g] else 0.0
        return alpha + taken[g[:-1]] / total[g[:-1]] * p(g[1:])

    return p


def test_perplexity_equals_brute_force(spark):
    good = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "thé çat\nsat 𝛼"]
    rows = [(k, t, "en" if k % 2 else None) for k, t in enumerate([*good, "zzz qqq", "the the the", "𝛼𝛽 mat", "", None, "the cat " * 3000])]
    docs = spark.createDataFrame([(i, t, g, 9.0) for i, t, g in rows], "doc_id long, text string, lang string, perplexity double")
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 1), (3, 1), (4, 0), (None, 1)], "doc_id long, quality int")
    p = brute_model([t.encode("utf-16-le").decode("utf-16-le") if max(map(ord, t)) < 65536 else "".join(chr(x) for x in np.frombuffer(t.encode("utf-16-le"), "<u2")) for t in good])
    got = {r.doc_id: r for r in kn.classify(docs, labels).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        if not t:
            assert got[i].perplexity is None and not got[i].kept
            continue
        s = "\0\0\0" + "".join(chr(x) for x in np.frombuffer(t.encode("utf-16-le"), "<u2"))
        want = math.exp(-sum(math.log(p(s[k - 3 : k + 1])) for k in range(3, len(s))) / (len(s) - 3))
        assert got[i].perplexity == pytest.approx(want, rel=1e-6)
    assert got[0].kept and not got[4].kept


def test_probabilities_sum_to_one(spark):
    p = brute_model(["abab", "abba"])
    total = sum(p("aba"[1:] + chr(c)) for c in range(65536))
    assert total == pytest.approx(1, abs=1e-9)


def test_long_texts_are_cut_with_their_context(monkeypatch):
    text = "abcdefghij" * 30
    whole = np.concatenate([k for k, _ in kn.grams([text, None, "xy"])])
    monkeypatch.setattr(kn, "CHUNK", 7)
    parts = list(kn.grams([text, None, "xy"]))
    assert (np.concatenate([k for k, _ in parts]) == whole).all() and len(whole) == 302
    assert np.bincount(np.concatenate([o for _, o in parts])).tolist() == [300, 0, 2]


def test_quality_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert kn.classify(docs, labels).count() == 0
    some = docs.unionByName(spark.createDataFrame([(1, "abc", "en")], docs.schema))
    assert [r.kept for r in kn.classify(some, labels).collect()] == [True]
