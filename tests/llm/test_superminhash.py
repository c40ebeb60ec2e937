import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialweave.llm import superminhash

SCHEMA = "doc_id long, text string, mark string, set string, n string, node int, bands int, kept string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "m", "s", "n", 1, 2, "k") for i, t in rows], SCHEMA)


def brute(rows):
    """Components of all pairs at the threshold, by counting shared shingles."""
    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()

    sets = [shingles(t) for _, t in rows]
    distinct = [s for s in dict.fromkeys(sets) if s]
    parent = list(range(len(distinct)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for k, s in enumerate(distinct):
        shared = Counter(x for e in s for x in holders[e])
        for other, n in shared.items():
            if 100 * n >= 85 * (len(s) + len(distinct[other]) - n):
                a, b = sorted((top(k), top(other)))
                parent[b] = a
        for e in s:
            holders[e].append(k)
    place, first = {s: k for k, s in enumerate(distinct)}, {}
    for (i, _), s in zip(rows, sets):
        if s and i is not None:
            root = top(place[s])
            first[root] = min(first.get(root, i), i)
    out = [(i, len(s), first.get(top(place[s])) if s else i) for (i, _), s in zip(rows, sets)]
    return sorted(((i, n, c, i == c) for i, n, c in out), key=str)


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def mixed():
    draw = np.random.default_rng(5)
    vocabulary = np.array([f"w{k}" for k in range(3000)])
    rows = []
    for family in range(12):
        base = list(draw.choice(vocabulary, 150))
        for _ in range(25 if family else 120):
            copy = list(base)
            for at in draw.choice(len(copy), draw.integers(0, 9), replace=False):
                copy[at] = str(draw.choice(vocabulary))
            rows.append((len(rows), " ".join(copy)))
    rows += [(None, rows[0][1]), (None, "null id alone with words"), (900, None), (901, ""), (902, " \t\n"), (903, "One two"), (904, "one  TWO"),
             (905, "a b c d e f g h i j"), (906, "a b c d e f g h i j k"), (907, "a b c d e f g h i j k"), (7, rows[7][1]), (7, rows[-1][1]),
             (908, "long " * 30_000), (909, " ".join(f"v{k}" for k in range(20_000))), (910, " ".join(f"v{k}" for k in range(20_100)))]
    return rows


@pytest.mark.parametrize(("block_bytes", "common"), [(1 << 22, 16), (1500, 2)])
def test_components_equal_brute_force(spark, mixed, block_bytes, common):
    assert result(superminhash.near_components(docs(spark, mixed), block_bytes=block_bytes, common=common)) == brute(mixed)


def test_query_equals_brute_force(spark, small_dir):
    table = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text")
    assert result(superminhash.near_components(table)) == brute([tuple(r) for r in table.collect()])


def test_empty_table(spark):
    assert superminhash.near_components(docs(spark, [])).count() == 0


def test_a_set_that_a_third_of_the_rows_hold(spark):
    rows = docs(spark, []).unionByName(spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot " * 20)).otherwise(F.concat_ws(" ", *[F.concat(F.lit(c), F.col("id")) for c in "abcdefgh"])).alias("text"),
        *[F.lit(None).cast(k).alias(c) for c, k in docs(spark, []).dtypes[2:]]))
    found = superminhash.near_components(rows)
    assert found.where("doc_id is null and component_id is null").count() == 1000 and found.where("kept").count() == 3000


def test_slots_estimate_similarity_and_ranks_of_an_element_differ():
    draw = np.random.default_rng(1)
    sets = []
    for _ in range(60):
        base = draw.integers(0, 2**63, 300).astype(np.uint64)
        other = base.copy()
        other[:45] = draw.integers(0, 2**63, 45).astype(np.uint64)
        sets += [np.unique(base), np.unique(other)]
    drawn = superminhash.signatures(sets, 160)
    share = (drawn[::2] == drawn[1::2]).mean(axis=1)
    assert abs(share.mean() - 255 / 345) < 0.02 and share.std() < 0.05
    alone = superminhash.signatures([np.array([7], np.uint64)], 160)[0]
    assert sorted(np.floor(alone)) == list(range(160))
    assert all((superminhash.signatures([s], 160)[0] == d).all() for s, d in zip(sets[:5], drawn))
    assert np.isinf(superminhash.signatures([np.zeros(0, np.uint64)], 8)).all()
