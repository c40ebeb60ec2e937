import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from trialweave.llm import exact_dedup, line_dedup, simhash
from trialweave.llm.common import components

DOCS = "doc_id long, text string, source string, digest string, n int, best int, print long, group_size string, _site int"
LONG = "word " * 40_000


def docs(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, s, "x", 1, 2, 3, "y", 4) for i, t, s in rows], DOCS)


ROWS = [(1, "a b", "s"), (2, "ab", "s"), (3, "ab\n", None), (3, "ab\n", None), (4, None, "s"), (5, "", "t"), (6, " \t", "t"),
        (7, LONG, "t"), (8, LONG, "t"), (9, "Other", "t"), (None, "other", "t"), (None, "Other", "t")]


def brute_exact(rows):
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t, _ in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(groups[bare])[3]
        out.append((i, keep, len(groups[bare]), i == keep, hashlib.sha256(bare.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("counters", [1, 2, 1024])
def test_exact_dedup(spark, counters):
    got = exact_dedup.exact_dedup(docs(spark, ROWS), counters=counters).collect()
    assert sorted(map(tuple, got), key=str) == brute_exact(ROWS)


@pytest.mark.parametrize("counters", [1, 1024])
def test_of_rows_that_tie_one_stays(spark, counters):
    rows = [(4, "x y", "s")] * 50 + [(None, "z", "s")] * 3 + [(5, "x y", "s"), (6, "xy", None)]
    got = exact_dedup.exact_dedup(docs(spark, rows).repartition(5), counters=counters).collect()
    assert len(got) == len(rows) and sorted((r.keep_id, r.kept) for r in got if r.kept and r.doc_id is not None) == [(4, True)]
    assert sum(r.kept for r in got if r.doc_id is None) == 1
    assert {r.group_size for r in got} == {52, 3}


def test_heavy_digests_are_found_and_bounded(spark):
    table = spark.range(4000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).cast("binary").alias("digest"))
    found = [bytes(r.digest) for r in exact_dedup.heavy_digests(table.repartition(7), 10).collect()]
    assert b"hot" in found and len(found) <= 10


def test_empty_tables(spark):
    none = docs(spark, [])
    assert exact_dedup.exact_dedup(none).count() == 0
    assert simhash.simhash_components(none).count() == 0
    assert line_dedup.drop_boilerplate(none).count() == 0


def brute_print(text):
    words = text.encode().lower().split()
    made = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in made]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark):
    texts = ["", "One", "One two", "one TWO three four", "Ünï cödé  wörds \x0b here\ttoo", "a b c " * 50, LONG]
    assert [int.from_bytes(simhash.fingerprint(t.encode())) for t in texts] == [brute_print(t) for t in texts]


def top(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def brute_components(prints):
    parent = {p: p for p in prints}
    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                x, y = top(parent, a), top(parent, b)
                parent[max(x, y)] = min(x, y)
    return {p: top(parent, p) for p in prints}


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, max(1, n // 20))
    flips = np.array([1 << int(b) for b in range(64)], dtype=np.uint64)
    out = []
    for _ in range(n):
        p = np.uint64(rng.choice(centres))
        for b in rng.integers(0, 64, rng.integers(0, 6)):
            p ^= flips[b]
        out.append(int(p))
    return sorted(set(out))


def test_trie_finds_every_pair_once():
    values = np.array(clustered(1500, 1), np.uint64)
    want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if int(values[i] ^ values[j]).bit_count() <= 3}
    found = [(int(i), int(j)) for a, b in simhash.trie_links(values, values, True, 3) for i, j in zip(a, b, strict=True)]
    assert len(found) == len(want) and set(found) == want
    a, b = values[::2], values[1::2]
    found = [(int(a[i]), int(b[j])) for x, y in simhash.trie_links(a, b, False, 3) for i, j in zip(x, y, strict=True)]
    assert sorted(found) == sorted((int(x), int(y)) for x in a for y in b if int(x ^ y).bit_count() <= 3)


def test_links_keep_components_across_dense_nodes(spark):
    prints = clustered(2600, 2)
    dense = [int(x) for x in {prints[0] ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(40)}]  # a third in one node
    prints = sorted(set(prints) | set(dense))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = components(simhash.near_links(spark.createDataFrame([(p,) for p in signed], "print long"), 3, node_size=64)).collect()
    want = brute_components(prints)
    size = {}
    for p in prints:
        size[want[p]] = size.get(want[p], 0) + 1
    got = {r.node % (1 << 64): r.root % (1 << 64) for r in found}
    assert set(got) == {p for p in prints if size[want[p]] > 1}
    groups = {}
    for p, r in got.items():
        groups.setdefault(want[p], set()).add(r)
    assert all(len(r) == 1 for r in groups.values()) and len(groups) == len({r for g in groups.values() for r in g})


def test_components_of_a_long_path(spark):
    links = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {(r.node, r.root) for r in components(links).collect()} == {(k, 0) for k in range(301)}


def test_simhash_rows(spark):
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_components(docs(spark, ROWS)).collect()), key=str)
    prints = {}
    for i, t, _ in ROWS:
        prints.setdefault(brute_print(t or ""), []).append(i)
    roots = brute_components(sorted(prints))
    first = {}
    for p, ids in prints.items():
        first[roots[p]] = min([*(i for i in ids if i is not None), first.get(roots[p], 10**9)])
    want = sorted(((i, f"{brute_print(t or ''):016x}", first[roots[brute_print(t or '')]]) for i, t, _ in ROWS), key=str)
    assert got == want


def brute_lines(rows, ratio, least):
    pages, found = {}, {}
    for _, t, s in rows:
        pages[s] = pages.get(s, 0) + 1
        for line in {x.strip(" \t\r\x0b\x0c") for x in (t or "").split("\n")} - {""}:
            found[s, line] = found.get((s, line), 0) + 1
    out = []
    for i, t, s in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not ((n := found.get((s, x.strip(" \t\r\x0b\x0c")), 0)) >= least and n > ratio * pages[s])]
        out.append((i, None if t is None else "\n".join(kept), s, len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_line_dedup(spark):
    rows = [(k, f"Menu\nline {k}\n\n  Menu \nshared {k % 3}\n", "hot" if k % 3 else None) for k in range(60)]
    rows += [(100, None, "hot"), (101, "", "hot"), (102, "Menu", "small"), (103, "Menu\nMenu\nMenu", "hot"), (104, LONG, "hot"), (104, LONG, "hot")]
    got = line_dedup.drop_boilerplate(docs(spark, rows), ratio=0.3, min_pages=3)
    assert {"digest", "best", "_site", "group_size"} <= set(got.columns)
    assert sorted(((r.doc_id, r.text, r.source, r.n_lines, r.n_dropped) for r in got.collect()), key=str) == brute_lines(rows, 0.3, 3)
