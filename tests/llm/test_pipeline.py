from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from trialweave.llm import common, decontaminate, exact_dedup, line_dedup, ordinal, queries, simhash


def test_stages_are_dealt_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "mix"]
    assert sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0])) == [n for n in sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))]
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))


def test_pipeline_on_planted_cases(spark, small_dir):
    """Each stage does its work on what the one before kept, and leaves clean documents."""
    docs = common.table(spark, small_dir, "documents")
    item = common.table(spark, small_dir, "benchmark").orderBy("item_id").first().text
    clean = "Quite plain words about weather, gardens, rivers and a long quiet walk home in spring rain"
    rows = [(900_001, clean, "en", "planted", 1), (900_002, clean, "en", "planted", 1), (900_003, f"{item} and words of its own", "en", "planted", 1), (900_004, None, None, None, None)]
    docs = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    kept, columns = docs, docs.columns
    ids = []
    for name, stage in corpus_pipeline.STAGES:
        kept = common.stored(stage(spark, kept, small_dir))
        ids.append({r.doc_id for r in kept.select("doc_id").collect()})
        assert name == "mix" or kept.columns == columns
    assert ids[1] == ids[0] and {900_001, 900_002, 900_003} <= ids[1]
    assert 900_001 in ids[2] and 900_002 not in ids[2]
    assert 900_001 in ids[3] and 900_003 not in ids[3]
    assert all(later <= before for before, later in zip(ids, ids[1:], strict=False))
    row = kept.agg(F.sum("taken").alias("taken"), F.min("taken").alias("least")).first()
    total = kept.groupBy("source").agg(F.first("target").alias("t")).agg(F.sum("t")).first()[0]
    assert row.least > 0 and abs(row.taken - total) <= 21


def test_empty_documents_pass_through(spark, small_dir):
    kept = common.table(spark, small_dir, "documents").where("doc_id < -5")
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, small_dir)
    assert kept.count() == 0
    assert exact_dedup.exact_dedup(kept.select("doc_id", "text")).count() == 0


def test_stages_take_nulls_repeats_and_clashing_columns(spark, small_dir):
    docs = common.table(spark, small_dir, "documents").where("doc_id < 40")
    clean = "Calm notes on how bread is baked slowly at home while the rain falls on an old tin roof"
    odd = [(None, clean, "en", None, 1), (900_010, clean + " again", "en", "odd", 1), (900_010, clean + " again", "en", "odd", 1), (900_011, "", None, None, None), (900_012, None, "en", "odd", 0)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumns({c: F.lit("x") for c in ("taken", "toxic", "_site", "print", "size", "n_lines", "item_id")})
    clash = set(docs.columns)
    for name, stage in corpus_pipeline.STAGES:
        made = common.stored(stage(spark, docs, small_dir))
        assert clash <= set(made.columns) and len(set(made.columns)) == len(made.columns), name
        rows = made.where("doc_id is null or doc_id = 900010").collect()
        assert len(rows) <= 3, name
        assert name == "mix" or len(rows) == (2 if name == "simhash_near_dedup" else 3), name
    assert {r.taken for r in rows if r.doc_id == 900_010} <= set(range(1, 2 * 20 + 1))
    twice = [r.taken for r in rows if r.doc_id == 900_010]
    assert len(twice) in (0, 2) and len(set(twice)) <= 1
    assert made.where("taken > 2 * size").count() == 0


def test_rows_without_an_id_or_with_a_shared_one_are_documents_of_their_own(spark, small_dir):
    """Each row is judged by its own text: null ids, one id with two texts, one id in two components."""
    first = "Quite plain words about weather, gardens, rivers and a long quiet walk home in spring rain"
    other = "Old bakers on the corner keep rye bread warm under linen until the late tram has rung its bell"
    third = "Seven grey geese crossed the frozen marsh at dawn while the miller counted sacks of barley flour"
    item = common.table(spark, small_dir, "benchmark").orderBy("item_id").first().text
    half = item.split()
    rows = [(None, first), (None, other), (None, third), (None, third), (7, first), (7, other), (8, other), (9, third + " again"), (9, item),
            (10, " ".join(half[: len(half) * 2 // 5])), (10, " ".join(half[len(half) * 2 // 5 :][: len(half) * 2 // 5]))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    near = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, small_dir)
    kept = sorted(((r.doc_id, r.text) for r in near.collect()), key=str)
    again = sorted(((r.doc_id, r.text) for r in dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs.repartition(5), small_dir).collect()), key=str)
    assert kept == again and len(kept) == len(brute_near(rows)) and sorted(kept, key=str) == sorted(brute_near(rows), key=str)
    clean = dict(corpus_pipeline.STAGES)["benchmark_decontamination"](spark, docs, small_dir)
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=str) == sorted((r for r in rows if r[1] != item), key=str)


def brute_near(rows):
    """One row of each component: pairs of fingerprints compared one by one."""
    prints = [int.from_bytes(simhash.fingerprint((t or "").encode())) for _, t in rows]
    component = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= simhash.MAX_BITS:
                low, high = sorted((component[a], component[b]))
                component = [low if c == high else c for c in component]
    groups = {}
    for row, c in zip(rows, component):
        groups.setdefault(c, []).append(row)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def test_pipeline_equals_its_stages_run_in_memory(spark, small_dir):
    """run() over the written stages against each stage's decision taken again from whole rows held here."""
    docs = common.table(spark, small_dir, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    labels = common.table(spark, small_dir, "labels")
    severe = {r.doc_id for r in ordinal.with_severity(docs, ordinal.fit(docs, labels)).where("toxic").collect()}
    kept = [r for i, r in sorted(rows.items()) if i not in severe]
    pages, held = Counter(r.source for r in kept), Counter()
    strip = " \t\v\f\r"
    for r in kept:
        held.update({(r.source, x.strip(strip)) for x in (r.text or "").split("\n")})
    boiler = {k for k, n in held.items() if k[1] and n >= line_dedup.MIN_PAGES and n > line_dedup.RATIO * pages[k[0]]}
    texts = [(r.doc_id, "\n".join(x for x in (r.text or "").split("\n") if (r.source, x.strip(strip)) not in boiler)) for r in kept]
    near = brute_near(texts)
    left = spark.createDataFrame(near, "doc_id long, text string")
    dirty = {r.doc_id for r in decontaminate.contaminated(left, common.table(spark, small_dir, "benchmark")).collect()}
    want = {i: t for i, t in near if i not in dirty}
    result = corpus_pipeline.run(spark, small_dir).collect()
    assert len({r.doc_id for r in result}) == len(result) and all(want[r.doc_id] == r.text for r in result)
    size = {i: len(t.split()) for i, t in want.items()}
    assert {r.doc_id: r["size"] for r in result} == {r.doc_id: size[r.doc_id] for r in result}
    assert all(0 < r.taken <= 2 * r["size"] for r in result)
