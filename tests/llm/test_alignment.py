import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from trialweave.llm import alignment


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(f"{alignment.FOLDER}/{alignment.BYTE_BPE}")
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=f"{alignment.FOLDER}/{alignment.PIECE_BPE}")


def byte_level():
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(visible)))}


def spans(tokens):
    ends = np.cumsum([len(t) for t in tokens]).tolist()
    return list(zip([0, *ends[:-1]], ends))


def brute(texts, libraries):
    """Rows by walking two lists of byte ranges, counts by a dictionary."""
    a, b = libraries
    chars, docs, counts = byte_level(), [], Counter()
    for text in texts:
        ids_a, ids_b = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        bytes_a = [bytes(chars[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
        want = (" " + text).encode() if text else None
        if want is None or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            docs.append(None)
            continue
        left, right = spans(bytes_a), spans(bytes_b)
        links, i, j = [], 0, 0
        while i < len(left) and j < len(right):
            links.append((ids_a[i], ids_b[j]))
            end = min(left[i][1], right[j][1])
            i, j = i + (left[i][1] == end), j + (right[j][1] == end)
        shared = sorted({e for _, e in left} & {e for _, e in right})
        group = lambda own, ids: [",".join(str(x) for x, (s, _) in zip(ids, own) if lo <= s < hi) for lo, hi in zip([0, *shared], shared)]
        text_of = ";".join(f"{x}|{y}" for x, y in zip(group(left, ids_a), group(right, ids_b))) if len(ids_a) < 3000 else None
        docs.append((len(ids_a), len(ids_b), len(shared), links, text_of))
        counts.update(set(links))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for found in docs:
        if found is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, n_groups, links, text_of = found
        sha = None if text_of is None else hashlib.sha256(text_of.encode()).hexdigest()
        out.append((n_a, n_b, n_groups, len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links), sha))
    return out


TEXTS = ["Hello world", "Hello  world\n\n", "", None, "\ttab and <|endoftext|> and <s>x</s>", "▁x", "漢字 ﬁ é é \u0000", " lead", "Hello world",
         "e" * 5000, " ".join(f"word{k}" for k in range(20_000)), "🙂👩‍👩‍👧 ok", "123 4567 don't", " "]


@pytest.mark.parametrize("limits", [{}, {"shard_keys": 2000, "table_keys": 12_000, "lane_rows": 3000}])
def test_rows_equal_brute_force(spark, libraries, limits):
    rows = [(k if k != 5 else None, t, "x", 1, b"a", "key") for k, t in enumerate(TEXTS)]
    table = spark.createDataFrame(rows, "doc_id long, text string, row string, n int, a binary, key string").repartition(5)
    got = {r["doc_id"]: tuple(r)[1:] for r in alignment.align(table, **limits).collect()}
    want = brute(TEXTS, libraries)
    assert len(got) == len(TEXTS)
    for k, expected in enumerate(want):
        found = got[k if k != 5 else None]
        assert found[:6] == expected[:6], TEXTS[k]
        assert expected[6] is None or found[6] == expected[6]


@pytest.mark.parametrize("limits", [{}, {"shard_keys": 500, "table_keys": 3000, "lane_rows": 2000}])
def test_query_equals_brute_force(spark, small_dir, libraries, limits):
    table = spark.read.parquet(f"{small_dir}/documents.parquet")
    rows = table.select("doc_id", "text").orderBy("doc_id").collect()
    got = [tuple(r)[1:] for r in alignment.align(table, **limits).orderBy("doc_id").collect()]
    want = brute([r["text"] for r in rows], libraries)
    assert [g[:6] for g in got] == [w[:6] for w in want]
    assert all(w[6] in (None, g[6]) for g, w in zip(got, want))


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_both_libraries_cut_every_code_point_alike(libraries):
    own = alignment.Tokenizers()
    texts = [f" a{chr(c)}b 1{chr(c)}2 {chr(c)} ,{chr(c)}." for c in range(0, 0x110000, 11) if not 0xD800 <= c <= 0xDFFF]
    assert [own.a.encode_ordinary(t) for t in texts] == [e.ids for e in libraries[0].encode_batch_fast(texts, add_special_tokens=False)]


@pytest.mark.parametrize("n", [1, 2, 3, 1000, 20_000])
def test_hash_is_minimal_and_perfect(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**50, n))
    seeds, placed = alignment.place_keys(keys)
    index = alignment.PairTable([(0, seeds.tobytes(), placed.tobytes(), np.arange(len(keys)).tobytes())], 1)
    assert sorted(index.places(keys).tolist()) == list(range(len(keys)))
    known, _ = index.lookup(keys + (1 << 51))
    assert not known.any() and index.lookup(keys)[0].all()
