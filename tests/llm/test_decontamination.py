"""Benchmark decontamination against brute force and its DuckDB SQL."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from quern.llm import decontamination as D
from quern.llm import oracles

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string, window string, hash long, n_words int", "item_id long, text string, item string, n int"


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item_id, t in items:
            it = words(t)
            k = min(10, len(it))
            wins = {tuple(it[i : i + k]) for i in range(len(it) - k + 1)} if it else set()
            for i in range(len(w) - k + 1 if it else 0):
                if tuple(w[i : i + k]) in wins:
                    hit |= set(range(i, i + k))
                    found.add(item_id)
        ids = sorted(str(i) for i in found if i is not None)
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def odd():
    r = random.Random(11)
    some = ["the", "The", "of", "Ärger", "x9", "don't", "日本", "ÉCOLE", "a-b", "10.5", "_", "  ", "\n", "the", "of", "K"]
    prose = lambda n: " ".join(r.choice(some) for _ in range(n))
    items = [(i, prose(r.choice([1, 2, 3, 4, 5, 6, 9, 10, 11, 14, 40]))) for i in range(10, 34)]
    items += [(1, None), (2, ""), (3, "..."), (None, prose(12)), (4, items[5][1]), (4, items[5][1]), (5, "zzz qqq"), (6, "the " * 30), (7, "never " + prose(20) + " seen")]
    docs = [(1, None), (2, ""), (None, prose(30)), (3, " ."), (4, "zzz"), (4, "Zzz, QQQ!"), (5, "the " * 25), (6, "zzz  qqq zzz qqq"), (8, "qqq"), (9, "")]
    for i in range(100, 180):
        parts = [r.choice(items)[1] or "" for _ in range(r.randint(0, 3))]
        cut = [" ".join(p.split(" ")[r.randint(0, 2) : len(p) - r.randint(0, 3)]) for p in parts]
        docs.append((i, prose(r.randint(0, 30)).join([r.choice(["", "so "]), *cut, r.choice(["", " end"])])))
    return [*docs, *docs[20:25], (500, prose(60_000))], items


def run(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], DOCS).repartition(5)
    b = spark.createDataFrame([(i, t, "x", 1) for i, t in items], ITEMS).repartition(2)
    return D.report(d, b, **options)


@pytest.mark.parametrize("options", [{}, {"most_bits": 1 << 15, "held": 50}, {"shingle": 1}, {"shingle": 3}])
def test_report_is_brute_force(spark, monkeypatch, options):
    monkeypatch.setattr(D, "LEAST_BITS", 1 << 15)
    docs, items = odd()
    got = run(spark, docs, items, **options)
    assert got.columns == ["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    got, want = sorted(map(tuple, got.collect()), key=str), brute(docs, items)
    assert [(a, b) for a, b in zip(got, want, strict=True) if a != b] == []


def test_sql_says_the_same(spark, tmp_path):
    docs, items = odd()
    docs = docs[:-1]  # the SQL takes the square of a text's length
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    cur = con.execute(oracles.DECONTAMINATION)
    got = D.query(spark, str(tmp_path))
    assert [c[0] for c in cur.description] == got.columns
    assert sorted(cur.fetchall(), key=str) == sorted(map(tuple, got.collect()), key=str) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = odd()
    assert run(spark, [], items).collect() == []
    rows = run(spark, docs[:20], []).collect()
    assert len(rows) == 20 and not any(r.contaminated or r.n_hit or r.n_items for r in rows)


def test_a_passage_in_every_document_and_one_window_in_many_items(spark):
    passage = " ".join(f"word{i}" for i in range(30))
    docs = [(i, f"start {i} {passage} and {passage}") for i in range(400)]
    items = [(i, " ".join(f"word{j}" for j in range(15)) + f" own{i}") for i in range(50)]
    rows = run(spark, docs, items).collect()
    want = hashlib.sha256(",".join(sorted(map(str, range(50)))).encode()).hexdigest()
    assert {(r.n_hit, r.n_items, r.items_sha256) for r in rows} == {(30, 50, want)} and len(rows) == 400


def test_only_the_rarest_shingle_is_joined(spark):
    common, rare = " ".join(f"w{i}" for i in range(9)), "w0 w1 w2 w3 w4 w5 w6 w7 w8 seldom"
    docs = spark.createDataFrame([(i, common) for i in range(300)] + [(999, rare)], "doc_id long, text string")
    texts, found, _ = D.find(docs, spark.createDataFrame([(1, rare)], "item_id long, text string"))
    assert texts.count() == 301 and [tuple(r) for r in found.select("first", "n").collect()] == [(0, 10)]
    windows = D.windows_of(spark.createDataFrame([(1, rare)], "item_id long, text string"))
    at = D.Words([common])
    counts = spark.createDataFrame([(int(h), 301) for h in at.shingles(5)[1]] + [(int(h), 1) for h in D.Words([rare]).shingles(5)[1][-1:]], "hash long, times long")
    assert [(r.place, r.n) for r in D._prefixes(windows, counts).collect()] == [(5, 10)]


def test_words_in_chunks(monkeypatch):
    texts = odd()[0]
    whole = D.Words([t for _, t in texts])
    monkeypatch.setattr(D, "CHUNK", 7)
    parts = D.Words([t for _, t in texts])
    assert np.array_equal(whole.hash, parts.hash) and np.array_equal(whole.bounds, parts.bounds)
    for i, (_, t) in enumerate(texts):
        a, b = whole.bounds[i], whole.bounds[i + 1]
        assert [x.decode() for x in whole.words(a, b)] == words(t)
    for k in (1, 3, 5):
        first, h = whole.shingles(k)
        want = [j for i in range(len(texts)) for j in range(whole.bounds[i], whole.bounds[i + 1] - k + 1)]
        assert first.tolist() == want and len(np.unique(h)) == len({tuple(whole.words(j, j + k)) for j in want})
