"""Training-data operators on small inputs: brute force, round trips, edge cases, held-out accuracy."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import (
    best_fit_packing,
    chat_format,
    chosen_path_join,
    html_extraction,
    language_id,
    lm_trie,
    multi_index_hashing,
    quality_crf,
    sentencepiece_tokenizers,
    spherical_filters,
)
from quern.llm.elias_fano import EliasFano, dump, load

SF = "/root/testdata/sf0.001"
P = pytest.importorskip("public_tokenizers")
EDGE = [(1, None), (2, ""), (3, "  \n\t "), (4, "word"), (5, "a  b \n c  "), (6, "word"), (6, "word"), (None, "some text here"), (7, "ü€😀 <|endoftext|> x" * 3), (8, "long text " * 3000)]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, "en", "s", 1, "x") for i, t in EDGE], "doc_id long, text string, lang string, score string, length int, ids string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# ------------------------------------------------------------ packing


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plan_keeps_every_capacity(rule):
    r = random.Random(3)
    hist = {r.randint(1, 72): r.randint(1, 40) for _ in range(60)}
    runs = best_fit_packing.plan(hist, 100, 4, 5200, rule)
    lengths = np.concatenate([np.full(c, n) for n, c in hist.items()])
    ranks = np.concatenate([np.arange(c) for c in hist.values()])
    seq, off = best_fit_packing.locate(runs, lengths, ranks)
    for s in np.unique(seq):
        n = lengths[seq == s]
        o = np.argsort(off[seq == s])
        assert n.sum() <= 100 and len(n) <= 4 and (n**2).sum() <= 5200
        assert (off[seq == s][o] == np.cumsum(n[o]) - n[o]).all()


def test_packing_round_trip(spark, edge):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = best_fit_packing.pack_documents(edge, P.path("byte_bpe_50k.json")).collect()
    want = sorted(tuple(tok.encode(t or "", add_special_tokens=False).ids + [0]) for _, t in EDGE)
    parts = {}
    for r in rows:
        assert len(r.ids) == r.length <= 2048 and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        parts.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in parts.values():
        at = 0
        for o, n in sorted(p):
            assert o == at
            at += n
        assert at <= 2048
    long = sorted((r.piece, r.start, list(r.ids)) for r in rows if r.doc_id == 8)
    assert [x for p in long for x in p[2]] == list(want[[len(w) for w in want].index(max(map(len, want)))])
    assert sorted(tuple(r.ids) for r in rows if r.doc_id != 8) == sorted(w for w in want if len(w) <= 2048)


def test_segments_are_encoded_as_one_by_one():
    from tokenizers import Tokenizer

    from quern.llm._words import Segments, by_lead

    draw = random.Random(4)
    odd = ["", "a  b", "\n", "x\n", "\nx", "a\n\nb", "\u00a0", "<|endoftext|>", "a<|endoftext|>b", "\u0120a", "''s", "\U0001f600", "\u3000z", "12.5", "\x1c", "a\tb"]
    segments = odd + ["".join(draw.choice("ab.'\n9é\u0120\U0001f600<|>") for _ in range(draw.randint(1, 9))) for _ in range(4000)]
    segments = sorted(set(segments), key=lambda _: draw.random())
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        tok = Tokenizer.from_file(P.path(name))
        vocabulary = tok.get_vocab()
        lead = np.zeros(max(vocabulary.values()) + 1, bool)
        lead[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True
        want = [e.ids for e in tok.encode_batch([" " + s for s in segments], add_special_tokens=False)]
        known = Segments(by_lead(tok, lead, " ", 7), size=20_000)  # forgets again and again
        for i in range(0, len(segments), 300):
            at = known.numbers(segments[i : i + 300])
            assert known.ids(at).tolist() == [x for w in want[i : i + 300] for x in w]
            assert known.columns[1][at].tolist() == [len(w) for w in want[i : i + 300]]


TEXTS = [None, "", "  \n\t ", "a  b", "\n", "x\n", "\nx", "a\n\nb", "\u00a0", "<|endoftext|>", "a <|endoftext|> b", "\u0120a", " lead", "trail ", "''s don't", "\U0001f600  \0 \x000\0 z", "\0 0\0  \0", "\u3000 z", "a \u3000z", "12.5  ", "\x1c", "a\tb \x1c c\0d  e", " x " * 5000]
_draw = random.Random(7)
TEXTS += ["".join(_draw.choice("   \n\t\u3000\x1c\u00a0ab'1") for _ in range(_draw.randint(1, 12))) for _ in range(1500)]


def test_packing_gives_the_ids_of_whole_texts(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for capacity in (7, 2048, 4096):
        rows = best_fit_packing.pack_documents(df, P.path("byte_bpe_50k.json"), capacity=capacity).orderBy("doc_id", "piece").collect()
        of = {}
        for r in rows:
            of.setdefault(r.doc_id, []).append(r)
        for i, t in enumerate(TEXTS):
            mine = of[i]
            want = tok.encode(t or "", add_special_tokens=False).ids + [0]
            assert [x for r in mine for x in r.ids] == want and [r.start for r in mine] == [sum(m.length for m in mine[:k]) for k in range(len(mine))]
            assert all(r.length == capacity for r in mine[1:]) and mine[0].length <= capacity


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_packing_needs_as_few_sequences_as_there_can_be(spark, sf):
    d = SF.replace("0.001", sf)
    rows = best_fit_packing.query(spark, d).collect()
    bound = -(-sum(r.length for r in rows) // 2048)
    assert bound <= len({r.sequence_id for r in rows}) <= bound + 1


def test_packing_of_ties_and_tight_capacities():
    runs = best_fit_packing.plan({5: 1000}, 10, 1, 100)  # one document a sequence
    assert runs[:, 5].tolist() == [1]
    seq, off = best_fit_packing.locate(best_fit_packing.plan({5: 1000}, 10), np.full(1000, 5), np.arange(1000))
    assert len(set(zip(seq.tolist(), off.tolist(), strict=True))) == 1000 and seq.max() == 499
    with pytest.raises(ValueError, match="does not fit"):
        best_fit_packing.plan({11: 1}, 10)


def test_packing_of_nothing(spark, edge):
    assert best_fit_packing.pack_documents(edge.limit(0), P.path("byte_bpe_50k.json")).count() == 0


# ------------------------------------------------------------ near copies


def brute_classes(rows, n=5, least=0.8):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    group = list(range(len(rows)))
    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and len(a & b) >= least * len(a | b):
                links[i] += 1
                links[j] += 1
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least_id = {g: min(rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None) for g in set(group) if any(rows[i][0] is not None for i in range(len(rows)) if group[i] == g)}
    return sorted((str(r[0]), links[i], str(least_id.get(group[i]))) for i, r in enumerate(rows))


def test_chosen_path_join_is_brute_force(spark, edge):
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = list(EDGE)
    for g in range(12):
        base = [r.choice(words) for _ in range(r.randint(5, 150))]
        for _ in range(r.randint(1, 25)):
            copy = [w if r.random() > 0.004 else r.choice(words) for w in base]
            rows.append((len(rows) + 100, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = chosen_path_join.join(df, limit=8).collect()
    assert sorted((str(x.doc_id), x.n_links, str(x.class_id)) for x in got) == brute_classes(rows)
    kept = chosen_path_join.keep_one(df)
    assert kept.columns == df.columns and kept.where("doc_id = 6").count() <= 1


def test_links_of_a_group_of_many_blocks(spark):
    r = random.Random(8)
    base = [f"w{r.randint(0, 400)}" for _ in range(150)]
    rows = [(i, " ".join([*base[:-1], f"x{i}"] if i % 3 else [*base, f"y{i}"])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = chosen_path_join.join(df, limit=8, block=8).collect()
    assert sorted((str(x.doc_id), x.n_links, str(x.class_id)) for x in got) == brute_classes(rows)


def test_join_of_nothing(spark, edge):
    assert chosen_path_join.join(edge.limit(0)).count() == 0
    assert chosen_path_join.keep_one(edge.limit(0)).columns == edge.columns and chosen_path_join.keep_one(edge.limit(0)).count() == 0


def test_join_with_clashing_columns_and_ids_of_text(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [("b", text, 1, "k", "x"), ("a", text + " more", 2, "k", "x"), ("c", "quite another text of some words", 3, "k", "x"), (None, text, 4, "k", "x"), ("d", None, 5, "k", "x")]
    df = spark.createDataFrame(rows, "doc_id string, text string, n_links int, key string, class_id string")
    got = {r.doc_id: (r.n_links, r.class_id, r.kept) for r in chosen_path_join.join(df).collect()}
    assert got == {"a": (1, "a", True), "b": (1, "a", False), "c": (0, "c", True), "d": (0, "d", True), None: (0, None, True)}
    kept = chosen_path_join.keep_one(df)
    assert kept.columns == df.columns and sorted(r.n_links for r in kept.collect()) == [2, 3, 4, 5]


def test_rows_that_repeat_an_id_are_judged_by_their_texts(spark):
    x, y, z = (" ".join(f"{c}{i}" for i in range(60)) for c in "xyz")
    rows = [(1, x, "a"), (1, y, "b"), (2, z, "c"), (3, x, "d"), (1, x, "e"), (1, x, "e"), (4, None, "f"), (4, None, "g"), (5, z + " tail", "h"), (5, y + " tail", "i"), (None, x, "j")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string")
    kept = sorted((str(r.doc_id), r.row) for r in chosen_path_join.keep_one(df).collect())
    assert kept == [("1", "a"), ("1", "b"), ("2", "c"), ("4", "f"), ("4", "g"), ("None", "j")]
    assert sorted(r.row for r in chosen_path_join.keep_one(df.where("doc_id = 5 OR row = 'b'")).collect()) == ["b", "h"]


def test_depth_grows_with_the_sets():
    assert [chosen_path_join.levels_for(n) for n in (0, 1, 10**5, 10**6, 10**7, 10**9)] == [3, 3, 3, 3, 4, 6]
    assert chosen_path_join.runs_needed(0.8, 6) > chosen_path_join.runs_needed(0.8, 3)


def test_deeper_recursion_finds_all_links(spark):
    r = random.Random(9)
    rows = []
    for g in range(30):
        base = [f"g{g}w{r.randint(0, 400)}" for _ in range(120)]
        rows += [(len(rows) + k, " ".join(base[:-3] + [f"t{len(rows) + k}"] * 3)) for k in range(4)]
    got = chosen_path_join.join(spark.createDataFrame(rows, "doc_id long, text string"), limit=2, levels=6).collect()
    assert sorted((str(x.doc_id), x.n_links, str(x.class_id)) for x in got) == brute_classes(rows)


def test_units_are_cut_by_bytes(spark):
    from quern.llm._links import compare
    from quern.llm._common import stage

    members = stage(spark.createDataFrame([(7, k) for k in range(40)] + [(8, 1), (8, 2)], "leaf long, key long"))
    payloads = spark.createDataFrame([(k, [k % 4], 1, 100) for k in range(40)], "key long, payload array<long>, weight long, bytes long")
    sizes = []

    def same(sets, split):
        x = sets.flatten().to_numpy()
        a, b = (slice(None),) * 2 if split is None else (slice(0, split), slice(split, None))
        assert len(x) <= 40
        return x[a][:, None] == x[b][None, :]

    for most in (100_000, 500, 1):
        out = compare(members, payloads, same, block_bytes=most)
        assert sorted((r.key, r.n) for r in out.groupBy("key").agg(F.sum("links").alias("n")).collect()) == [(k, 9) for k in range(40)], (most, sizes)


# ------------------------------------------------------------ language model


def test_elias_fano():
    r = np.random.default_rng(0)
    for n, u in ((1000, 1 << 63), (5000, 1 << 20), (1, 100), (3000, 1000), (0, 10)):
        v = np.sort(r.integers(0, u, n, dtype=np.uint64))
        e = EliasFano(load(dump(EliasFano.build(v, u).a)))
        x = np.concatenate([v, r.integers(0, u, 200, dtype=np.uint64)])
        at, same = e.find(x)
        assert (e.get(np.arange(n)) == v).all() and (same == np.isin(x, v)).all()
        assert n == 0 or (at[same] == np.searchsorted(v, x[same])).all()


def test_elias_fano_search_within_bounds():
    r = np.random.default_rng(1)
    v = np.sort(r.integers(0, 5000, 2000, dtype=np.uint64))
    e, x = EliasFano.build(v, 5000), r.integers(0, 5000, 3000, dtype=np.uint64)
    lo = r.integers(0, 2000, 3000)
    hi = np.minimum(lo + r.integers(0, 900, 3000), 2000)
    at, same = e.find(x, lo, hi)
    for k in range(3000):
        want = x[k] in v[lo[k] : hi[k]]
        assert same[k] == want and (not want or lo[k] <= at[k] < hi[k] and v[at[k]] == x[k])


def brute_lm(rows, order):
    """{id: (n_tokens, n_known, base score, score)}, tokens and vocabulary, from (id, text, learn)."""
    import re
    from collections import Counter

    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    toks = [["<s>", *re.findall(r"[^\x20\x09-\x0D]+", low(t)), "</s>"] for _, t, _ in rows]
    seen = [Counter() for _ in range(order + 1)]
    for t, (_, _, learn) in zip(toks, rows, strict=True):
        for i in range(1, len(t) if learn else 0):
            for k in range(1, min(order, i + 1) + 1):
                seen[k][tuple(t[i - k + 1 : i + 1])] += 1
    N, V = sum(seen[1].values()), len(seen[1])
    mass, kinds = Counter(), Counter()
    for k in range(2, order + 1):
        for g, c in seen[k].items():
            mass[g[:-1]] += c
            kinds[g[:-1]] += 1

    def p(g):
        if len(g) == 1:
            return (seen[1][g] - lm_trie.DISCOUNT_1 if seen[1][g] else max(lm_trie.DISCOUNT_1 * V, 0.5)) / N if N else 1.0
        d = lm_trie.DISCOUNTS[len(g) - 2]
        return max(seen[len(g)][g] - d, 0) / mass[g[:-1]] + d * kinds[g[:-1]] / mass[g[:-1]] * p(g[1:]) if mass[g[:-1]] else p(g[1:])

    out = {}
    for (i, _, _), t in zip(rows, toks, strict=True):
        score = sum(np.log10(p(tuple(t[max(0, k - order + 1) : k + 1]))) for k in range(1, len(t)))
        out[i] = (len(t) - 1, sum(seen[1][w,] > 0 for w in t[1:]), sum(np.log10((seen[1][w,] + 1) / (N + 1 * (V + 1))) for w in t[1:]), score)
    return out, N, V


def lm_rows(n=120):
    r = random.Random(6)
    text = lambda: " ".join(f"w{int(r.paretovariate(0.7)) % 60}" for _ in range(r.randint(0, 30)))
    return [(i, t, i % 5 != 0) for i, t in enumerate([text() for _ in range(n)] + [None, "", "  \n", "W1 w1\tw2", "w2 w3 " * 900, "unseen words only"])]


@pytest.mark.parametrize("order", [2, 3])
@pytest.mark.parametrize("shards", [1, 6])
def test_lm_scores_are_brute_force(spark, order, shards):
    rows = lm_rows()
    df = spark.createDataFrame([(i, t, f, 1.0, "x") for i, t, f in rows], "doc_id long, text string, learn boolean, score double, id string").repartition(3)
    want, total, vocabulary = brute_lm(rows, order)
    out, n, v = lm_trie.score(df, F.col("learn"), order=order, block_tokens=200, shard_tokens=2000 // shards)
    assert (n, v) == (total, vocabulary) and out.count() == len(rows)
    for x in out.collect():
        n_tokens, n_known, base, score = want[x.doc_id]
        assert (x.n_tokens, x.n_known) == (n_tokens, n_known) and abs(x.base_score - base) < 1e-9 * (1 + n_tokens)
        assert abs(x.score - score) <= lm_trie.STEP / 2 * order * n_tokens  # up to `order` rounded values by one another


def test_lm_common_contexts_are_shared_by_shards():
    """The trie answers alike whether or not the successors of common contexts are dealt to several shards."""
    rows = lm_rows()
    blocks = [rows[k::3] for k in range(3)]
    none = np.zeros(0, np.uint64)
    b = lm_trie.Block(*lm_trie.tokens([t or "" for _, t, _ in rows]), lm_trie.Deal())
    hot = []
    for k in range(2):
        n = np.bincount(b.node[k][b.node[k] >= 0], minlength=len(b.hashes[k]))
        hot.append(np.unique(np.append(b.hashes[k][np.argsort(-n)[:9]], lm_trie.START if k == 0 else b.hashes[k][:1])))
    want, total, vocabulary = brute_lm(rows, 3)
    for deal in (lm_trie.Deal(5, 3, (5, 4), (none, none), (none, none)), lm_trie.Deal(7, 3, (5, 4), tuple(hot), tuple(np.full(len(h), 4, np.uint64) for h in hot))):
        made, sent = [lm_trie.Block(*lm_trie.tokens([t or "" for _, t, _ in x]), deal) for x in blocks], {}
        for k, (block, x) in enumerate(zip(made, blocks, strict=True)):
            for shard, arrays in block.requests(np.array([f for _, _, f in x])):
                sent.setdefault(shard, []).append((k, load(dump(arrays))))
        answers, seen = [{} for _ in blocks], 0
        for s, x in sent.items():
            n_grams = lm_trie.Rows([a for _, a in x], deal)
            seen += n_grams.seen.sum()
            for (k, _), g in zip(x, n_grams.split(lm_trie.Trie.build(n_grams, deal).answer(n_grams)), strict=True):
                answers[k][s] = g
        assert seen == total
        for block, x, a in zip(made, blocks, answers, strict=True):
            scores = block.scores(a, total, vocabulary)
            for (i, _, _), score in zip(x, scores[3], strict=True):
                assert abs(score - want[i][3]) <= lm_trie.STEP / 2 * 3 * want[i][0]


def test_lm_finds_common_contexts(spark):
    df = spark.createDataFrame([(i, "the cat " + " ".join(f"x{i}_{k}" for k in range(8)), True) for i in range(300)], "id long, text string, learn boolean")
    deal = lm_trie.common(df, 300, lm_trie.Deal(16, 3))
    assert lm_trie.START in deal.hot[0] and len(deal.hot[0]) == 3 and len(deal.hot[1]) == 2  # START, the, cat; (START, the), (the, cat)
    assert all(p > 1 for x in deal.parts for p in x.tolist())


def test_lm_query(spark):
    d = SF.replace("0.001", "0.01")
    got = lm_trie.query(spark, d).collect()
    rows = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 7 != 2) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want, total, _ = brute_lm(rows, 3)
    learn = {i: f for i, _, f in rows}
    assert len(got) == len(rows)
    for x in got:
        assert x.train_tokens == total and x.held_out != learn[x.doc_id] and (x.n_tokens, x.n_known) == want[x.doc_id][:2]
        assert abs(x.base_score - want[x.doc_id][2]) < 1e-6 and abs(x.score - want[x.doc_id][3]) <= lm_trie.STEP / 2 * 3 * x.n_tokens  # up to three rounded values by one another
    held = [x for x in got if x.held_out]
    assert sum(x.score for x in held) > 0.75 * sum(x.base_score for x in held)


def test_lm_without_training_texts(spark, edge):
    out, n, v = lm_trie.score(edge, F.lit(False))
    assert (n, v) == (0, 0) and {(r.score, r.base_score) for r in out.collect()} == {(0.0, 0.0)} and out.count() == len(EDGE)
    assert lm_trie.score(edge.limit(0), F.lit(True))[0].count() == 0
    out, _, _ = lm_trie.score(edge, F.col("doc_id") > 3)  # null: not learned from
    assert out.count() == len(EDGE) and out.where("doc_id IS NULL").first().n_known < 4


def test_lm_runs_again_where_rows_came_otherwise(spark, monkeypatch):
    rows = lm_rows(40)
    df = spark.createDataFrame(rows, "doc_id long, text string, learn boolean").repartition(2)
    deal_fn, sizes = lm_trie._deal_fn, [300]
    monkeypatch.setattr(lm_trie, "_deal_fn", lambda size: deal_fn(sizes.pop() if sizes else size))
    out, _, _ = lm_trie.score(df, F.col("learn"), stable=True, block_tokens=200)
    want, _, _ = brute_lm(rows, 3)
    assert not sizes and out.count() == len(rows) and all(abs(x.score - want[x.doc_id][3]) <= lm_trie.STEP / 2 * 3 * x.n_tokens for x in out.collect())


def test_lm_answers_of_other_texts_are_an_error(spark):
    block = lm_trie.Block(*lm_trie.tokens(["a b c", "a d"]), lm_trie.Deal())
    assert block.check() != lm_trie.Block(*lm_trie.tokens(["a b c", "a e"]), lm_trie.Deal()).check()
    import pyarrow as pa

    texts = pa.table({"block": [0], "id": [1], "text": ["a b"]})
    sent = pa.table({"block": [0], "shard": [0], "check": [5], "data": [b""]})
    with pytest.raises(RuntimeError, match="same partitions"):
        lm_trie._score_fn(lm_trie.Deal(), 1, 1)(texts, sent)


# ------------------------------------------------------------ html


def test_extraction_of_broken_pages():
    w = html_extraction.Weights()
    f = lambda h: html_extraction.extract(h, w)
    assert [f(x) for x in (None, "", "<p", "<!-- x", "<script>var a = '<p>no</p>'", "<nav><a>menu</a></nav>")] == [""] * 6
    assert f("<p>a  b&amp;c\n d<p>next") == "a b&c d\n\nnext"
    page = "<body><div class='menu'><ul><li><a>Home page</a></ul></div><article><h1>T</h1><p>One <b>two</b> three.</p><div class=comments><p>nice post</div></article><footer>foot</footer>"
    assert f(page) == "T\n\nOne two three."


@pytest.mark.parametrize("part", ["<aside>{}</aside>", "<form class=newsletter>{}</form>", "<div class=ad><ul>{}</ul></div>"])
@pytest.mark.parametrize("before, after", [(300, 60), (60, 300), (5, 5)])
def test_an_interrupted_article_is_whole(part, before, after):
    w = html_extraction.Weights()
    words = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    block = part.format("<li><a>buy this now</a>" * 60)
    page = f"<nav><a>menu</a></nav><article><p>{words('x', before)}</p>{block}<p>{words('y', after)}</p></article><footer>foot</footer>"
    assert html_extraction.extract(page, w) == words("x", before) + "\n\n" + words("y", after)
    page = f"<article><p>{words('x', before)}</p>{'<ul><li><a></a></ul>' * 500}<p>{words('y', after)}</p></article>"
    assert html_extraction.extract(page, w) == words("x", before) + "\n\n" + words("y", after)


def test_nesting_has_no_cap():
    w = html_extraction.Weights()
    page = "<span>" * 3000 + "<nav>menu of the page</nav><article><p>one two</p><aside>buy this</aside><p>three</p></article>after it"
    assert html_extraction.extract(page, w) == "one two\n\nthree"
    n = 100_000  # unclosed elements, and end tags that close nothing
    assert html_extraction.extract("<span>" * n + "<ul><li>" + "<b>" * n + "</i>" * n + "<li></li>" * n + "<article>word</article>", w) == "word"


def the_article(page):
    import html
    import re

    body = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " ")))).strip() for x in re.split(r"</?(?:p|h1)>", body)]
    return "\n\n".join(p for p in parts if p)


def test_extraction_of_all_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html_extraction.query(spark, SF).collect()}
    for r in pages.collect():
        assert got[r.page_id] == the_article(r.html)


def learned(spark):
    from collections import Counter

    pages = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/pages.parquet").collect()
    seen, tags = Counter(), Counter()
    for r in pages:
        # a rail of a make of its own, which no prior weight knows
        html_extraction.statistics(r.html.replace("<article>", "<div class='zq-rail'><p>one two three four</p></div><article>"), seen, tags)
    return pages, html_extraction.Weights.fit(dict(seen), dict(tags))


def test_extraction_without_marks_is_learned(spark):
    pages, w = learned(spark)
    plain = html_extraction.Weights()
    hide = lambda h: h.replace("<article>", "<div>").replace("</article>", "</div>")
    for r in pages:
        assert html_extraction.extract(hide(r.html), w) == the_article(r.html)
    page = "<body><div>" + "<p>" + "word " * 30 + "</p>" + "<div class='zq-rail'><p>read this too</p></div><p>" + "last words of it " * 4 + "</p></div>"
    assert html_extraction.extract(page, w) == "word " * 29 + "word\n\n" + ("last words of it " * 4).strip()
    assert "read this too" in html_extraction.extract(page, plain)  # what decides was learned


def test_the_scan_decides(spark):
    _, w = learned(spark)
    menu = "<nav><ul>" + "<li><a>menu</a></li>" * 30 + "</ul></nav>"
    page = f"<body><div><p>a teaser</p></div>{menu}<div><p>{'word ' * 30}</p><p>the end</p></div>{menu}<div><p>more to read</p></div>"
    assert html_extraction.extract(page, w) == "word " * 29 + "word\n\nthe end"
    p = html_extraction.Page(page)
    s = w.scores(p)
    assert any(s[e] > 0 and t == "a teaser" for k, t, e in p.tokens if k == "text")  # a score above 0, but in no run with the text


@pytest.mark.parametrize("trained", [False, True])
def test_names_around_an_article_do_not_empty_it(spark, trained):
    w = learned(spark)[1] if trained else html_extraction.Weights()
    text = "<h1>T</h1><p class='text-share'>" + "word " * 40 + "</p><p>end</p>"
    want = "T\n\n" + "word " * 39 + "word\n\nend"
    rail = "<div class='sidebar'><p>latest news of the day</p></div>"
    for mark in ("article", "div"):
        body = f"<{mark}>{text}</{mark}>"
        for page in (
            f"<body class='no-sidebar'>{rail}{body}",
            f"<body class='sidebar'>{rail}{body}",
            f"<body><div class='page has-banner'>{rail}{body}</div>",
            f"<body><div class='content-sidebar-wrap'>{body}{rail}</div>",
            f"<body>{'<div>' * 600}{rail}{body}{'</div>' * 600}<footer>foot</footer>",
            f"<body>{'<nav>' + '<div>' * 600}menu words of the page{'</div>' * 600}</nav>{body}",
            f"<body><img alt=x><a title=\"{'x>' * 3000}\" href=y></a>{rail}{body}",
            f"<body><p class=it's>{body}<div class='comment-list'><p>nice post</p></div><div class='post-comments'><p>me too</p></div>",
        ):
            assert html_extraction.extract(page, w) == want, page[:60]
    page = f"<article>{text}<div class='comments'>{'<p>I say so too my friends</p>' * 8}</div></article>"
    assert html_extraction.extract(page, w) == want
    assert html_extraction.extract("<article><p>" + "data " * 9 + "</article>" + "<div class=related><article><p>a teaser</p></article></div>", w) == "data " * 8 + "data"


def test_extraction_of_odd_tables(spark):
    rows = [(1, "u", "<article><p>x y</article>", "mine", 7), (1, "u", "<article><p>x y</article>", "mine", 7), (None, None, None, None, None), (2, "v", "", "", 0), (3, "w", "<p>" + "long text " * 200_000, "", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    out = html_extraction.extract_pages(df, html_extraction.train(df))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((str(r.page_id), r.text[:9], r.n_chars) for r in out.collect()) == [("1", "x y", 3), ("1", "x y", 3), ("2", "", 0), ("3", "long text", 1_999_999), ("None", "", 0)]
    assert html_extraction.extract_pages(df.limit(0), html_extraction.train(df.limit(0))).count() == 0


def test_broken_tags_take_linear_time():
    import time

    began = time.time()
    for page in ("<a title=\"x>" * 20_000, "<a b='" * 20_001, "<a " * 50_000, "<p class=it's>x" * 20_000, "<" * 100_000, '="' * 50_000 + "<a" + '="' * 50_000):
        html_extraction.extract(page, html_extraction.Weights())
    assert time.time() - began < 20


# ------------------------------------------------------------ classifiers


def test_crf_marginals_are_brute_force():
    from itertools import product

    m = quality_crf.LineCRF()
    r = np.random.default_rng(1)
    m.w, m.t = r.standard_normal(quality_crf.N_FEATURES), r.standard_normal((2, 2))
    X, _, off = quality_crf.line_features(["Abc DEF\nxx\n\nfoo 12 !!", "one", ""])
    good, logz, _ = m.marginals(X, off)
    e = X @ m.w
    for k in range(3):
        a, b = off[k], off[k + 1]
        paths = list(product((0, 1), repeat=b - a))
        s = np.array([sum(e[a + i] * y for i, y in enumerate(p)) + sum(m.t[x, y] for x, y in zip(p, p[1:], strict=False)) for p in paths])
        p = np.exp(s - np.logaddexp.reduce(s))
        assert np.isclose(logz[k], np.logaddexp.reduce(s))
        assert np.allclose(good[a:b], [sum(q for q, y in zip(p, paths, strict=True) if y[i]) for i in range(b - a)])


def test_crf_segments_of_long_texts_change_nothing():
    import time

    m = quality_crf.LineCRF()
    r = np.random.default_rng(1)
    m.w, m.t = r.standard_normal(quality_crf.N_FEATURES), r.standard_normal((2, 2))
    lines = ["Abc DEF", "xx", "", "foo 12 !!", "one two three four"]
    texts = ["\n".join(r.choice(lines, n)) for n in (1, 700, 3, 1000, 26, 27, 1, 441)]
    X, _, off = quality_crf.line_features(texts)
    whole, cut = m.marginals(X, off, most=10**9), m.marginals(X, off, most=20)
    for a, b in zip(whole, cut, strict=True):
        assert np.allclose(a, b, rtol=1e-9, atol=1e-9)
    began = time.time()
    assert 0 <= m.score(["\n".join(r.choice(lines, 300_000))])[0] <= 1 and time.time() - began < 10


def test_quality_on_held_out_rows(spark):
    d = SF.replace("0.001", "0.01")
    rows = quality_crf.query(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95


def test_classifiers_of_nothing(spark, edge):
    none = edge.limit(0)
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id long, quality int")
    assert quality_crf.train(none, labels) is None and quality_crf.train(edge, labels.limit(0)) is None
    assert quality_crf.classify(none, None).count() == 0 and quality_crf.good(none, None).columns == edge.columns
    assert language_id.train(none) is None and language_id.identify(none, None).count() == 0 and language_id.recognised(edge, None).count() == 0


def test_states_and_pooling_are_the_plain_ones():
    g = language_id.ByteBiGRU(["a", "b", "c"], 5, seed=3)
    x = np.random.default_rng(2).integers(0, 256, (70, 9))
    for d in "fb":
        assert np.allclose(g._run(x, d)[0], g._states(x.astype(np.intp), d), atol=1e-5)
    r = np.random.default_rng(4)
    texts = [bytes(r.integers(1, 256, n, dtype=np.uint8)) for n in (0, 1, 7, 8, 63, 64, 65, 127, 128, 129, 700)]
    together, alone = g.pool(texts), np.concatenate([g.pool([t]) for t in texts])
    assert np.allclose(together, alone, atol=1e-6)

    def plain(t):
        """Segments one by one; a tail is run on the last bytes of its text."""
        if not t:
            return np.zeros(3)
        n, total, k = language_id.SEGMENT, np.zeros(3), len(t) // language_id.SEGMENT
        parts = [(t[i * n : i * n + n], n) for i in range(k)]
        if tail := t[k * n :]:
            parts.append((t[-n:], len(tail)) if k else (tail + b" " * (-len(tail) % 8), -len(tail)))
        for s, m in parts:
            q = g.position_probs(np.frombuffer(s, np.uint8)[:, None])[:, :, 0]
            total += (q[:, :-m] if m < 0 and len(s) + m == 0 else q[:, : -m] if m < 0 else q[:, len(s) - m :]).sum(1)
        return total / len(t)

    assert np.allclose(together, [plain(t) for t in texts], atol=1e-5)


def test_texts_of_no_language_are_not_recognised(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.1')}/documents.parquet")
    model = language_id.train(docs)
    r = random.Random(2)
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    junk = spark.createDataFrame([(-i, "".join(r.choice(signs) for _ in range(3000))) for i in range(1, 9)], "doc_id long, text string")
    assert language_id.recognised(junk, model).count() <= 1
    some = docs.where("doc_id % 10 = 3").select("doc_id", "text")
    assert language_id.recognised(some, model).count() >= 0.998 * some.count()


def test_quality_edge_cases(spark, edge):
    out = quality_crf.classify(edge, None)
    assert {r.score for r in out.collect()} == {0.5} and out.count() == len(EDGE)
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality_crf.train(edge, labels)
    assert model is None or all(0 <= r.score <= 1 for r in quality_crf.classify(edge, model).collect())


def test_gru_gradient():
    g = language_id.ByteBiGRU(["a", "b", "c"], 4)
    g.p = {k: v.astype(np.float64) for k, v in g.p.items()}
    x, y = np.random.default_rng(0).integers(97, 101, (6, 5)), np.array([0, 1, 2, 0, 1])
    _, grad = g.loss_grad(x, y)
    for k in g.p:
        at = np.unravel_index(np.abs(grad[k]).argmax(), g.p[k].shape)
        v = g.p[k][at]
        ends = []
        for d in (1e-2, -1e-2):
            g.p[k][at] = v + d
            ends.append(g.loss_grad(x, y)[0])
        g.p[k][at] = v
        assert abs((ends[0] - ends[1]) / 2e-2 - grad[k][at]) < 2e-3


def test_language_on_held_out_rows(spark, docs, edge):
    model = language_id.train(spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet"), per_lang=150)
    held = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    rows = language_id.identify(held.withColumn("truth", F.col("lang")), model).collect()
    assert np.mean([r.lang_pred == r.truth for r in rows]) > 0.9
    out = {r.doc_id: r for r in language_id.identify(edge, model).collect()}
    assert [out[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and out[4].lang_pred != "und"
    assert {r.lang_pred for r in language_id.identify(edge, None).collect()} == {"und"}


# ------------------------------------------------------------ vectors


def vectors(spark, n=400, d=24, seed=2):
    r = np.random.default_rng(seed)
    X = r.standard_normal((n, d))
    X[n // 2 :] = X[r.integers(0, n // 8, n - n // 2)] + 0.12 * r.standard_normal((n - n // 2, d))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(X)] + [(n, [float(x) for x in X[0]])]
    odd = [(n + 1, None), (n + 2, [0.0] * d), (n + 3, [float("nan")] + [1.0] * (d - 1)), (n + 4, [None] + [1.0] * (d - 1)), (n + 5, [1.0]), (n + 6, []), (n + 7, [float("inf")] * d), (None, [1.0] * d)]
    return np.vstack([X, X[:1]]), rows, odd, spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")


def test_spherical_filters_are_brute_force(spark):
    X, rows, odd, df = vectors(spark)
    U = X / np.linalg.norm(X, axis=1, keepdims=True)
    C = U @ U.T >= 0.95
    np.fill_diagonal(C, False)
    got = {r.vec_id: r for r in spherical_filters.near_duplicates(df).collect()}
    assert len(got) == len(rows) + len(odd)
    found = sum(got[i].n_links for i in range(len(X)))
    assert 0.98 * C.sum() <= found <= C.sum()
    assert all(got[i].n_links <= C[i].sum() for i in range(len(X)))
    assert all(got[i].n_links == 0 and got[i].kept for i, _ in odd)
    assert spherical_filters.near_duplicates(df.limit(0)).count() == 0


def test_spherical_filters_grow_with_the_table():
    r = np.random.default_rng(5)
    X = r.standard_normal((400, 64))
    X /= np.linalg.norm(X, axis=1, keepdims=True)
    for n in (500, 50_000, 5_000_000):
        words, cap = spherical_filters.codebook(n, 64)
        code = spherical_filters.ProductCode(64, words, cap)
        one, found = code.decode(X)
        every = (X @ code.rotation)[:, :32] @ code.books[0].T, (X @ code.rotation)[:, 32:] @ code.books[1].T
        for i in range(0, 400, 57):  # list decoding is looking at every filter
            sums = every[0][i][:, None] + every[1][i][None, :]
            assert set(found[one == i]) == set(np.flatnonzero(sums.ravel() > cap)) | {sums.argmax()}
        each = len(one) / len(X)
        assert 0.6 * spherical_filters.FILTERS < each < 2 * spherical_filters.FILTERS  # memberships do not grow
        assert n * each / words**2 < max(3 * spherical_filters.BUCKET, 0.2 * n)  # nor do filters fill


def test_vectors_are_compared_within_their_lengths(spark):
    rows = [(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0]), (3, [1.0, 2.0]), (4, [1.0, 2.0]), (5, [2.0, 4.0, 6.0001]), (6, [5.0]), (7, [-5.0]), (8, [7.0])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in spherical_filters.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 3: (1, 3, True), 4: (1, 3, False), 5: (2, 1, False), 6: (1, 6, True), 7: (0, 7, True), 8: (1, 6, False)}
    found = multi_index_hashing.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i < 9, k=5).collect()
    near = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        near.setdefault(r.query_id, []).append(r.vec_id)
    assert near == {1: [2, 5], 2: [1, 5], 5: [1, 2], 3: [4], 4: [3], 6: [8, 7], 7: [6, 8], 8: [6, 7]}


def test_vectors_with_clashing_columns_repeated_ids_and_ties(spark):
    rows = [("b", [1.0, 0.0], 1, "x"), ("a", [1.0, 0.01], 2, "x"), ("a", [0.0, 1.0], 3, "x"), ("a", [0.0, 1.0], 3, "x"), (None, [1.0, 0.0], 4, "x")]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<float>, key int, v string")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in spherical_filters.near_duplicates(df).collect())
    assert got == [("None", 0, "None", True), ("a", 1, "a", True), ("a", 1, "a", True), ("a", 1, "a", True), ("b", 1, "a", False)]
    ties = [(i, [float(i % 2), 1.0], 7, i) for i in range(8)] + [(3, [1.0, 1.0], 7, 3)]
    df = spark.createDataFrame(ties, "vec_id long, embedding array<float>, row int, id long")
    got = [(r["rank"], r.vec_id, r.score) for r in multi_index_hashing.search(df, lambda i: i == 0, k=6).collect()]
    assert sorted(got) == [(1, 2, 0.0), (2, 4, 0.0), (3, 6, 0.0), (4, 1, 1.0), (5, 3, 1.0), (6, 3, 1.0)]
    same = multi_index_hashing.search(df, lambda i: i == 3, k=2).collect()  # two rows of one id are two queries, each the other's candidate
    assert sorted((r["rank"], r.vec_id) for r in same) == [(1, 1), (1, 1), (2, 3), (2, 3)]


def test_components_of_a_chain(spark):
    from quern.llm._links import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (200, 200)], "key long, peer long")
    got = {r.key: r.label for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[100] == got[101] == 100


def test_multi_index_hashing(spark):
    X, rows, odd, df = vectors(spark)
    got = multi_index_hashing.search(df, lambda i: i % 20 == 0, k=5).collect()
    hit = 0
    for q in range(0, len(X), 20):
        d = np.sqrt(((X - X[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(len(X)), d))[:5]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and all(abs(d[v] - s) < 1e-9 for _, v, s in mine)
        hit += len(set(want) & {m[1] for m in mine})
    assert hit / (5 * len(range(0, len(X), 20))) >= 0.9
    few = multi_index_hashing.search(df.where("vec_id < 3"), lambda i: i == 0, k=5)
    assert few.count() == 2
    assert multi_index_hashing.search(df.limit(0), lambda i: i == 0).count() == 0


def test_probing_finds_every_code_within_the_radius():
    codes = np.random.default_rng(0).integers(0, 1 << 16, (500, 4), dtype=np.uint16)
    index = multi_index_hashing.Index(codes)
    for r in (0, 3, 9, 22, 64):
        for q in codes[:5]:
            assert set(index.within(q, r)) == set(np.flatnonzero(multi_index_hashing.hamming(codes, q) <= r))


# ------------------------------------------------------------ chat


def test_layouts_give_the_same_turns():
    registry = chat_format.Registry()
    want = [("user", "q"), ("assistant", "a")]
    for record in (
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 3},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"data": {"messages": [{"content": "q", "role": "user"}, {"content": "a", "role": "assistant"}]}},
        {"prompt": "q", "completion": "a", "source": "x"},
        {"instruction": "q", "input": "", "output": "a"},
        {"instruction": "q", "output": "a"},
        {"question": "q", "answer": "a"},
    ):
        assert chat_format.record_turns(record, registry)[1] == want
    assert chat_format.record_turns({"x": 1}, registry) == (None, [])
    turns = lambda r: chat_format.record_turns(r, registry)[1]
    system = ("system", "s")
    for record in (
        {"system": "s", "instruction": "q", "output": "a"},
        {"system": "s", "instruction": "q", "input": None, "response": "a"},
        {"system": "s", "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": [{"type": "text", "text": "a"}]}]},
        {"system": "s", "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "score": 1},
        {"system": "s", "question": "q", "answer": "a"},
        {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": [{"type": "text", "text": "q"}]}, {"role": "assistant", "content": [{"type": "text", "text": "a"}]}]},
    ):
        assert turns(record) == [system, *want]
    assert turns({"prompt": "q", "response": None}) == [("user", "q"), ("assistant", "")]
    assert turns({"instruction": "q", "input": "i", "output": "a"}) == [("user", "q\n\ni"), ("assistant", "a")]
    call = [{"function": {"name": "f", "arguments": "{}"}}]
    tools = [{"role": "user", "content": "q"}, {"role": "assistant", "content": None, "tool_calls": call}, {"role": "tool", "content": "7"}, {"role": "assistant", "content": "a"}]
    assert turns({"messages": tools}) == [("user", "q"), ("assistant", '[{"function": {"name": "f", "arguments": "{}"}}]'), ("tool", "7"), ("assistant", "a")]
    image = {"type": "image_url", "image_url": {"url": "u"}}
    assert turns({"messages": [{"role": "user", "content": [{"type": "text", "text": "q"}, image]}]}) == [("user", 'q\n{"type": "image_url", "image_url": {"url": "u"}}')]
    assert [chat_format.record_turns({"messages": x}, registry) for x in ([], None)] == [("messages", [])] * 2
    # two layouts at once are neither
    assert chat_format.record_turns({"prompt": "q", "response": "a", "output": "b"}, registry) == (None, [])


def test_tables_give_the_same_turns(spark):
    want = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a")]
    m = "array<struct<role:string,content:string>>"
    parts = "array<struct<role:string,content:array<struct<type:string,text:string>>>>"
    said = [("human", "q"), ("assistant", "a")]
    for schema, row in (
        (f"conv_id long, system string, messages {m}, role_of string", (1, "s", said, "x")),
        (f"conv_id long, system string, messages {parts}", (1, "s", [("user", [("text", "q")]), ("assistant", [("text", "a")])])),
        ("conv_id long, output string, system string, instruction string, input string", (1, "a", "s", "q", None)),
        ("conv_id long, question string, answer string, system string", (1, "q", "a", "s")),
    ):
        out = chat_format.table_turns(spark.createDataFrame([row], schema))
        assert sorted(map(tuple, out.collect())) == want
    with pytest.raises(ValueError, match="no layout"):
        chat_format.table_turns(spark.createDataFrame([("q", "a", "b")], "prompt string, response string, answer string"))
    rows = chat_format.table_turns(spark.createDataFrame([(1, 0, "user", "q", "x", 2)], "conv_id long, turn int, role string, text string, formatted string, n_turns int"))
    assert chat_format.digests(chat_format.format_turns(rows)).count() == 1


def test_json_records(spark):
    records = [(1, '{"prompt": "q", "response": null}'), (2, "not json"), (3, None), (4, '{"prompt": "q", "response": "a"}'), (5, '{"prompt": "q", "output": "a"}'), (6, "[" * 100_000)]
    df = spark.createDataFrame(records, "id int, j string")
    got = [(r.conv_id, r.turn, r.role, r.text[:30]) for r in chat_format.json_turns(df, "id", "j").collect()]
    turns = [(i, k, r, t) for i, a in ((1, ""), (4, "a")) for k, (r, t) in enumerate((("user", "q"), ("assistant", a)))]
    assert sorted(map(str, got)) == sorted(map(str, [*turns, (2, None, None, "not json"), (5, None, None, '{"prompt": "q", "output": "a"}'), (6, None, None, "[" * 30)]))


def test_reading_back_crosses_pieces():
    whole = "".join(chat_format.format_turn(r, t) for r, t in (("user", "a </s> b"), ("x", "[OUT]"), ("assistant", "c\\"), ("system", "")))
    want = list(chat_format.read_turns(whole))
    assert want == [("user", "a </s> b", False), ("x", "[OUT]", False), ("assistant", "c\\", True), ("system", "", False)]
    for size in (1, 2, 3, 7, 1000):
        reader = chat_format.Reader()
        assert [t for i in range(0, len(whole), size) for t in reader.feed(whole[i : i + size])] == want
        reader.close()
    with pytest.raises(ValueError, match="cannot be read back"):  # a text whose marks were not escaped
        list(chat_format.read_turns("<s>[INST] a [/INST] b [/INST]<s>[OUT] c [/OUT]</s>"))


def test_a_conversation_of_long_turns(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"{k} </s>" * 20_000) for k in range(40)]
    got = chat_format.digests(chat_format.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert got.n_turns == 40 and got.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows).encode()).hexdigest()
    assert got.loss_sha256 == hashlib.sha256("".join(t for *_, r, t in rows if r == "assistant").encode()).hexdigest()


@pytest.mark.parametrize("text", ["", "</s>[INST] ok [/INST]", "\\", "a\\[INST]", "<s>[OUT] x [/OUT]</s>", " [/INST", "<", "[\\/INST]\n", "<<SYS>> <</SYS>>"])
@pytest.mark.parametrize("role", ["user", "assistant", "system", "tool </s>", ""])
def test_template_is_reversible(role, text):
    whole = "".join(chat_format.format_turn(r, t) for r, t in ((role, text), ("assistant", text), (role, text)))
    assert [(r, t) for r, t, _ in chat_format.read_turns(whole)] == [(role, text), ("assistant", text), (role, text)]


def test_digests(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (2, None, None, "x"), (None, 0, "user", "y"), (1, 1, "assistant", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.digests(chat_format.format_turns(df)).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 2 and got[1].loss_sha256 == hashlib.sha256(b"bb").hexdigest()
    assert got[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\nb\nassistant\nb\n").hexdigest()
    assert got[2].n_turns == got[None].n_turns == 1
    assert chat_format.digests(chat_format.format_turns(df.limit(0))).count() == 0


def test_chat_formatting_matches_its_oracle(spark, tmp_path):
    import duckdb

    from quern.llm.registry import ORACLES

    odd = [(1, 1, "assistant", "b\\ <s>[INST]"), (1, 0, "user", None), (2, None, None, "</s> <</SYS>> [/ROLE] \\"), (2, 3, "tool [OUT]", "é€😀"), (None, 0, "system", "y"), (1, 1, "assistant", "b"), (3, 0, "user", "<<s>>[[OUT]")]
    spark.createDataFrame(odd, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    for path, files in ((SF, f"{SF}/conversations.parquet"), (str(tmp_path), f"{tmp_path}/conversations.parquet/*.parquet")):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{files}'")
        cur = con.execute(ORACLES["op8_chat_formatting"])
        df = chat_format.query(spark, path).select([c[0] for c in cur.description])
        assert sorted(map(str, cur.fetchall())) == sorted(str(tuple(r)) for r in df.collect())


# ------------------------------------------------------------ SentencePiece


def unigram_model(prefix=True) -> bytes:
    """A small unigram model with byte fallback, written field by field."""
    v = lambda n: bytes([n]) if n < 128 else bytes([n & 127 | 128]) + v(n >> 7)
    msg = lambda no, b: v(no << 3 | 2) + v(len(b)) + b
    num = lambda no, n: v(no << 3) + v(n)
    piece = lambda s, score, kind=1: msg(1, msg(1, s.encode()) + v(2 << 3 | 5) + struct.pack("<f", score) + num(3, kind))
    out = piece("<unk>", 0, 2) + piece("<s>", 0, 3) + piece("</s>", 0, 3)
    out += b"".join(piece(f"<0x{b:02X}>", 0, 6) for b in range(256))
    words = ["▁", "▁the", "▁c", "at", "c", "a", "t", "▁cat", "s", "ab", "abc", "bc", "b", "e", "h"]
    out += b"".join(piece(w, -1.5 - 0.37 * i) for i, w in enumerate(words))
    out += msg(2, num(3, 1) + num(35, 1)) + msg(3, msg(1, b"identity") + num(3, int(prefix)) + num(4, 0) + num(5, 1))
    return out


@pytest.mark.parametrize("prefix", [True, False])
def test_unigram_parity(tmp_path, prefix):
    import sentencepiece

    path = tmp_path / "u.model"
    path.write_bytes(unigram_model(prefix))
    sp = sentencepiece.SentencePieceProcessor(model_file=str(path))
    codec = sentencepiece_tokenizers.Codec(str(path))
    texts = ["", "the cat", "abc cats the", "  the  cat ", "zü the", "tabcabbc", "<0x41> a", "a\nb"]
    ids, same = codec.encode(texts)
    # a byte piece written out is a piece to the tokenizers library and text to sentencepiece
    agree = [np.frombuffer(b, "<u4").tolist() == x for b, x in zip(ids, sp.encode(texts), strict=True)]
    assert agree == same == ["<0x" not in t for t in texts]
    assert [t for t, s in zip(codec.decode(ids), same, strict=True) if s] == [sp.decode(x) for x, s in zip(sp.encode(texts), same, strict=True) if s]


def test_bpe_parity(spark, edge):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [t or "" for _, t in EDGE] + [" lead", "a        b", "▁x", "\n\n", "tab\tx"]
    codec = sentencepiece_tokenizers.Codec(path)
    ids, same = codec.encode(texts)
    assert [np.frombuffer(b, "<u4").tolist() for b in ids] == sp.encode(texts) and all(same)
    assert codec.decode(ids) == [sp.decode(x) for x in sp.encode(texts)]
    odd = [t or "" for t in TEXTS]
    _, ends, chars, exact, same = codec.survey(odd)
    assert np.diff(ends).tolist() == [len(sp.encode(t)) for t in odd] and chars.tolist() == [len(t) for t in odd] and exact.all() and same.all()
    rows = sentencepiece_tokenizers.encode_documents(edge, path)
    assert sentencepiece_tokenizers.encode_documents(edge.limit(0), path).count() == 0
    assert rows.count() == len(EDGE) and rows.where("round_trip").count() == len(EDGE)
    back = sentencepiece_tokenizers.decode_documents(rows, path)
    assert sorted(str(r.text) for r in back.collect()) == sorted(t or "" for _, t in EDGE)


def test_rebuilt_bpe_agrees_with_sentencepiece(spark, docs):
    """The ids of the tokenizers backend on whole texts, and put together from segments."""
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    codec = sentencepiece_tokenizers.Codec(path)
    texts = [t for _, t in EDGE if t] + [" lead", "a        b", "\n\n", "tab\tx"] + [r.text for r in docs.select("text").collect() if r.text]
    assert [e.ids for e in codec.tok.encode_batch([" " + t for t in texts], add_special_tokens=False)] == sp.encode(texts)
    assert all(codec.encode(texts)[1])


# ------------------------------------------------------------ pipeline


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n, now = [docs.count()], docs
    for _, f in corpus_pipeline.STAGES[:-1]:
        now = f(spark, now, SF).cache()
        assert now.columns == docs.columns and now.exceptAll(docs).isEmpty()
        n.append(now.count())
    assert n == sorted(n, reverse=True) and n[-1] > 0.6 * n[0]
    kept = sorted(r[0] for r in now.select("doc_id").collect())
    out = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
    assert sorted({r.doc_id for r in out}) == kept
    assert chosen_path_join.join(now).where("n_links > 0").count() == 0


def test_pipeline_edge_cases(spark, tmp_path):
    """Nulls, empty texts, junk, repeated rows, clashing columns and no rows, in the table that run() reads."""
    import corpus_pipeline

    sf = SF.replace("0.001", "0.01")
    some = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id"), "doc_id", "left_semi").limit(300)
    clean = [(r.doc_id, r.text, r.lang) for r in some.collect()]
    odd = [(-1, None, "en"), (-2, "", None), (-3, "  \n ", "de"), (-4, "12345 67", "en"), (None, clean[0][1], None), clean[1], clean[1], (clean[2][0], clean[3][1], "en")]
    schema = "doc_id long, text string, lang string, score string, predicted string, lang_pred int, key string, id int"
    df = spark.createDataFrame([(*x, "mine", "mine", 7, "k", 8) for x in [*clean, *odd]], schema)
    now = df
    for name, f in corpus_pipeline.STAGES[:-1]:
        before, now = now, f(spark, now, sf).cache()
        assert now.columns == df.columns and now.exceptAll(before).isEmpty(), name
        assert {(x.score, x.predicted, x.lang_pred, x.key, x.id) for x in now.collect()} == {("mine", "mine", 7, "k", 8)}
        if name == "language_id":
            left = {x.doc_id for x in now.collect()}
            assert left.isdisjoint({-1, -2, -3, -4}) and len(left & {i for i, _, _ in clean}) >= 0.99 * len(clean)
    assert now.groupBy("doc_id", "text").count().where("count > 1").isEmpty()
    out = corpus_pipeline.STAGES[-1][1](spark, now, sf)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.select("doc_id").distinct().count() == now.select("doc_id").distinct().count()
    for name in ("labels",):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    df.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_stages_are_the_operators(spark):
    """Every stage against scores and classes worked out beside it."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    q = dict(zip(texts, model.pool([t.encode() for t in texts.values()]), strict=True))
    chance = 1 / len(model.langs)
    least = lambda t: chance + language_id.MARGIN * (1 - chance) * min(1, len(t.encode()) / 200) - 1e-6
    want = {i for i, t in texts.items() if any(map(str.isalpha, t)) and q[i].max() >= least(t)}
    first = corpus_pipeline.known_language(spark, docs, SF)
    assert {r.doc_id for r in first.collect()} == want
    crf = quality_crf.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    second = corpus_pipeline.good_quality(spark, docs, SF)
    scores = dict(zip(texts, crf.score(list(texts.values())), strict=True))
    assert {r.doc_id for r in second.collect()} == {i for i, x in scores.items() if x >= quality_crf.THRESHOLD}
    third = corpus_pipeline.without_near_copies(spark, docs, SF)
    assert {str(r.doc_id) for r in third.collect()} == {c for _, _, c in brute_classes(list(texts.items()))}
