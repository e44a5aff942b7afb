"""Cross-tokenizer alignment against brute force on whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quern.llm import token_alignment as A

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
PATHS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def encoders():
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATHS[0])
    tok.encode_special_tokens = True
    spm = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    entry, decode = {i: t for t, i in tok.get_vocab().items()}, A.byte_level()

    def piece(i):
        p = spm.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if spm.is_byte(i) else p.replace("▁", " ").encode()

    def both(text):
        a = tok.encode(" " + text, add_special_tokens=False).ids
        return [(i, bytes(decode[c] for c in entry[i])) for i in a], [(i, piece(i)) for i in spm.encode(text)]

    return both


def spans(tokens):
    out, at = [], 0
    for i, raw in tokens:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def brute(encoders, texts):
    """(figures, digest) of each text by comparing all spans."""
    each = []
    for text in texts:
        a, b = encoders(text) if text else ([], [])
        want = (" " + (text or "")).encode()
        if not text or b"".join(r for _, r in a) != want or b"".join(r for _, r in b) != want:
            each.append(None)
            continue
        a, b = spans(a), spans(b)
        links = [(i, j) for i, s, e in a for j, u, v in b if s < v and u < e]
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        lo, groups = 0, []
        for hi in cuts:
            groups.append(",".join(str(i) for i, s, e in a if lo <= s and e <= hi) + "|" + ",".join(str(j) for j, s, e in b if lo <= s and e <= hi))
            lo = hi
        each.append((len(a), len(b), groups, links))
    counts = Counter(p for x in each if x for p in set(x[3]))
    most = {}
    for (i, _), n in counts.items():
        most[i] = max(most.get(i, 0), n)
    zero = (0, 0, 0, 0, 0, 0, "")
    return [zero if x is None else (x[0], x[1], len(x[2]), len(x[3]), sum(counts[p] == most[p[0]] for p in x[3]), sum(counts[p] for p in x[3]), hashlib.sha256(";".join(x[2]).encode()).hexdigest()) for x in each]


def odd_texts():
    r = random.Random(8)
    parts = ["the", "Größe", "naïve", "日本語", "😀😀", "don't", "  ", " ", "\n", "\t", " ", " ", "1234567", "...", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "x" * 40, "\x1c", "é", "​", "_", "\x85", "﻿"]
    texts = [None, "", " ", "  ", "\n", "a", " a", "a ", " a  b ", "a▁b", "▁", "\x00", "word", "word", "word " * 400, "abc" * 700]
    return texts + ["".join(r.choice(parts) + r.choice(["", " ", " "]) for _ in range(r.randint(1, 25))) for _ in range(150)]


@pytest.mark.parametrize("top", [0, 300, 1 << 20])
def test_digests_are_brute_force_for_any_number_of_broadcast_pairs(spark, encoders, top):
    texts = odd_texts()
    df = spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(texts)], "k int, text string, row int, rare string").repartition(3)
    got = {r.k: tuple(r)[1:] for r in A.digests(df, *PATHS, id_col="k", top=top).collect()}
    want = brute(encoders, texts)
    assert [(i, texts[i], got[i], w) for i, w in enumerate(want) if got[i] != w] == []


def test_query_is_brute_force(spark, encoders):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    short = [r for r in rows if len(r[1]) < 4000]
    df = spark.createDataFrame(short, "doc_id long, text string").repartition(4)
    got = {r.doc_id: tuple(r)[1:] for r in A.digests(df, *PATHS).collect()}
    assert [got[i] for i, _ in short] == brute(encoders, [t for _, t in short])
    full = A.query(spark, SF)
    assert full.columns == ["doc_id", *A._FIGURES, "groups_sha256"] and sorted(r[0] for r in full.collect()) == [i for i, _ in rows]


def test_pair_counts_are_combined_in_bounded_parts(spark, encoders):
    texts = odd_texts()
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    got = {(r.a, r.b): (r.n, r.best) for r in A.pair_counts(df, *PATHS, held=200).collect()}
    each = [encoders(t) for t in texts if t]
    counts = Counter()
    for t, (a, b) in zip([t for t in texts if t], each, strict=True):
        if b"".join(r for _, r in a) == (" " + t).encode() == b"".join(r for _, r in b):
            counts.update({(i, j) for i, s, e in spans(a) for j, u, v in spans(b) if s < v and u < e})
    assert {k: v[0] for k, v in got.items()} == dict(counts)
    assert all(best == (n == max(m for (i, _), m in counts.items() if i == a)) for (a, _), (n, best) in list(got.items())[:200])


def test_segments_give_what_whole_texts_give(encoders):
    table = A.Table(A.Aligner(*PATHS), size=4000)  # so small that it forgets now and then
    import pyarrow as pa

    for text in [t for t in odd_texts() if t]:
        at, number, ok = table.of(pa.array([text], pa.string()))
        whole = table.aligner.align([text])
        assert ok[0] == whole.ok[0]
        if ok[0]:
            assert table.ids(number).reshape(-1, 2).tolist() == np.stack([whole.a[whole.link_a], whole.b[whole.link_b]], 1).tolist()


def test_bits():
    r = np.random.default_rng(1)
    for size in (1, 63, 64, 65, 1000):
        places = np.unique(r.integers(0, size, size // 2 + 1))
        bits = A.Bits.at(places, size)
        assert bits.select().tolist() == places.tolist()
        assert bits.rank(np.arange(size + 1)).tolist() == [int((places < i).sum()) for i in range(size + 1)]


def test_alignments_and_no_rows(spark, encoders):
    df = spark.createDataFrame([(1, "Hello Größe!"), (2, None), (3, "")], "doc_id long, text string")
    rows = {r.doc_id: r for r in A.alignments(df, *PATHS).collect()}
    a, b = encoders("Hello Größe!")
    assert rows[1].a == [i for i, _ in a] and rows[1].b == [i for i, _ in b]
    ends = [sorted({e for _, _, e in spans(x)}) for x in (a, b)]
    assert rows[1].cuts == sorted(set(ends[0]) & set(ends[1])) and rows[1].a_upto[-1] == len(a) and rows[1].b_upto[-1] == len(b)
    assert rows[2].a == [] and rows[3].cuts == []
    assert A.digests(df.where("doc_id < 0"), *PATHS).collect() == []
