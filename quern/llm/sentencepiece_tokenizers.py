"""SentencePiece encoding and decoding on the tokenizers library.

The model file is a protobuf message; `parse_model` reads its wire format. From it a
tokenizer is rebuilt: the precompiled normaliser map, the space marker (metaspace), the
unigram scores or the merges that the BPE scores imply, and byte fallback. Batches are
encoded by the library's own threads. Where no piece spans a space, the distinct segments
between spaces are encoded once in a task and the ids of texts put together from them.

Parity: all that is encoded is encoded by the sentencepiece library too, and decoded
again. The ids are always those of the tokenizers backend; `parity` is false for texts
in which the libraries differ (merges of equal score, literal byte pieces), `round_trip`
where decoding does not give the text back.

Edge cases: null and empty texts have no ids and decode to "". Unpaired surrogates are
replaced before encoding. Texts are encoded whole; repeated rows alike; an empty table
gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int, object]]:
    """(field, wire type, value) of a protobuf message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, kind, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, kind, data[at : at + n]
            at += n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            yield tag >> 3, kind, data[at : at + n]
            at += n
        else:
            raise ValueError("not a SentencePiece model")


@dataclass
class SpmModel:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = 1  # 1 unigram, 2 BPE
    byte_fallback: bool = False
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    whitespace_as_suffix: bool = False
    charsmap: bytes = b""


def parse_model(data: bytes) -> SpmModel:
    """Read pieces (field 1), trainer (2) and normaliser (3) settings of a ModelProto."""
    m = SpmModel()
    for no, _, value in _fields(data):
        if no == 1:
            piece, score, kind = "", 0.0, NORMAL
            for k, _, v in _fields(value):
                if k == 1:
                    piece = v.decode("utf-8")
                elif k == 2:
                    score = struct.unpack("<f", v)[0]
                elif k == 3:
                    kind = v
            m.pieces.append((piece, score, kind))
        elif no == 2:
            for k, _, v in _fields(value):
                if k == 3:
                    m.model_type = v
                elif k == 24:
                    m.whitespace_as_suffix = bool(v)
                elif k == 35:
                    m.byte_fallback = bool(v)
        elif no == 3:
            for k, _, v in _fields(value):
                if k == 2:
                    m.charsmap = v
                elif k == 3:
                    m.add_dummy_prefix = bool(v)
                elif k == 4:
                    m.remove_extra_whitespaces = bool(v)
    if m.model_type not in (1, 2):
        raise ValueError("only unigram and BPE models are supported")
    return m


def build_tokenizer(m: SpmModel):
    """A tokenizers.Tokenizer; the leading marker is put on by `Codec`, so that an empty text stays empty."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    unk = next((i for i, p in enumerate(m.pieces) if p[2] == UNKNOWN), 0)
    # control and unused pieces never match text, so they get names that no text has
    names = [p if k in (NORMAL, USER_DEFINED, BYTE, UNKNOWN) else f"\U0010fffd{i}" for i, (p, _, k) in enumerate(m.pieces)]
    if m.model_type == 1:
        model = models.Unigram([(n, s) for n, (_, s, _) in zip(names, m.pieces, strict=True)], unk, m.byte_fallback)
    else:
        vocab = {n: i for i, n in enumerate(names)}
        score = {p: s for p, s, k in m.pieces if k in (NORMAL, USER_DEFINED)}
        merges = []
        for i, (p, s, k) in enumerate(m.pieces):
            if k == NORMAL and len(p) > 1:
                merges += [(-s, i, j, p[:j], p[j:]) for j in range(1, len(p)) if p[:j] in score and p[j:] in score]
        merges.sort()
        model = models.BPE(vocab=vocab, merges=[(a, b) for *_, a, b in merges], unk_token=names[unk], fuse_unk=True, byte_fallback=m.byte_fallback)
    t = Tokenizer(model)
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.remove_extra_whitespaces:
        steps.append(normalizers.Replace(Regex(" {2,}"), " "))
    t.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
    if user := [AddedToken(p, normalized=False) for p, _, k in m.pieces if k == USER_DEFINED]:
        t.add_tokens(user)
    return t


_ODD, _CUT = r"\A |  ", re.compile(r"(?<=[^ ]) ")
_CODECS: dict[str, Codec] = {}


class Codec:
    """Encodes and decodes lists of texts; ids are little-endian unsigned 32-bit."""

    def __init__(self, path: str, threads: int = 2, cache: int = 64 << 20):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece

        from quern.llm._words import by_lead

        with open(path, "rb") as f:
            data = f.read()
        self.model = m = parse_model(data)
        self.tok = build_tokenizer(m)
        self.spm = sentencepiece.SentencePieceProcessor(model_proto=data)
        inner = any(MARK in p.lstrip(MARK) for p, _, k in m.pieces if k in (NORMAL, USER_DEFINED))
        # words can be taken alone where no piece spans a space and the normaliser maps single characters only
        self.by_word = not (inner or m.whitespace_as_suffix or m.remove_extra_whitespaces or m.charsmap or not m.add_dummy_prefix)
        lead = np.array([p.startswith(MARK) and k == NORMAL for p, _, k in m.pieces] or [False])
        self.spaced, self.cache = by_lead(self.tok, lead, MARK), cache
        self.known = None

    @staticmethod
    def of(path: str, threads: int = 2) -> Codec:
        """The codec of a file, built once by a worker process; its segments are forgotten."""
        if path not in _CODECS:
            _CODECS[path] = Codec(path, threads)
        _CODECS[path].known = None
        return _CODECS[path]

    def _segments(self, segments: list[str]) -> tuple[np.ndarray, ...]:
        """(ids, lengths, characters when decoded, decoded alike?, does sentencepiece agree?) of segments behind a space."""
        flat, n = self.spaced(segments)
        ends = np.append(0, np.cumsum(n))
        chars = np.fromiter(map(len, segments), np.int64, len(segments)) + 1
        exact, same = np.ones(len(segments), bool), np.ones(len(segments), bool)

        def check(lo: int, hi: int) -> None:
            """Compare a run of segments as one text, and its halves where that differs."""
            ids = flat[ends[lo] : ends[hi]].tolist()
            text = " " + " ".join(segments[lo:hi])
            if hi - lo > 1:
                back, other = self.tok.decode(ids, skip_special_tokens=False) == text, self.spm.encode(text[1:]) == ids
                if not (back and other):
                    check(lo, (lo + hi) // 2)
                    check((lo + hi) // 2, hi)
            else:
                back = self.tok.decode(ids, skip_special_tokens=False)
                chars[lo], exact[lo] = len(back), back == text.replace(MARK, " ")
                same[lo] = self.spm.encode(segments[lo]) == (ids if segments[lo] else [])  # alone an empty text has no ids

        for lo in range(0, len(segments), 256):
            check(lo, min(lo + 256, len(segments)))
        return flat, n, chars, exact, same

    def _whole(self, texts: list[str]) -> tuple[list[list[int]], list[bool]]:
        """Ids of texts that are encoded in one piece, and whether both libraries agree."""
        given = [t.strip(" ") for t in texts] if self.model.remove_extra_whitespaces else texts
        lead = " " if self.model.add_dummy_prefix else ""
        ours = [e.ids if t else [] for e, t in zip(self.tok.encode_batch_fast([lead + t for t in given], add_special_tokens=False), given, strict=True)]
        return ours, [a == b for a, b in zip(ours, self.spm.encode(texts, num_threads=1), strict=True)]

    def survey(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """(ids of all texts, offsets, characters when decoded, decoded alike?, do both libraries agree?)."""
        from quern.llm._words import Segments, joined, split

        texts = [t.encode("utf-8", "replace").decode() if t else "" for t in texts]
        if not self.by_word:
            ids, same = [], []
            for i in range(0, len(texts), 256):
                a, b = self._whole(texts[i : i + 256])
                ids, same = ids + a, same + b
            flat, n = joined(ids)
            back = self.decode([np.array(x, "<u4").tobytes() for x in ids])
            exact = [x == self.normalize(t) for x, t in zip(back, texts, strict=True)]
            return flat, np.append(0, np.cumsum(n)), np.array([len(x) for x in back], np.int64), np.array(exact, bool), np.array(same, bool)
        if self.known is None:
            self.known = Segments(self._segments, self.cache)
        some = np.array([bool(t) for t in texts], bool)
        at, words, names = split(pa.array([t for t in texts if t], pa.string()), _ODD, _CUT)
        number = self.known.numbers(names)[words]
        flat = self.known.ids(number)
        out = [np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), np.ones(len(texts), bool), np.ones(len(texts), bool)]
        if len(number):
            _, n, chars, exact, same = self.known.columns
            # what a text lacks is the space that the dummy prefix brought
            for to, f, x in ((out[0], np.add, n), (out[1], np.add, chars), (out[2], np.logical_and, exact), (out[3], np.logical_and, same)):
                to[some] = f.reduceat(x[number], at[:-1])
            out[1][some] -= 1
        return flat, np.append(0, np.cumsum(out[0])), *out[1:]

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """Ids of each text, and whether both libraries agree on all of it."""
        flat, ends, _, _, same = self.survey(texts)
        raw = flat.astype("<u4").tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)], same.tolist()

    def decode(self, ids: list[bytes]) -> list[str]:
        """Texts of id strings, without the space that the dummy prefix brought."""
        out = self.tok.decode_batch([np.frombuffer(b, "<u4").tolist() for b in ids], skip_special_tokens=False)
        return [t[1:] if self.model.add_dummy_prefix and t[:1] == " " else t for t in out]

    def normalize(self, text: str) -> str:
        """What decoding gives back for a text."""
        t = text.encode("utf-8", "replace").decode()
        if self.model.charsmap or self.model.remove_extra_whitespaces:
            t = self.tok.normalizer.normalize_str(t).replace(MARK, " ")
            t = t.strip(" ") if self.model.remove_extra_whitespaces else t
        return t.replace(MARK, " ")


def _encode_fn(path: str, keep_ids: bool, threads: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quern.llm._words import slices

        codec = Codec.of(path, threads)
        for batch in it:
            for a, texts in slices(batch.column(1)):
                flat, ends, chars, exact, same = codec.survey(texts.to_pylist())
                raw = memoryview(flat.astype("<u4", copy=False)).cast("B") if len(flat) else b""
                crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
                cols = [batch.column(0).slice(a, len(texts)), pa.array(np.diff(ends)), pa.array(crc, pa.int64()), *map(pa.array, (chars, exact, same))]
                names = ["id", "n_tokens", "ids_crc32", "n_chars_decoded", "round_trip", "parity"]
                if keep_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def encode_documents(df: DataFrame, model_path: str, id_col="doc_id", text_col="text", keep_ids: bool = True, threads: int = 2) -> DataFrame:
    """A row per text: n_tokens, ids_crc32, n_chars_decoded, round_trip, parity and, with keep_ids, ids."""
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_crc32 long, n_chars_decoded long, round_trip boolean, parity boolean" + (", ids array<int>" if keep_ids else "")
    return df.select(id_col, text_col).mapInArrow(_encode_fn(model_path, keep_ids, threads), schema).withColumnRenamed("id", id_col)


def decode_documents(df: DataFrame, model_path: str, id_col="doc_id", ids_col="ids") -> DataFrame:
    """A row per id list: its text (null ids: empty)."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(it):
        codec = Codec.of(model_path)
        for batch in it:
            ids = [np.array(x or [], "<u4").tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codec.decode(ids), pa.string())], ["id", "text"])

    return df.select(id_col, ids_col).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), keep_ids=False)
