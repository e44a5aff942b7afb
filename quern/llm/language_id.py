"""Language ID: a bidirectional gated recurrent network over UTF-8 bytes, in numpy.

Training: labelled texts, cut into short byte strings; every position
carries the language of its text; cross-entropy by backpropagation through time,
Adam. Prediction: a whole text is cut into segments of SEGMENT bytes, all segments
of a batch run through the network side by side, the softmax at every position is
averaged over the text.

Edge cases: null text, empty text and text without a letter give ("und", 0.0).
Null labels, null ids and rows of the held-out fold are never learned from. With no
labelled row at all, every text is "und". Texts of any length are read whole; a
batch holds at most BATCH_BYTES bytes (one longer text makes several batches).
Repeated rows are predicted alike. Columns named like an output are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm._common import fold, labelled_sample

SEGMENT = 64
BATCH_BYTES = 1 << 20
HIDDEN = 8
TRAIN_PER_LANG = 120
MARGIN, SURE = 0.2, 200


def _sig(x):
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


class ByteBiGRU:
    """Two GRUs (forward and backward) and a linear layer on both states."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 0):
        r, h, n = np.random.default_rng(seed), hidden, len(langs)
        self.langs, self.h = list(langs), h
        self.p = {}
        for d in "fb":
            self.p["E" + d] = (0.3 * r.standard_normal((256, 3 * h))).astype(np.float32)  # byte -> input part of z, r, candidate
            self.p["U" + d] = (r.standard_normal((h, 2 * h)) / np.sqrt(h)).astype(np.float32)
            self.p["V" + d] = (r.standard_normal((h, h)) / np.sqrt(h)).astype(np.float32)
        self.p["O"] = (r.standard_normal((2 * h, n)) / np.sqrt(2 * h)).astype(np.float32)
        self.p["c"] = np.zeros(n, np.float32)

    def _run(self, x: np.ndarray, d: str, keep: bool = False):
        """States (T, B, h) of one direction over bytes x (T, B)."""
        h, (T, B) = self.h, x.shape
        E, U, V = (self.p[k + d] for k in "EUV")
        s = np.zeros((B, h), np.float32)
        out, tape = np.empty((T, B, h), np.float32), []
        for t in range(T) if d == "f" else range(T - 1, -1, -1):
            e = E.take(x[t], axis=0)
            g = s @ U
            g += e[:, : 2 * h]
            _sig(g)
            z, rs = g[:, :h], g[:, h:] * s
            c = rs @ V
            c += e[:, 2 * h :]
            np.tanh(c, out=c)
            if keep:
                tape.append((t, s, g, c, rs))
            s = s + z * (c - s)
            out[t] = s
        return out, tape

    def _states(self, x: np.ndarray, d: str) -> np.ndarray:
        """As _run without a tape; gates lie in arrays of their own, so that every step works on whole ones."""
        h, (T, B) = self.h, x.shape
        E, U, V = (self.p[k + d] for k in "EUV")
        # the logistic function is taken as a tanh of half its argument; the halves are folded into the weights
        Ez, Er, Ec = (np.ascontiguousarray(E[:, k * h : k * h + h] * w) for k, w in ((0, 0.5), (1, 0.5), (2, 1)))
        Uz, Ur = (np.ascontiguousarray(U[:, k * h : k * h + h] * 0.5) for k in (0, 1))
        out, s, (z, r, c, e) = np.empty((T, B, h), np.float32), np.zeros((B, h), np.float32), np.empty((4, B, h), np.float32)
        for t in range(T) if d == "f" else range(T - 1, -1, -1):
            at = x[t]
            for gate, W, table in ((r, Ur, Er), (z, Uz, Ez)):
                np.matmul(s, W, out=gate)
                table.take(at, axis=0, out=e, mode="clip")
                gate += e
                np.tanh(gate, out=gate)
                gate += 1.0
                gate *= 0.5
            r *= s
            np.matmul(r, V, out=c)
            Ec.take(at, axis=0, out=e, mode="clip")
            c += e
            np.tanh(c, out=c)
            c -= s
            c *= z
            s = np.add(s, c, out=out[t])
        return out

    def position_probs(self, x: np.ndarray) -> np.ndarray:
        """(languages, T, B): the softmax at every byte."""
        at, n = x.astype(np.intp), len(self.langs)
        o = self.p["O"][: self.h].T @ self._states(at, "f").reshape(-1, self.h).T
        o += self.p["O"][self.h :].T @ self._states(at, "b").reshape(-1, self.h).T
        o += self.p["c"][:, None]
        o -= o.max(0)
        np.exp(o, out=o)
        o /= o.sum(0)
        return o.reshape(n, *x.shape)

    def loss_grad(self, x: np.ndarray, y: np.ndarray):
        """Mean cross-entropy over all positions and its gradient (backpropagation through time)."""
        T, B = x.shape
        h, P = self.h, self.p
        runs = {d: self._run(x, d, True) for d in "fb"}
        S = np.concatenate([runs["f"][0], runs["b"][0]], axis=-1)
        o = S @ P["O"] + P["c"]
        o -= o.max(-1, keepdims=True)
        q = np.exp(o)
        q /= q.sum(-1, keepdims=True)
        loss = -np.log(q[:, np.arange(B), y] + 1e-9).mean()
        q[:, np.arange(B), y] -= 1
        q /= T * B
        G = {k: np.zeros_like(v) for k, v in P.items()}
        G["O"] = np.einsum("tbi,tbj->ij", S, q)
        G["c"] = q.sum((0, 1))
        dS = q @ P["O"].T
        for d, part in (("f", dS[..., :h]), ("b", dS[..., h:])):
            U, V, back = P["U" + d], P["V" + d], np.zeros((B, h), np.float32)
            for t, s, g, c, rs in reversed(runs[d][1]):
                back = back + part[t]
                z, r = g[:, :h], g[:, h:]
                dc = back * z * (1 - c * c)
                drs = dc @ V.T
                dg = np.concatenate([back * (c - s) * z * (1 - z), drs * s * r * (1 - r)], axis=1)
                np.add.at(G["E" + d], x[t], np.concatenate([dg, dc], axis=1))
                G["U" + d] += s.T @ dg
                G["V" + d] += rs.T @ dc
                back = back * (1 - z) + drs * r + dg @ U.T
        return loss, G

    def fit(self, texts: list[bytes], labels: list[str], epochs: int = 2, batch: int = 128, steps: int = 48, seed: int = 1):
        """Adam on byte strings of `steps` bytes cut from texts."""
        index = {v: i for i, v in enumerate(self.langs)}
        xs, ys = [], []
        for t, v in zip(texts, labels, strict=True):
            for i in range(0, max(1, len(t) - steps // 2), steps):
                if piece := t[i : i + steps]:
                    xs.append(np.resize(np.frombuffer(piece, np.uint8), steps))
                    ys.append(index[v])
        if not xs:
            return self
        X, Y, r = np.stack(xs), np.array(ys), np.random.default_rng(seed)
        m, v2, k = {a: np.zeros_like(b) for a, b in self.p.items()}, {a: np.zeros_like(b) for a, b in self.p.items()}, 0
        total = epochs * -(-len(X) // batch)
        for _ in range(epochs):
            order = r.permutation(len(X))
            for i in range(0, len(X), batch):
                at = order[i : i + batch]
                _, G = self.loss_grad(np.ascontiguousarray(X[at].T), Y[at])
                k += 1
                norm = np.sqrt(sum(float((g * g).sum()) for g in G.values()))
                rate = 0.02 * (1 - 0.9 * k / total)
                for a, g in G.items():
                    g = g * min(1.0, 1.0 / (norm + 1e-9))
                    m[a] = 0.9 * m[a] + 0.1 * g
                    v2[a] = 0.999 * v2[a] + 0.001 * g * g
                    self.p[a] -= (rate * (m[a] / (1 - 0.9**k)) / (np.sqrt(v2[a] / (1 - 0.999**k)) + 1e-8)).astype(np.float32)
        return self

    def pool(self, texts: list[bytes]) -> np.ndarray:
        """Mean softmax over all bytes of each text (zeros for an empty one)."""
        n = len(self.langs)
        total = np.zeros((len(texts), n))
        todo, size = [], 0
        for i, t in enumerate(texts):
            for a in range(0, len(t), BATCH_BYTES):
                todo.append((i, t[a : a + BATCH_BYTES]))
                size += len(todo[-1][1])
                if size >= BATCH_BYTES:
                    self._add(todo, total)
                    todo, size = [], 0
        self._add(todo, total)
        lengths = np.array([max(1, len(t)) for t in texts], float)
        return total / lengths[:, None]

    def _add(self, parts: list[tuple[int, bytes]], total: np.ndarray) -> None:
        """Add the sums over positions; segments of one length run together."""
        if not parts:
            return
        full, owner, rest = [], [], {}
        for i, t in parts:
            k = len(t) // SEGMENT
            full.append(t[: k * SEGMENT])
            owner += [i] * k
            if tail := t[k * SEGMENT :]:
                # a tail is run on the last SEGMENT bytes of its text where there are so many; only its own positions count
                rest.setdefault(SEGMENT if k else -(-len(tail) // 8) * 8, []).append((i, t[-SEGMENT:] if k else tail, len(tail)))
        if owner:
            x = np.frombuffer(b"".join(full), np.uint8).reshape(-1, SEGMENT).T
            own = np.array(owner)
            for a in range(0, len(own), 2048):
                self._sum(np.ascontiguousarray(x[:, a : a + 2048]), own[a : a + 2048], None, total)
        for width, group in rest.items():
            for a in range(0, len(group), 2048):
                g = group[a : a + 2048]
                x = np.full((width, len(g)), 32, np.uint8)
                mask = np.zeros((width, len(g)), np.float32)
                for j, (_, s, n) in enumerate(g):
                    x[: len(s), j] = np.frombuffer(s, np.uint8)
                    mask[len(s) - n : len(s), j] = 1
                self._sum(x, np.array([i for i, *_ in g]), mask, total)

    def _sum(self, x, own, mask, total) -> None:
        q = self.position_probs(x)
        np.add.at(total, own, (q.sum(1) if mask is None else np.einsum("ltb,tb->lb", q, mask)).T)


def train(df: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", per_lang: int = TRAIN_PER_LANG, held_out_mod: int = 5) -> ByteBiGRU | None:
    """Fit on at most per_lang whole texts of each language, none from the held-out fold."""
    got = labelled_sample(df.where(fold(id_col, held_out_mod) != 0), id_col, text_col, lang_col, per_lang)
    if got is None or not len(got):
        return None
    langs = sorted(set(got["label"]))
    return ByteBiGRU(langs).fit([t.encode("utf-8", "replace") for t in got["text"]], list(got["label"]))


def prediction(model: ByteBiGRU | None, text_col: str = "text") -> Column:
    """A struct of lang_pred (string) and score (probability of that language)."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        clean = [t if isinstance(t, str) else "" for t in texts]
        has = np.array([any(map(str.isalpha, t)) for t in clean], bool)
        pred, score = np.full(len(clean), "und", object), np.zeros(len(clean))
        if model is not None and has.any():
            q = model.pool([t.encode("utf-8", "replace") if ok else b"" for t, ok in zip(clean, has, strict=True)])
            pred[has] = np.array(model.langs, object)[q[has].argmax(1)]
            score[has] = np.clip(q[has].max(1), 0, 1)
        return pd.DataFrame({"lang_pred": pred, "score": score})

    return predict(F.col(f"`{text_col}`"))


def identify(df: DataFrame, model: ByteBiGRU | None, text_col: str = "text") -> DataFrame:
    """df with lang_pred (string) and score (probability of that language)."""
    tmp = "__quern_lang"
    return df.withColumn(tmp, prediction(model, text_col)).withColumns({"lang_pred": F.col(f"{tmp}.lang_pred"), "score": F.col(f"{tmp}.score")}).drop(tmp)


def recognised(df: DataFrame, model: ByteBiGRU | None, text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """The rows of df, as they are, whose language is recognised: better than chance among the languages by `margin` of what lies above chance.

    Of a text of fewer than SURE bytes, whose mean is less sure, in proportion less is asked.
    """
    if model is None:
        return df.where(F.lit(False))
    chance = 1 / len(model.langs)
    least = F.lit(chance - 1e-6) + F.lit(margin * (1 - chance)) * F.least(F.lit(1.0), F.octet_length(f"`{text_col}`") / F.lit(float(SURE)))
    found = df.withColumn("__quern_lang", prediction(model, text_col))
    return found.where((F.col("__quern_lang.lang_pred") != "und") & (F.col("__quern_lang.score") >= least)).drop("__quern_lang")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs)
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(True)).alias("held_out"), "lang_pred", "score"
    )
