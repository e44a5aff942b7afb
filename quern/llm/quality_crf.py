"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Every line is labelled good or bad from features of itself and of its neighbours.
Training texts carry their document's label on each line; the log-likelihood and its
gradient come from forward-backward, the optimiser is Adam, all in numpy. The score of
a text is the mean marginal of "good" over its lines, weighted by their length, put
through a one-dimensional logistic fit on the training texts.

Edge cases: null, empty and blank texts have one line of length zero; their score is
that of an empty line. Labels of unknown ids and null labels are not learned from;
without two classes in the labels every score is 0.5. Texts of any length are read
whole. Repeated rows score alike; an id with several labels counts with each of them.
Columns named like an output are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm._common import fold, labelled_sample

TRAIN_PER_LABEL = 1500
THRESHOLD = 0.3

# classes of bytes: lower case, upper case, digit, space, end of sentence, other ASCII sign, byte of a multi-byte character
_KIND = np.full(256, 6, np.uint8)
_KIND[:128] = 5
_KIND[97:123] = 0
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[9, 11, 12, 13, 32]] = 3
_KIND[[46, 44, 33, 63, 58, 59]] = 4
_BITS = np.zeros((256, 8), np.int32)
_BITS[np.arange(256), _KIND] = 1
_BITS[33, 7] = 1  # exclamation marks once more, on their own
_OWN = 14
N_FEATURES = 3 * _OWN + 3


def _bucket(x, cuts):
    return np.digitize(x, cuts) / len(cuts)


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines, weight of each line, offsets of the texts)."""
    from quern.llm._hash import word_hashes

    lines: list[str] = []
    offsets = [0]
    for t in texts:
        lines += (t or "").split("\n") if t else [""]
        offsets.append(len(lines))
    raw = [s.encode("utf-8", "replace") for s in lines]
    size = np.array([len(r) for r in raw])
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    start = np.cumsum(size + 1) - size - 1
    count = np.empty((len(raw), 8))
    kinds = _KIND[buf]
    for k in range(7):
        count[:, k] = np.add.reduceat((kinds == k).astype(np.int32), start)
    count[:, 7] = np.add.reduceat((buf == 33).astype(np.int32), start)
    n = np.maximum(size, 1)
    words, at = word_hashes(lines)
    nw = np.diff(at)
    owner = np.repeat(np.arange(len(raw)), nw)
    order = np.lexsort((words, owner))
    new = np.ones(len(words), bool)
    new[1:] = (words[order][1:] != words[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order][new], minlength=len(raw))
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    # a line that its text has said before
    key = np.zeros(len(raw), np.uint64)
    np.add.at(key, owner, words * (np.arange(len(words)) - at[owner] + 1).astype(np.uint64))
    by = np.lexsort((np.arange(len(raw)), key, doc))
    again = np.zeros(len(raw))
    again[by[1:]] = (key[by][1:] == key[by][:-1]) & (doc[by][1:] == doc[by][:-1]) & (nw[by][1:] > 0)
    letters = count[:, 0] + count[:, 1] + count[:, 6]
    own = np.stack([
        count[:, 1] / np.maximum(letters, 1),
        count[:, 5] / n,
        count[:, 2] / n,
        count[:, 4] / n,
        letters / n,
        count[:, 7] / n,
        _bucket(letters / np.maximum(nw, 1), [2, 3, 4, 5, 6, 7, 9, 12]),
        _bucket(nw, [1, 2, 4, 8, 16, 32, 64, 128]),
        1 - distinct / np.maximum(nw, 1),
        again,
        (count[:, 1] > 0.6 * letters) & (letters > 3),
        count[:, 5] > 0.1 * n,
        distinct < 0.5 * nw,
        size == 0,
    ], axis=1).astype(np.float32)
    X = np.zeros((len(raw), N_FEATURES), np.float32)
    X[:, :_OWN] = own
    same = doc[1:] == doc[:-1]
    X[1:, _OWN : 2 * _OWN] = own[:-1] * same[:, None]
    X[:-1, 2 * _OWN : 3 * _OWN] = own[1:] * same[:, None]
    X[:, -3] = 1
    X[np.array(offsets[:-1]), -2] = 1
    X[np.array(offsets[1:]) - 1, -1] = 1
    return X, n.astype(float) * (size > 0) + (size == 0) * 1e-3, np.array(offsets)


class LineCRF:
    """States bad (0) and good (1); emissions W'x for good, a 2 x 2 table of transitions."""

    def __init__(self):
        self.w = np.zeros(N_FEATURES)
        self.t = np.zeros((2, 2))
        self.mean, self.std = np.zeros(N_FEATURES), np.ones(N_FEATURES)
        self.slope, self.bias = 1.0, 0.0

    def marginals(self, X: np.ndarray, offsets: np.ndarray, most: int = 256):
        """(P(good) of each line, log Z of each text, expected transitions), all texts side by side.

        A text of more than `most` lines is cut into about as many segments as they have lines:
        products of step matrices carry messages across them, so steps in a row grow with the root of the lines.
        """
        e = ((X - self.mean) / self.std) @ self.w
        length = np.diff(offsets)
        longest = int(length.max(initial=0))
        size = max(1, longest if longest <= most else math.isqrt(longest))
        count = -(-length // size)
        text = np.repeat(np.arange(len(length)), count)
        begin = np.cumsum(count) - count  # the first segment of each text
        index = np.arange(len(text)) - begin[text]
        n = np.minimum(size, length[text] - index * size)
        order = np.argsort(-n, kind="stable")
        start, fresh = (offsets[:-1][text] + index * size)[order], (index == 0)[order]
        steps = int(n.max(initial=0))
        alive = np.searchsorted(-n[order], -np.arange(1, steps + 1), side="right")  # segments that have a line t
        E = np.exp(self.t - self.t.max())
        emit = np.stack([1 / (1 + np.exp(e)), 1 / (1 + np.exp(-e))], axis=1)  # scaled by a factor that marginals do not depend on
        log_scale = np.logaddexp(0, e)
        ahead, behind = np.ones((len(text), 2)), np.ones((len(text), 2))  # messages into each segment
        if len(text) > len(length):
            M = np.tile(np.eye(2), (len(text), 1, 1))
            for t in range(steps):
                k = alive[t]
                A = E[None] * emit[start[:k] + t][:, None, :]
                if t == 0:
                    A[fresh[:k]] = np.eye(2) * emit[start[:k][fresh[:k]]][:, None, :]
                M[:k] = M[:k] @ A
                M[:k] /= M[:k].sum((1, 2), keepdims=True)
            M[order] = M.copy()
            for j in range(1, int(count.max())):
                at = begin[count > j] + j
                v = (ahead[at - 1][:, None, :] @ M[at - 1])[:, 0]
                ahead[at] = v / v.sum(1, keepdims=True)
            for j in range(int(count.max()) - 1, 0, -1):
                at = begin[count > j] + j
                v = (M[at] @ behind[at][:, :, None])[:, :, 0]
                behind[at - 1] = v / v.sum(1, keepdims=True)
        ahead, behind = ahead[order], behind[order]
        alpha, beta = np.empty((len(e), 2)), np.empty((len(e), 2))
        logz, cur = np.zeros(len(text)), None
        for t in range(steps):
            k = alive[t]
            at = start[:k] + t
            into = (cur[:k] if t else ahead[:k]) @ E
            cur = (into if t else np.where(fresh[:k, None], 1.0, into)) * emit[at]
            z = cur.sum(1, keepdims=True)
            cur = cur / z
            alpha[at] = cur
            logz[:k] += np.log(z[:, 0]) + log_scale[at] + (self.t.max() if t else np.where(fresh[:k], 0.0, self.t.max()))
        nxt = np.zeros((0, 2))
        for t in range(steps - 1, -1, -1):
            k, m = alive[t], len(nxt)
            b = behind[:k].copy()
            if m:
                b[:m] = (emit[start[:m] + t + 1] * nxt) @ E.T
                b[:m] /= b[:m].sum(1, keepdims=True)
            beta[start[:k] + t] = b
            nxt = b
        good = alpha * beta
        good = good[:, 1] / good.sum(1)
        inner = np.ones(len(e), bool)
        inner[offsets[1:] - 1] = False  # lines with a next one
        inner = np.flatnonzero(inner)
        joint = alpha[inner][:, :, None] * E[None] * (emit[inner + 1] * beta[inner + 1])[:, None, :]
        pairs = (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        return good, np.bincount(text[order], logz, len(length)), pairs

    def fit(self, texts: list[str], labels: np.ndarray, epochs: int = 60, batch: int = 512, l2: float = 1e-3, seed: int = 0):
        X, weight, offsets = line_features(texts)
        self.mean[:-3], self.std[:-3] = X.mean(0)[:-3], X.std(0)[:-3] + 1e-3
        r, k = np.random.default_rng(seed), 0
        m, v = np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4)
        y = np.asarray(labels, int)
        for epoch in range(epochs):
            for part in np.array_split(r.permutation(len(y)), -(-len(y) // batch)):
                rows = np.concatenate([np.arange(offsets[i], offsets[i + 1]) for i in part])
                n = np.diff(offsets)[part]
                good, _, pairs = self.marginals(X[rows], np.concatenate([[0], np.cumsum(n)]))
                own = np.repeat(y[part], n)
                # texts count alike, whatever the number of their lines
                g = (((X[rows] - self.mean) / self.std) * ((own - good) / np.repeat(n, n))[:, None]).sum(0)
                seen = np.zeros((2, 2))
                np.add.at(seen, (y[part], y[part]), n - 1)
                gt = (seen - pairs) / max(1, n.sum())
                grad = np.concatenate([g / len(part) - l2 * self.w, gt.ravel() - l2 * self.t.ravel()])
                k += 1
                m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
                step = 0.1 * (1 - epoch / epochs) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-6)
                self.w += step[:-4]
                self.t += step[-4:].reshape(2, 2)
        z = self._logit(X, weight, offsets)
        # calibration by Newton steps, towards a slope of one
        a, b = 1.0, 0.0
        for _ in range(30):
            p = 1 / (1 + np.exp(-(a * z + b)))
            q = p * (1 - p) + 1e-9
            G = np.array([((y - p) * z).sum() - 1e-2 * (a - 1), (y - p).sum()])
            H = np.array([[(q * z * z).sum() + 1e-2, (q * z).sum()], [(q * z).sum(), q.sum() + 1e-6]])
            d = np.linalg.solve(H, G)
            a, b = a + np.clip(d[0], -1, 1), b + np.clip(d[1], -1, 1)
        self.slope, self.bias = max(a, 0.05), b
        return self

    def _logit(self, X, weight, offsets):
        good, _, _ = self.marginals(X, offsets)
        mean = np.add.reduceat(good * weight, offsets[:-1]) / np.add.reduceat(weight, offsets[:-1])
        p = np.clip(mean, 1e-4, 1 - 1e-4)
        return np.log(p / (1 - p))

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        z = self._logit(*line_features(texts))
        return 1 / (1 + np.exp(-(self.slope * z + self.bias)))


def train(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", per_label: int = TRAIN_PER_LABEL, held_out_mod: int = 5) -> LineCRF | None:
    """Fit on at most per_label whole texts of each label, none held out."""
    named = labels.where(F.col(label_col).isin(0, 1)).select(id_col, label_col).where(fold(id_col, held_out_mod) != 0)
    counts = {r[0]: r[1] for r in named.groupBy(label_col).count().collect()}
    if len(counts) < 2:
        return None
    # the ids are drawn first, from the labels alone; the texts of 2.3 x per_label ids at most are then looked up
    from quern.llm._common import unit_hash

    share = F.when(F.col(label_col) == 0, F.lit(1.15 * per_label / counts[0])).otherwise(F.lit(1.15 * per_label / counts[1]))
    drawn = named.where(unit_hash(F.col(id_col)) < share).limit(3 * per_label)
    got = labelled_sample(docs.select(id_col, text_col).join(F.broadcast(drawn), id_col), id_col, text_col, label_col, per_label)
    if got is None or got["label"].nunique() < 2:
        return None
    y = got["label"].to_numpy(int)
    model = LineCRF().fit(list(got["text"]), y)
    # the sample is balanced by label; scores are for the labels as they come
    prior, sampled = counts[1] / counts[0], (y == 1).sum() / (y == 0).sum()
    model.bias += float(np.log(prior / sampled))
    return model


def quality(model: LineCRF | None, text_col: str = "text") -> Column:
    """The score of a text (0 to 1, higher: better)."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        from quern.llm._words import batches

        clean = [t if isinstance(t, str) else "" for t in texts]
        if model is None:
            return pd.Series(np.full(len(clean), 0.5))
        return pd.Series(np.concatenate([model.score(clean[a:b]) for a, b in batches(clean, 1_000_000)] or [np.zeros(0)]))

    return score(F.col(f"`{text_col}`"))


def classify(df: DataFrame, model: LineCRF | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df with score (0 to 1, higher: better) and predicted (1 from the threshold on)."""
    return df.withColumn("score", quality(model, text_col)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def good(df: DataFrame, model: LineCRF | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df, as they are, that are predicted to be good."""
    return df.withColumn("__quern_quality", quality(model, text_col)).where(F.col("__quern_quality") >= threshold).drop("__quern_quality")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classify(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(True)).alias("held_out"), "score", "predicted")
