"""Quality scores of texts by attention-based multiple-instance learning.

A text is a bag of passages.  Every passage is encoded from measures of its own words and bytes; gated attention
learns from the texts' labels alone which passages tell, and the text is scored on the attention-weighted sum.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from parley.llm.blocks import Words, is_space, mix, pieces, raw, windows

_U = np.uint64
FEATURES = 37


@dataclass(frozen=True)
class Training:
    """Words in a passage; labelled texts used at most (those with the smallest hashed ids); width, steps and rate of training."""

    passage: int = 64
    most: int = 3000
    hidden: int = 16
    steps: int = 150
    rate: float = 0.02
    decay: float = 1e-4
    seed: int = 7


def passages(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Measures of every passage of ``size`` words and the row it belongs to; a row without words has one passage."""
    w, n = Words(data, offsets), len(offsets) - 1
    count = w.counts()
    many = np.maximum(-(-count // size), 1)
    row = np.repeat(np.arange(n), many)
    turn = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    lo = w.first[row] + turn * size
    hi = np.minimum(lo + size, w.first[row + 1])
    words = (hi - lo).astype(float)
    at_least = np.maximum(words, 1)
    # bytes of a passage: from its first word to the next passage's, the last one to the end of the text
    begin = np.where(turn == 0, offsets[row], np.r_[w.start, len(data)][np.minimum(lo, len(w.start))])
    end = np.where(turn == many[row] - 1, offsets[row + 1], np.r_[w.start, len(data)][np.minimum(hi, len(w.start))])
    length = np.maximum(end - begin, 1).astype(float)

    def share(flag: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(flag)]
        return (total[end] - total[begin]) / length

    upper, lower, digit = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122), (data >= 48) & (data <= 57)
    space, high = is_space(data), data >= 128
    odd = ~(upper | lower | digit | space | high)
    cols = [np.log1p(words), share(upper), share(lower), share(digit), share(high), share(odd), share(data == 10)]
    cols += [share(data == c) for c in b".,!?#*$%&|<>/:;-_()[]@"]  # punctuation, each for itself

    def word_mean(x: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(x)]
        return (total[hi] - total[lo]) / at_least

    size_of = (w.end - w.start).astype(float)
    cols += [word_mean(size_of) / 10, word_mean(size_of <= 3), word_mean(size_of > 14)]
    cols.append(word_mean(upper[w.start]) if len(w.start) else words * 0)
    owner = np.repeat(np.arange(len(row)), (hi - lo))

    def fresh(key: np.ndarray) -> np.ndarray:
        """Whether each word or window comes for the first time under its key."""
        new = np.zeros(len(key), bool)
        new[np.unique(key, return_index=True)[1]] = True
        return new

    cols.append(word_mean(fresh(mix(w.hash + mix(owner.astype(_U)))).astype(float)))  # different words of the passage
    cols.append(word_mean(fresh(mix(w.hash + mix(w.doc.astype(_U)))).astype(float)))  # words new to the text
    h, at = windows(w, 3)
    again = np.zeros(len(w.hash))
    again[at[~fresh(mix(h + mix(w.doc[at].astype(_U))))]] = 1
    cols.append(word_mean(again))  # three-word windows that the text has had before
    same = np.zeros(len(w.hash))
    if len(w.hash) > 1:
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    cols.append(word_mean(same))
    return np.stack(cols, axis=1).astype(np.float32), row


class Attention:
    """Encoder, gated attention and output of the bag model, with its gradient."""

    def __init__(self, width: int, hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        shape = {"w": (width, hidden), "b": (hidden,), "v": (hidden, hidden), "u": (hidden, hidden), "a": (hidden,), "o": (hidden,), "c": (1,)}
        self.p = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) > 1 or k in "ao" else np.zeros(s) for k, s in shape.items()}
        self.mean, self.scale = np.zeros(width), np.ones(width)

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict:
        """``first`` is the first passage of each bag; bags have at least one."""
        p, n = self.p, np.diff(np.r_[first, len(x)])
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["w"] + p["b"])
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (t * g) @ p["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), n))
        weight = e / np.repeat(np.add.reduceat(e, first), n)
        z = np.add.reduceat(weight[:, None] * h, first)
        y = 1 / (1 + np.exp(-(z @ p["o"] + p["c"])))
        return {"x": x, "n": n, "h": h, "t": t, "g": g, "weight": weight, "z": z, "y": y}

    def fit(self, x: np.ndarray, first: np.ndarray, label: np.ndarray, how: Training) -> None:
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        for step in range(1, how.steps + 1):
            f, p = self.forward(x, first), self.p
            n, h, t, g, weight = f["n"], f["h"], f["t"], f["g"], f["weight"]
            d = (f["y"] - label) / len(label)
            dz = np.repeat(d[:, None] * p["o"], n, axis=0)
            dweight = (dz * h).sum(1)
            de = weight * (dweight - np.repeat(np.add.reduceat(weight * dweight, first), n))
            dt, dg = de[:, None] * p["a"] * g * (1 - t * t), de[:, None] * p["a"] * t * g * (1 - g)
            dh = (weight[:, None] * dz + dt @ p["v"].T + dg @ p["u"].T) * (1 - h * h)
            grad = {"w": f["x"].T @ dh, "b": dh.sum(0), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ de, "o": f["z"].T @ d, "c": d.sum(keepdims=True)}
            for k, v in grad.items():
                v = v + how.decay * self.p[k]
                m, s = state[k]
                m[...] = 0.9 * m + 0.1 * v
                s[...] = 0.999 * s + 0.001 * v * v
                self.p[k] = self.p[k] - how.rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never read: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, how: Training) -> Attention:
    """The model fitted on at most ``how.most`` labelled texts outside the held-out fold.

    A doc_id with several labels counts with the largest; null labels and ids are left out.  Without any label every
    text later scores 0.5.
    """
    own = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    order = F.xxhash64("doc_id")
    own = own.orderBy(order, "doc_id").limit(how.most)
    size = how.passage

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                x, row = passages(*raw(part.column("text")), size)
                edge = np.searchsorted(row, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"),
                                                  pa.array([x[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())], ["doc_id", "quality", "x"])

    picked = docs.select("doc_id", "text").join(F.broadcast(own), "doc_id")  # at most ``how.most`` rows of two numbers
    rows = sorted(picked.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"), "text").mapInArrow(run, "doc_id long, quality int, x binary").collect())
    model = Attention(FEATURES, how.hidden, how.seed)
    if rows:
        bags = [np.frombuffer(r[2], np.float32).reshape(-1, FEATURES) for r in rows]
        first = np.r_[0, np.cumsum([len(b) for b in bags])[:-1]]
        model.fit(np.concatenate(bags).astype(np.float64), first, np.array([r[1] for r in rows], float), how)
    else:
        model.p["o"] *= 0
    return model


def scored(docs: DataFrame, labels: DataFrame, how: Training | None = None, least: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of whole texts; ``score`` is the chance of label 1, ``predicted`` is 1 from ``least`` on.

    Only the text is an input.  Null text counts as empty; an empty text is one empty passage.  Repeated rows are scored
    each, a row without doc_id too (not held out); an empty table gives no rows.
    """
    how = how or Training()
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, how))  # a few thousand numbers

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                x, row = passages(*raw(part.column("text")), how.passage)
                y = model.value.forward(x.astype(np.float64), np.searchsorted(row, np.arange(part.num_rows)))["y"]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(y)], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= least).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, how: Training | None = None, least: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose text the classifier predicts as 1; see :func:`scored`."""
    how = how or Training()
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, how))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                x, row = passages(*raw(part.column("text")), how.passage)
                yield part.filter(pa.array(model.value.forward(x.astype(np.float64), np.searchsorted(row, np.arange(part.num_rows)))["y"] >= least))

    return docs.mapInArrow(run, docs.schema)
