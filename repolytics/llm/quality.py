"""Quality classifier: a factorization machine over hashed words, structure and metadata.

A text's features are its distinct words hashed to 65,536 buckets, binned structure statistics
(shares of byte classes, line and word lengths, variety of words, each relation as one of 32
bins) and the length given beside it. Every feature has a weight and eight factors; the sum
of all pairwise products is ``((sum v x)^2 - sum (v x)^2) / 2`` and costs linear time.

Fitting takes at most ``SAMPLE`` labelled rows (documented bound, smallest id hashes first), the model
has a fixed size of about 2.4 MB, and scoring is one pass over the rows without a shuffle.

Defined results: a null text is an empty text and gets the score of its structure bins;
without any label every score is 0.5; a null id counts as not held out; columns of any name
may be present.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel
from .shared import fold, labelled_sample

SAMPLE = 12_000
BITS, FACTORS, BINS, STATS = 16, 8, 32, 11
SIZE = (1 << BITS) + STATS * BINS
THRESHOLD = 0.3
ROWS = 2048

# byte classes: 0 upper, 1 lower, 2 digit, 3 blank, 4 line end, 5 sentence marks, 6 other ASCII, 7 non-ASCII
_CLASS = np.full(256, 6, np.int64)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 7
_CLASS[[9, 32]], _CLASS[[10, 13]], _CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 3, 4, 5


def _ratio(a, b):
    return a / np.maximum(b, 1)


def features(data: np.ndarray, offsets: np.ndarray, given: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, values and ``len + 1`` offsets per text. ``given``: length or -1."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    doc = np.repeat(np.arange(n), sizes)
    kinds = np.bincount(doc * 8 + _CLASS[data], minlength=8 * n).reshape(n, 8)
    hashes, at = kernel.words(data, offsets)
    total = np.diff(at)
    key = np.unique((np.repeat(np.arange(n), total) << BITS) | (hashes >> np.uint64(64 - BITS)).astype(np.int64))
    owner, bucket = key >> BITS, key & ((1 << BITS) - 1)
    distinct = np.bincount(owner, minlength=n)
    letters = kinds[:, 0] + kinds[:, 1]
    log = lambda x: np.log2(np.maximum(x, 0) + 1)
    stats = np.stack(
        [
            24 * _ratio(kinds[:, 0], letters),
            60 * _ratio(kinds[:, 6], sizes),
            100 * _ratio(kinds[:, 5], sizes),
            60 * _ratio(kinds[:, 2], sizes),
            60 * _ratio(kinds[:, 3], sizes),
            24 * _ratio(kinds[:, 7], sizes),
            2 * log(_ratio(total, kinds[:, 4] + 1)),
            2 * _ratio(sizes - kinds[:, 3] - kinds[:, 4], total),
            30 * _ratio(distinct, total),
            1.5 * log(total),
            np.where(given < 0, 0, 1 + 1.5 * log(given)),
        ],
        axis=1,
    )
    bins = np.clip(stats, 0, BINS - 1).astype(np.int64) + np.arange(STATS) * BINS + (1 << BITS)
    owner = np.concatenate([owner, np.repeat(np.arange(n), STATS)])
    value = np.concatenate([(1 / np.sqrt(np.maximum(distinct, 1)))[key >> BITS], np.ones(n * STATS)])
    number = np.concatenate([bucket, bins.ravel()])
    order = np.argsort(owner, kind="stable")
    return number[order], value[order], np.concatenate([[0], np.cumsum(distinct + STATS)])


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    @staticmethod
    def empty(seed: int = 7) -> Machine:
        return Machine(0.0, np.zeros(SIZE, np.float32), np.random.default_rng(seed).normal(0, 0.02, (SIZE, FACTORS)).astype(np.float32))

    def _sums(self, number, value, starts):
        vx = self.factors[number] * value[:, None]
        s = np.add.reduceat(vx, starts, axis=0)
        pair = 0.5 * ((s * s).sum(axis=1) - np.add.reduceat((vx * vx).sum(axis=1), starts))
        return vx, s, self.bias + np.add.reduceat(self.weights[number] * value, starts) + pair

    def scores(self, number: np.ndarray, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        if len(at) < 2:
            return np.zeros(0)
        z = self._sums(number, value, at[:-1])[2]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(texts: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 10, batch: int = 128, rate: float = 0.1, shrink: float = 1e-4, seed: int = 7) -> Machine:
    """Logistic loss by mini-batches with per-feature step sizes. ``texts``: numbers, values, label."""
    m = Machine.empty(seed)
    if not texts:
        m.factors[:] = 0
        return m
    seen_w, seen_v, seen_b = np.full(SIZE, 1e-2), np.full((SIZE, FACTORS), 1e-2), 1e-2
    rng = np.random.default_rng(seed)
    # small samples are passed through more often
    for _ in range(max(epochs, -(-600 * batch // len(texts)))):
        turn = rng.permutation(len(texts))
        for i in range(0, len(turn), batch):
            rows = [texts[k] for k in turn[i : i + batch]]
            number, value = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
            lengths = np.array([len(r[0]) for r in rows])
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            vx, s, z = m._sums(number, value, starts)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - np.array([r[2] for r in rows])) / len(rows)
            gx = np.repeat(g, lengths) * value
            order = np.argsort(number, kind="stable")
            which, first = np.unique(number[order], return_index=True)
            gw = np.add.reduceat(gx[order], first) + shrink * m.weights[which]
            gv = np.add.reduceat((gx[:, None] * (np.repeat(s, lengths, axis=0) - vx))[order], first, axis=0) + shrink * m.factors[which]
            seen_w[which] += gw * gw
            seen_v[which] += gv * gv
            seen_b += g.sum() ** 2
            m.weights[which] -= (rate * gw / np.sqrt(seen_w[which])).astype(np.float32)
            m.factors[which] -= (rate * gv / np.sqrt(seen_v[which])).astype(np.float32)
            m.bias -= rate * g.sum() / np.sqrt(seen_b)
    return m


def _inputs(id: str, text: str, length: str | None) -> list[Column]:
    given = F.coalesce(F.col(f"`{length}`").cast("bigint"), F.lit(-1)) if length else F.lit(-1).cast("bigint")
    return [F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("t"), given.alias("given")]


def _parts(batch: pa.RecordBatch):
    given = np.asarray(batch.column(2))
    for first, data, offsets in kernel.doc_slices(batch, "t"):
        n = len(offsets) - 1
        yield first, n, features(data, offsets, given[first : first + n])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id: str = "doc_id", text: str = "text", length: str | None = "n_chars", most: int = SAMPLE) -> Machine:
    """Fit on at most ``most`` labelled rows outside fold 0."""

    def run(batches):
        for batch in batches:
            y = np.asarray(batch.column(3))
            for first, n, (number, value, at) in _parts(batch):
                rows = [(number[at[i] : at[i + 1]].astype(np.int32).tobytes(), value[at[i] : at[i + 1]].astype(np.float32).tobytes()) for i in range(n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(y[first : first + n]), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["id", "y", "number", "value"])

    length = length if length in docs.columns else None
    sample = labelled_sample(docs, labels, label, id, most).select(*_inputs(id, text, length), "__y")
    rows = sample.mapInArrow(run, f"id {docs.schema[id].dataType.simpleString()}, y int, number binary, value binary").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["id"], r["number"]))
    return fit([(np.frombuffer(r["number"], np.int32), np.frombuffer(r["value"], np.float32), r["y"]) for r in rows])


def score(docs: DataFrame, model: Machine, id: str = "doc_id", text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``id`` and ``__score`` of every row."""
    length = length if length in docs.columns else None
    names = [id]
    held = docs.sparkSession.sparkContext.broadcast(model)  # fixed size

    def run(batches):
        for batch in batches:
            scores = [held.value.scores(*f) for _, _, f in _parts(batch)]
            scores = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], pa.array(scores, pa.float64())], [*[f"c{i}" for i in range(len(names))], "score"])

    inputs = docs.select(*_inputs(id, text, length), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    types = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(names))
    out = inputs.mapInArrow(run, f"{types}, score double")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("score").alias("__score"))


def quality_scores(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, held_out, score, predicted`` of every row."""
    scored = score(docs, train(docs, labels, id=id, text=text), id, text)
    held = F.coalesce(fold(F.col(f"`{id}`"), 5) == 0, F.lit(False))
    return scored.select(id, held.alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """Rows the classifier accepts, with all columns: texts go to the tasks once, rejected rows stay there."""
    names = docs.columns
    column, given = names.index(text), names.index(length) if length in names else None
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id=id, text=text, length=length))  # fixed size

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                sizes = np.full(len(part), -1) if given is None else np.asarray(part.column(given).cast(pa.int64()).fill_null(-1))
                data, offsets = kernel.text_bytes(part.column(column))
                keep = np.zeros(len(part), bool)
                for i, j in kernel.slices(offsets):
                    found = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], sizes[i:j])
                    keep[i:j] = held.value.scores(*found) >= THRESHOLD
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
