"""Toxicity by multiple-instance learning: sentences make the document toxic by noisy-or.

A sentence's probability is logistic in its hashed words; a document is toxic unless all its
sentences are clean, ``P = 1 - prod(1 - p)``. Only document labels are needed for fitting;
the sentences' own probabilities then locate what is offending.

Fitting takes at most ``SAMPLE`` labelled rows (documented bound, smallest id hashes first), the model
has a fixed size of 1 MB, scoring is one pass over whole texts without a shuffle.

Defined results: a null text is empty; a text without words has one empty sentence and gets the
score of the bias alone; without labels scores stay near 0; a null id counts as not held out;
columns of any name may be present.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .shared import fold, labelled_sample

SAMPLE = 12_000
BITS = 18
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[ord(c) for c in ".!?\n"]] = True


def sentences(data: np.ndarray, offsets: np.ndarray):
    """Word buckets, first word of each sentence, sentences per text, and byte spans.

    A sentence ends at ``. ! ?`` or a line end, or with its text; every text has at least one.
    Sentences without a word are left out unless the text has none at all.
    """
    hashes, at, starts, ends = kernel.words(data, offsets, kernel.PLAIN, spans=True)
    bucket = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(at))
    stops = np.cumsum(_ENDS[data])
    place = stops[starts] if len(starts) else starts
    new = np.ones(len(starts), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(starts)]]) - 1 if len(first) else first
    return bucket, first, np.bincount(doc[first], minlength=n), starts[first], ends[last] if len(first) else ends


@dataclass
class Bags:
    bias: float
    weights: np.ndarray

    def sentence_logits(self, bucket: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.bias + np.add.reduceat(self.weights[bucket], first) if len(first) else np.zeros(0)


def _safe(p):
    return np.log1p(-np.minimum(p, 1 - 1e-12))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def document_scores(model: Bags, logits: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
    """Noisy-or over the sentences of each text; a text without words counts as one empty one."""
    owner = np.repeat(np.arange(len(per_doc)), per_doc)
    clean = np.bincount(owner, _safe(_sigmoid(logits)), minlength=len(per_doc))
    clean[per_doc == 0] = _safe(_sigmoid(np.array([model.bias])))[0]
    return -np.expm1(clean)


def _start(place: np.ndarray, doc: np.ndarray, y: np.ndarray, size: int, least: float = 5.0) -> np.ndarray:
    """Smoothed log-odds of the words whose share of toxic texts is far from chance, else 0."""
    seen = np.unique(place.astype(np.int64) * len(y) + doc)
    word, toxic = seen // len(y), y[seen % len(y)] == 1
    a, n = np.bincount(word[toxic], minlength=size), np.bincount(word, minlength=size)
    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    z = (a - n * share) / np.sqrt(n * share * (1 - share))
    return np.where(z >= least, np.log((a + 0.5) / (n - a + 0.5) * (1 - share) / share), 0.0)


def fit(bags: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = 60, settle: int = 30, rate: float = 0.4, sure: float = 3.0) -> Bags:
    """Gradient ascent on the noisy-or likelihood. ``bags``: buckets, first words, label.

    Starts from the words that toxic texts hold far more often and lets the bias settle, so that
    common words are neither blamed nor excused for it. A word's weight then moves only by the part of its gradient beyond ``sure`` standard errors of
    the sentence gradients it sums: at first the blame for a toxic text is spread over all its
    sentences, and only words blamed by several texts and not excused by clean ones stand out.
    """
    m = Bags(-5.0, np.zeros(1 << BITS))
    bags = [b for b in bags if len(b[1])]
    if not bags:
        return m
    base = np.concatenate([[0], np.cumsum([len(b[0]) for b in bags])[:-1]])
    bucket = np.concatenate([b[0] for b in bags])
    first = np.concatenate([b[1] + k for b, k in zip(bags, base)])
    owner = np.repeat(np.arange(len(bags)), [len(b[1]) for b in bags])
    y = np.array([b[2] for b in bags])
    which, place = np.unique(bucket, return_inverse=True)
    line = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(bucket)]])))
    w, seen, seen_bias = _start(place, owner[line], y, len(which)), np.zeros(len(which)), 0.0
    for k in range(settle + rounds):
        p = _sigmoid(m.bias + np.bincount(line, w[place], minlength=len(first)))
        toxic = np.maximum(-np.expm1(np.bincount(owner, _safe(p), minlength=len(bags))), 1e-9)
        blame = p * np.where(y == 1, (1 - toxic) / toxic, -1.0)[owner]
        seen_bias += blame.sum() ** 2
        m.bias += 0.5 * blame.sum() / np.sqrt(max(seen_bias, 1e-12))
        if k < settle:
            continue
        each = blame[line]
        pull = np.bincount(place, each, minlength=len(which))
        doubt = sure * np.sqrt(np.bincount(place, each * each, minlength=len(which)))
        step = np.sign(pull) * np.maximum(np.abs(pull) - doubt, 0)
        seen += step * step
        w += rate * step / np.sqrt(1 + seen)
    m.weights[which] = w
    return m


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id: str = "doc_id", text: str = "text", most: int = SAMPLE) -> Bags:
    def run(batches):
        for batch in batches:
            y = np.asarray(batch.column(2))
            for first, data, offsets in kernel.doc_slices(batch, "t"):
                bucket, begin, per_doc, _, _ = sentences(data, offsets)
                n = len(per_doc)
                s = np.concatenate([[0], np.cumsum(per_doc)])
                edge = np.concatenate([begin, [len(bucket)]])
                rows = [(bucket[edge[s[i]] : edge[s[i + 1]]].astype(np.int32).tobytes(), (begin[s[i] : s[i + 1]] - edge[s[i]]).astype(np.int32).tobytes()) for i in range(n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(y[first : first + n]), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["id", "y", "bucket", "first"])

    sample = labelled_sample(docs, labels, label, id, most).select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("t"), "__y")
    rows = sample.mapInArrow(run, f"id {docs.schema[id].dataType.simpleString()}, y int, bucket binary, first binary").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["id"], r["bucket"]))
    return fit([(np.frombuffer(r["bucket"], np.int32), np.frombuffer(r["first"], np.int32), r["y"]) for r in rows])


def toxicity_scores(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", model: Bags | None = None, offending: float = 0.5) -> DataFrame:
    """``id, held_out, score, predicted, worst_score, worst_start, worst_end, n_offending`` of every row.

    ``worst_start`` and ``worst_end`` are the byte span of the likeliest sentence (the first of
    equals), ``n_offending`` counts the sentences of probability ``offending`` or more.
    """
    model = train(docs, labels, id=id, text=text) if model is None else model
    held = docs.sparkSession.sparkContext.broadcast(model)  # fixed size

    def run(batches):
        for batch in batches:
            for row, data, offsets in kernel.doc_slices(batch, "t"):
                m = held.value
                bucket, first, per_doc, start, end = sentences(data, offsets)
                logits = m.sentence_logits(bucket, first)
                n = len(per_doc)
                p = _sigmoid(logits)
                owner = np.repeat(np.arange(n), per_doc)
                order = np.lexsort((np.arange(len(p)), -p, owner))
                at = np.concatenate([[0], np.cumsum(per_doc)])[:-1]
                some = per_doc > 0
                worst = order[at[some]] if some.any() else order[:0]
                best = np.full(n, _sigmoid(np.array([m.bias]))[0])
                best[some] = p[worst]
                spans = np.zeros((2, n), np.int64)
                spans[0, some], spans[1, some] = start[worst] - offsets[:-1][some], end[worst] - offsets[:-1][some]
                count = np.bincount(owner, p >= offending, minlength=n).astype(np.int64)
                arrays = [batch.column(0).slice(row, n), pa.array(document_scores(m, logits, per_doc)), pa.array(best), pa.array(spans[0]), pa.array(spans[1]), pa.array(count)]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "score", "worst_score", "worst_start", "worst_end", "n_offending"])

    kind = docs.schema[id].dataType.simpleString()
    out = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("t")).mapInArrow(run, f"id {kind}, score double, worst_score double, worst_start bigint, worst_end bigint, n_offending bigint")
    held_out = F.coalesce(fold(F.col("id"), 5) == 0, F.lit(False))
    return out.select(F.col("id").alias(id), held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "worst_score", "worst_start", "worst_end", "n_offending")
