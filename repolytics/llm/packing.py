"""Packing of documents into fixed windows by non-negative least squares.

Documents are cut into full windows and one remainder. Of the remainders only the histogram of
lengths (at most one number for each length) reaches the driver. There combinations of up to three lengths that
fill a window are enumerated, non-negative least squares find how often to use each, the
counts are rounded, and what is left of the histogram is packed greedily, pattern by pattern.
The plan maps ranks within a length to sequences and offsets; it is bounded by the window
size, whatever the number of documents. Ranks come from counters kept while the pieces are
written plus offsets of the tasks, so no length is ever gathered in one task.

Defined results: a null text is empty (one end id); an empty table gives an empty result;
repeated rows are packed one by one; a null id is carried along; columns of any name may be
present. A piece's ids are the text's ids with the end id appended, from ``start`` on.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import written
from .tokens import encoded

WINDOW = 1024


def combinations(window: int, spread: int = 12) -> np.ndarray:
    """Rows of up to three lengths, padded by 0, that sum to ``window``.

    All pairs, and for every length triples whose second member takes ``spread`` even steps.
    """
    one = np.arange(1, window)
    pairs = {(max(a, window - a), min(a, window - a), 0) for a in one.tolist()}
    triples = set()
    for a in one.tolist():
        for k in range(1, spread + 1):
            b = (window - a) * k // (spread + 1)
            c = window - a - b
            if b > 0 and c > 0:
                triples.add(tuple(sorted((a, b, c), reverse=True)))
    return np.array(sorted(pairs | triples), np.int64).reshape(-1, 3)


def solve(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative repeat counts whose lengths come closest to the histogram in squares.

    Multiplicative steps keep counts non-negative and never raise the error.
    """
    size = len(histogram)

    def lengths_of(x):
        out = np.zeros(size)
        for k in range(patterns.shape[1]):
            out += np.bincount(patterns[:, k], x, minlength=size)
        out[0] = 0
        return out

    def per_pattern(v):
        v = v.copy()
        v[0] = 0
        return v[patterns].sum(axis=1)

    aim = per_pattern(histogram.astype(float))
    x = aim / max(size, 1) + 1e-9
    for _ in range(rounds):
        x *= aim / np.maximum(per_pattern(lengths_of(x)), 1e-12)
    return x


@dataclass
class Plan:
    """Per length: sorted first ranks, and the first sequence and the offset at each."""

    ranks: list[np.ndarray]
    sequences: list[np.ndarray]
    offsets: list[np.ndarray]
    n_sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for n in np.unique(length).tolist():
            at = np.flatnonzero(length == n)
            k = np.searchsorted(self.ranks[n], rank[at], "right") - 1
            sequence[at] = self.sequences[n][k] + rank[at] - self.ranks[n][k]
            offset[at] = self.offsets[n][k]
        return sequence, offset


def _greedy(left: np.ndarray, window: int) -> list[tuple[list[int], int]]:
    """Fill windows with the largest length that fits, each pattern as often as it can repeat."""
    left, out = left.copy(), []
    while left.any():
        pattern, room, use = [], window, {}
        while room > 0:
            fits = np.flatnonzero(left[: room + 1] > 0)
            fits = fits[left[fits] > np.array([use.get(int(n), 0) for n in fits])] if use else fits
            if not len(fits):
                break
            n = int(fits[-1])
            pattern.append(n)
            use[n] = use.get(n, 0) + 1
            room -= n
        times = min(int(left[n]) // k for n, k in use.items())
        for n, k in use.items():
            left[n] -= times * k
        out.append((pattern, times))
    return out


def make_plan(histogram: np.ndarray, window: int = WINDOW) -> Plan:
    """``histogram[n]``: number of pieces of length ``n``, for 0 (none) to ``window``."""
    left = histogram.astype(np.int64).copy()
    used: list[tuple[list[int], int]] = [([window], int(left[window]))] if left[window] else []
    left[window] = 0
    if left.any():
        patterns = combinations(window)
        counts = solve(patterns, left[: window + 1])
        for i in np.argsort(-counts, kind="stable"):
            if counts[i] < 0.5:
                break
            pattern = [int(n) for n in patterns[i] if n]
            times = min(int(round(counts[i])), *(int(left[n]) // pattern.count(n) for n in pattern))
            if times:
                for n in pattern:
                    left[n] -= times
                used.append((pattern, times))
        used += _greedy(left, window)
    ranks, sequences, offsets = ([[] for _ in range(window + 1)] for _ in range(3))
    taken, base = np.zeros(window + 1, np.int64), 0
    for pattern, times in used:
        at = 0
        for n in pattern:
            ranks[n].append(int(taken[n]))
            sequences[n].append(base)
            offsets[n].append(at)
            taken[n] += times
            at += n
        base += times
    return Plan(*([np.array(x, np.int64) for x in kind] for kind in (ranks, sequences, offsets)), base)


def pieces(docs: DataFrame, path: str, id: str, text: str, end: int, window: int, with_ids: bool = False) -> DataFrame:
    """Every document's pieces with their number among the task's pieces of equal length."""
    kind = docs.schema[id].dataType.simpleString()
    extra = ", ids binary" if with_ids else ""

    def run(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        for batch in batches:
            for first, ids, at in encoded(batch, 1, path):
                rows: list[tuple] = []
                for i in range(len(at) - 1):
                    own = np.append(ids[at[i] : at[i + 1]], np.uint32(end)).astype("<u4")
                    for start in range(0, len(own), window):
                        piece = own[start : start + window]
                        data = piece.tobytes()
                        rows.append((first + i, start, len(piece), zlib.crc32(data), len(own), int(seen[len(piece)]), data if with_ids else None))
                        seen[len(piece)] += 1
                row, start, length, crc, total, number, data = zip(*rows)
                arrays = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total)), pa.array([part] * len(rows), pa.int32()), pa.array(number, pa.int64())]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(data, pa.binary())][: 8 if with_ids else 7], ["id", "start", "length", "ids_crc32", "doc_tokens", "part", "number", "ids"][: 8 if with_ids else 7])

    slim = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("t"))
    return slim.mapInArrow(run, f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, part int, number bigint{extra}")


def pack(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", end: int = 0, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """``id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of every piece (``ids`` on request)."""
    rows = written(pieces(docs, path, id, text, end, window, with_ids))
    counts = written(rows.groupBy("part", "length").agg(F.count("*").alias("n")))
    # one number for each length: at most ``window`` rows
    histogram = np.zeros(window + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[r["length"]] = r["n"]
    plan = docs.sparkSession.sparkContext.broadcast(make_plan(histogram, window))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]
    ranked = rows.join(base, ["part", "length"]).select(*names, (F.col("base") + F.col("number")).alias("rank"))

    def run(batches):
        for batch in batches:
            sequence, offset = plan.value.place(np.asarray(batch.column(2)), np.asarray(batch.column(batch.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema.fields[:-1])
    return ranked.mapInArrow(run, f"{types}, sequence_id bigint, offset bigint").withColumnRenamed("id", id)
