"""Language-model scores by deleted interpolation.

A token's probability mixes maximum-likelihood estimates of orders two, one and zero. The
weights depend on the bucket (a power of two) of the context's frequency and are learned by
expectation-maximisation on held-out counts: each training token in turn is taken out of the
counts it was part of (leave one out), which needs no second count of the corpus.

Counting goes through a key service instead of exploding tokens. Documents are dealt into
chunks of bounded bytes by a hash of the id. Each chunk sends its distinct words and word pairs (64-bit
hashes, with the chunk's training counts) once to the part that owns the key; the part adds up
and returns totals in the same order. A word as frequent as any costs one entry for each
chunk. Three passes: totals, statistics for the weights (cells of a fixed grid), scores.

Defined results: a null text is empty and consists of the end token; a null id counts as
training (its crc32 is unknown); an empty table gives an empty result; with no training
token every base score uses V = 0; columns of any name may be present.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel
from .shared import fold, written

CHUNK_BYTES = 24 << 20
TOKENS = 1 << 18
PART_KEYS = 3_000_000
FOLDS, HELD = 7, 2
_END = np.uint64(0xE1D5EED5A17B0C3D)
_START = np.uint64(0x57A27B0C3DE1D5EE)
BUCKETS, STEPS = 48, 4
_LEVELS = 64 * STEPS


def _ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and the place of each value among them, in 4 bytes each."""
    order = np.argsort(values)
    if len(order) < 1 << 31:
        order = order.astype(np.int32)
    ranked = values[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    uniq = ranked[new]
    del ranked
    place = np.empty(len(order), order.dtype)
    place[order] = np.cumsum(new, dtype=order.dtype) - order.dtype.type(1)
    return uniq, place


class Chunk:
    """Tokens of some documents, their distinct words and pairs, and the keys sent for them."""

    def __init__(self, ids: pa.Array, texts, held: np.ndarray, parts: int):
        data, offsets = kernel.text_bytes(texts)
        hashes, at = kernel.words(data, offsets)
        del data, offsets, texts
        n = len(held)
        self.ids, self.held, lengths = ids, held, np.diff(at) + 1
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if n else 0
        tokens = np.full(total, _END, np.uint64)
        inner = np.ones(total, bool)
        inner[ends - 1] = False
        tokens[inner] = hashes
        del hashes, inner
        self.first, self.lengths = ends - lengths, lengths
        self.train = np.repeat(~held, lengths)
        self.words, self.word = _ranked(tokens)
        pairs = np.empty(total, np.uint64)
        pairs[1:] = tokens[:-1]
        if n:
            pairs[self.first] = _START
        pairs *= np.uint64(0x9E3779B97F4A7C15)
        pairs += tokens
        del tokens
        pairs = kernel.mix(pairs)
        self.pairs, self.pair = _ranked(pairs)
        self.parts = parts

    def context(self, lo: int, hi: int, word: np.ndarray, starts: int) -> np.ndarray:
        """Counts of the contexts of a range of tokens: of the word before, at a start of the documents."""
        out = np.empty(hi - lo, np.int64)
        out[1:] = word[self.word[lo : hi - 1]]
        if lo and hi > lo:
            out[0] = word[self.word[lo - 1]]
        i, j = np.searchsorted(self.first, [lo, hi])
        out[self.first[i:j] - lo] = starts
        return out

    def blocks(self):
        """Row and token ranges of about ``TOKENS`` tokens; a longer text is a range of its own."""
        bounds = np.append(self.first, len(self.word))
        for i, j in kernel.slices(bounds, TOKENS):
            yield i, j, int(bounds[i]), int(bounds[j])

    def keys(self, kind: int):
        keys, place = ((self.words, self.word), (self.pairs, self.pair))[kind]
        counts = np.bincount(place, self.train, minlength=len(keys)).astype(np.int64)
        part = (keys % np.uint64(self.parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(self.parts + 1))
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            own = order[cuts[p] : cuts[p + 1]]
            yield p, own, keys[own], counts[own]

    def totals(self, kind: int, replies: dict[tuple[int, int], bytes]) -> np.ndarray:
        out = np.zeros(len(self.words if kind == 0 else self.pairs), np.int64)
        for p, own, _, _ in self.keys(kind):
            out[own] = _unpacked(replies[kind, p], len(own))
        return out


def _chunk(left: pa.Table, parts: int) -> Chunk:
    return Chunk(left.column("id").combine_chunks(), left.column("t"), np.asarray(left.column("held")), parts)


def _packed(values: np.ndarray) -> bytes:
    """Counts as 4 bytes each, or 8 where one of them needs more."""
    wide = len(values) > 0 and int(values.max()) >= 1 << 32
    return values.astype(np.uint64 if wide else np.uint32).tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.uint64 if n and len(data) == 8 * n else np.uint32).astype(np.int64)


def _sum_part(table: pa.Table) -> pa.Table:
    """Totals of one part's keys, returned to every chunk in the order it sent them."""
    kind, chunk = np.asarray(table.column("kind")), table.column("chunk")
    keys = [np.frombuffer(b, np.uint64) for b in table.column("keys").to_pylist()]
    counts = [_unpacked(b, len(k)) for b, k in zip(table.column("counts").to_pylist(), keys)]
    replies: list[bytes] = [b""] * len(keys)
    tokens = distinct = 0
    for k in (0, 1):
        rows = np.flatnonzero(kind == k).tolist()
        if not rows:
            continue
        uniq, place = np.unique(np.concatenate([keys[i] for i in rows]), return_inverse=True)
        # sums of doubles are exact up to 2^53
        total = np.bincount(place, np.concatenate([counts[i] for i in rows]), minlength=len(uniq)).astype(np.int64)
        if k == 0:
            tokens, distinct = int(total.sum()), int(np.count_nonzero(total))
        at = 0
        for i in rows:
            replies[i] = _packed(total[place[at : at + len(keys[i])]])
            at += len(keys[i])
    part = table.column("part")
    first = np.arange(len(keys)) == 0
    return pa.table({"chunk": chunk, "part": part, "kind": table.column("kind"), "totals": pa.array(replies, pa.binary()), "tokens": pa.array(np.where(first, tokens, 0)), "distinct": pa.array(np.where(first, distinct, 0))})


def _cells(context: np.ndarray, p2: np.ndarray, p1: np.ndarray, n: np.ndarray):
    level = lambda p: np.where(p > 0, np.clip((-np.log2(np.maximum(p, 1e-19)) * STEPS).astype(np.int64), 0, _LEVELS - 2), _LEVELS - 1)
    cell = (context * _LEVELS + level(p2)) * _LEVELS + level(p1)
    cells, place = np.unique(cell, return_inverse=True)
    return cells, np.bincount(place, n)


def bucket(counts: np.ndarray) -> np.ndarray:
    """Bucket of a context seen ``counts`` times: 0 for never, then powers of two."""
    return np.where(counts > 0, np.minimum(np.log2(np.maximum(counts, 1)).astype(np.int64) + 1, BUCKETS - 1), 0)


def fit_weights(cells: np.ndarray, n: np.ndarray, vocabulary: int, rounds: int = 60) -> np.ndarray:
    """``BUCKETS x 3`` weights (pair, word, uniform) by expectation-maximisation."""
    value = np.append(2.0 ** -((np.arange(_LEVELS - 1) + 0.5) / STEPS), 0.0)
    p = np.stack([value[cells // _LEVELS % _LEVELS], value[cells % _LEVELS], np.full(len(cells), 1 / (vocabulary + 1))], axis=1)
    where = cells // (_LEVELS * _LEVELS)
    weights = np.tile([0.4, 0.4, 0.2], (BUCKETS, 1))
    for _ in range(rounds):
        share = weights[where] * p
        share *= (n / share.sum(axis=1))[:, None]
        got = np.stack([np.bincount(where, share[:, k], minlength=BUCKETS) for k in range(3)], axis=1)
        total = got.sum(axis=1, keepdims=True)
        weights = np.where(total > 0, got / np.maximum(total, 1e-300), weights)
    # no estimate may vanish: an unseen word must keep a probability
    weights = np.maximum(weights, [0.0, 1e-6, 1e-6])
    # a context never seen has no pair estimate
    weights[0, 0] = 0.0
    return weights / weights.sum(axis=1, keepdims=True)


def lm_scores(docs: DataFrame, id: str = "doc_id", text: str = "text", held_out: Column | None = None, chunk_bytes: int = CHUNK_BYTES, part_keys: int = PART_KEYS) -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row, whole texts."""
    kind = docs.schema[id].dataType.simpleString()
    held = fold(F.col(f"`{id}`"), FOLDS) == HELD if held_out is None else held_out
    slim = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("t"), F.coalesce(held, F.lit(False)).alias("held"))
    size = slim.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("b"), F.sum((~F.col("held")).cast("bigint")).alias("n")).first()
    chunks = -(-(size["b"] + 1) // chunk_bytes)
    # a word of English-like text takes about six bytes; parts of that many keys
    parts = -(-(size["b"] + 1) // (6 * part_keys))
    starts = int(size["n"] or 0)
    # rows without or with a repeated id are spread by their text as well
    dealt = slim.withColumn("chunk", F.pmod(F.xxhash64("id", "t"), F.lit(chunks)))

    def ask(key, table):
        c = _chunk(table, parts)
        rows = [(p, k, keys.tobytes(), _packed(counts)) for k in (0, 1) for p, _, keys, counts in c.keys(k)]
        p, k, keys, counts = zip(*rows)
        return pa.table({"chunk": pa.array([key[0].as_py()] * len(rows), pa.int64()), "part": pa.array(p, pa.int64()), "kind": pa.array(k, pa.int32()), "keys": pa.array(keys, pa.binary()), "counts": pa.array(counts, pa.binary())})

    asked = dealt.groupBy("chunk").applyInArrow(ask, "chunk bigint, part bigint, kind int, keys binary, counts binary")
    replies = written(asked.groupBy("part").applyInArrow(_sum_part, "chunk bigint, part bigint, kind int, totals binary, tokens bigint, distinct bigint"), "lm")
    row = replies.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("v")).first()
    n_train, vocabulary = int(row["n"]), int(row["v"])
    answered = replies.select("chunk", "part", "kind", "totals").groupBy("chunk")

    def open_chunk(left: pa.Table, right: pa.Table):
        c = _chunk(left, parts)
        got = dict(zip(zip(right.column("kind").to_pylist(), right.column("part").to_pylist()), right.column("totals").to_pylist()))
        return c, c.totals(0, got), c.totals(1, got)

    def statistics(key, left, right):
        c, word, pair = open_chunk(left, right)
        found = [(np.zeros(0, np.int64), np.zeros(0))]
        for _, _, lo, hi in c.blocks():
            t = c.train[lo:hi]
            # the token itself is taken out of all three counts; its bucket is that of the counts kept
            w, p, x = word[c.word[lo:hi][t]] - 1, pair[c.pair[lo:hi][t]] - 1, c.context(lo, hi, word, starts)[t] - 1
            found.append(_cells(bucket(x), p / np.maximum(x, 1), w / max(n_train - 1, 1), np.ones(len(w))))
        cells, place = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
        n = np.bincount(place, np.concatenate([f[1] for f in found]), minlength=len(cells))
        return pa.table({"cell": pa.array(cells, pa.int64()), "n": pa.array(n.astype(np.int64), pa.int64())})

    cells = dealt.groupBy("chunk").cogroup(answered).applyInArrow(statistics, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    # at most one row for each cell of the grid that occurs, whatever the corpus
    table = cells.toArrow().sort_by("cell")
    weights = fit_weights(np.asarray(table.column("cell")), np.asarray(table.column("n")).astype(float), vocabulary)

    def score(key, left, right):
        c, words, pairs = open_chunk(left, right)
        known, bases, scores = np.zeros(len(c.held), np.int64), np.zeros(len(c.held)), np.zeros(len(c.held))
        for i, j, lo, hi in c.blocks():
            word, pair, context = words[c.word[lo:hi]], pairs[c.pair[lo:hi]], c.context(lo, hi, words, starts)
            mix = weights[bucket(context)]
            p = mix[:, 0] * pair / np.maximum(context, 1) + mix[:, 1] * word / max(n_train, 1) + mix[:, 2] / (vocabulary + 1)
            base = np.log10((word + 1) / (n_train + vocabulary + 1))
            for out, values in ((known, (word > 0).astype(np.int64)), (bases, base), (scores, np.log10(p))):
                out[i:j] = np.add.reduceat(values, c.first[i:j] - lo)
        return pa.table({"id": c.ids, "held_out": pa.array(c.held), "n_tokens": pa.array(c.lengths.astype(np.int64)), "n_known": pa.array(known), "train_tokens": pa.array(np.full(len(c.held), n_train)), "base_score": pa.array(bases), "score": pa.array(scores)})

    out = dealt.groupBy("chunk").cogroup(answered).applyInArrow(score, f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return out.withColumnRenamed("id", id)
