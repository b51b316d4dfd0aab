"""Benchmark decontamination by greedy string tiling.

Test items and documents are sequences of words (letters and digits, lower case). Runs of five
words shared with an item are its seeds in a document. Where seeds could cover enough of the
item, the longest common runs are marked again and again, without overlap on either side,
found by running Karp-Rabin: hashes of windows of a length that shrinks from pass to pass. The
share of the item's words under marked tiles is the coverage; order does not matter, so a
reordered item is found as well.

The items are a stated query set. They are sent to the tasks in blocks of bounded size
(``BLOCK_WORDS``), and all documents are read once for each block; no pair is built before a seed is shared.

Defined results: an item of fewer than ``least`` words is matched where it occurs as a whole;
null and empty items are never matched; null and empty texts match nothing; rows without id keep a null id; repeated rows
are reported once each; columns of any name may be present.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel

LEAST, COVERAGE = 5, 0.6
BLOCK_WORDS = 1_000_000
_FILTER_BITS = 22


@dataclass
class Items:
    """One block of test items with the sorted hashes of their seeds."""

    ids: list
    words: list[np.ndarray]
    least: int = LEAST
    seeds: np.ndarray = field(init=False)
    item: np.ndarray = field(init=False)
    maybe: np.ndarray = field(init=False)
    short: dict[int, tuple[np.ndarray, np.ndarray]] = field(init=False)

    def __post_init__(self):
        grams = [np.unique(kernel.combine(w, self.least)) for w in self.words]
        # items too short for a seed, by their number of words: sorted hashes of the whole item
        self.short = {}
        for n in sorted({len(w) for w in self.words if len(w) < self.least}):
            own = np.array([i for i, w in enumerate(self.words) if len(w) == n])
            hashes = np.array([kernel.combine(self.words[i], n)[0] for i in own], np.uint64)
            order = np.argsort(hashes, kind="stable")
            self.short[n] = hashes[order], own[order]
        seeds = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(grams)), np.array([len(g) for g in grams], np.int64))
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.item = seeds[order], item[order]
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[(self.seeds >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True


def _windows(words: np.ndarray, marked: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and running hashes of the unmarked windows of ``size`` words."""
    if len(words) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    free = np.concatenate([[0], np.cumsum(~marked)])
    starts = np.flatnonzero(free[size:] - free[:-size] == size)
    # prefix sums of word times power: a window's sum, taken to a common power, is its hash
    n = len(words)
    powers = np.cumprod(np.full(n, 0x9E3779B97F4A7C15, np.uint64))
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers, dtype=np.uint64)])
    return starts, (prefix[starts + size] - prefix[starts]) * powers[n - 1 - starts]


def tile(text: np.ndarray, test: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy tiles ``(text start, test start, length)``, longest first, none shorter than ``least``."""
    in_text, in_test = np.zeros(len(text), bool), np.zeros(len(test), bool)
    tiles, size = [], max(least, min(20, len(test)))

    while True:
        found, longest = [], 0
        ts, th = _windows(text, in_text, size)
        ps, ph = _windows(test, in_test, size)
        # bring the test's hashes to the text's power
        shift = np.uint64(pow(0x9E3779B97F4A7C15, abs(len(text) - len(test)), 1 << 64))
        if len(text) >= len(test):
            ph = ph * shift
        else:
            th = th * shift
        order = np.argsort(th, kind="stable")
        lo, hi = np.searchsorted(th[order], ph, "left"), np.searchsorted(th[order], ph, "right")
        for k in np.flatnonzero(hi > lo).tolist():
            p = int(ps[k])
            for t in ts[order[lo[k] : hi[k]]].tolist():
                if not np.array_equal(text[t : t + size], test[p : p + size]):
                    continue
                n = size
                while p + n < len(test) and t + n < len(text) and text[t + n] == test[p + n] and not in_text[t + n] and not in_test[p + n]:
                    n += 1
                found.append((n, t, p))
                longest = max(longest, n)
        if longest > 2 * size:
            size = longest
            continue
        found.sort(key=lambda m: (-m[0], m[2], m[1]))
        queue = found
        while queue:
            again = []
            for n, t, p in queue:
                if in_text[t : t + n].any() or in_test[p : p + n].any():
                    # what an earlier tile left over, if still long enough
                    free = ~(in_text[t : t + n] | in_test[p : p + n])
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], free.view(np.int8), [0]])))
                    again += [(int(b - a), t + int(a), p + int(a)) for a, b in edges.reshape(-1, 2) if b - a >= size]
                    continue
                in_text[t : t + n], in_test[p : p + n] = True, True
                tiles.append((t, p, n))
            queue = sorted(again, key=lambda m: (-m[0], m[2], m[1]))
        if size <= least:
            return tiles
        size = max(least, size // 2)


def _short_matches(items: Items, hashes: np.ndarray, at: np.ndarray):
    """The same for items shorter than a seed: the first place where the whole item occurs."""
    for n, (wanted, which) in items.short.items():
        grams = kernel.combine(hashes, n)
        lo, hi = np.searchsorted(wanted, grams, "left"), np.searchsorted(wanted, grams, "right")
        place = np.flatnonzero(hi > lo)
        doc = np.searchsorted(at, place, "right") - 1
        whole = place + n <= at[doc + 1]
        found: dict[tuple[int, int], int] = {}
        for p, d in zip(place[whole].tolist(), doc[whole].tolist()):
            for i in which[lo[p] : hi[p]].tolist():
                found.setdefault((d, i), p)
        for (d, i), p in found.items():
            yield d, i, n, [(p, 0, n)]


def _matches(items: Items, hashes: np.ndarray, at: np.ndarray, coverage: float):
    """``(text number, item number, covered words, tiles)`` of one block of texts."""
    yield from _short_matches(items, hashes, at)
    least = items.least
    grams = kernel.combine(hashes, least)
    maybe = np.flatnonzero(items.maybe[(grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
    lo = np.searchsorted(items.seeds, grams[maybe], "left")
    hi = np.searchsorted(items.seeds, grams[maybe], "right")
    hit = hi > lo
    place, lo, hi = maybe[hit], lo[hit], hi[hit]
    doc = np.searchsorted(at, place, "right") - 1
    whole = place + least <= at[doc + 1]
    place, lo, hi, doc = place[whole], lo[whole], hi[whole], doc[whole]
    which = np.concatenate([items.item[a:b] for a, b in zip(lo, hi)]) if len(lo) else np.zeros(0, np.int64)
    place, doc = np.repeat(place, hi - lo), np.repeat(doc, hi - lo)
    order = np.lexsort((place, which, doc))
    place, doc, which = place[order], doc[order], which[order]
    cuts = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (which[1:] != which[:-1])])) if len(doc) else []
    for a, b in zip(cuts, [*cuts[1:], len(doc)]):
        test = items.words[which[a]]
        need = coverage * len(test)
        # an upper bound: every tile consists of seeds
        if least * len(np.unique(grams[place[a:b]])) < need:
            continue
        text, back = _around(hashes, place[a:b], least, len(test) // least + 1)
        tiles = [(int(back[t]), p, n) for t, p, n in tile(text, test, least)]
        covered = sum(n for _, _, n in tiles)
        if covered >= need:
            yield int(doc[a]), int(which[a]), covered, tiles


def _around(hashes: np.ndarray, seeds: np.ndarray, least: int, copies: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of words under seeds, set apart by unique words, with their places.

    Equal runs beyond ``copies`` cannot hold another tile, as tiles do not overlap in the item.
    """
    new = np.concatenate([[True], seeds[1:] > seeds[:-1] + least])
    starts, ends = seeds[new], np.concatenate([seeds[:-1][new[1:]], seeds[-1:]]) + least
    seen: dict[bytes, int] = {}
    words, back = [], []
    for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
        run = hashes[a:b]
        key = run.tobytes()
        seen[key] = seen.get(key, 0) + 1
        if seen[key] <= copies:
            words += [run, np.array([k], np.uint64)]
            back += [np.arange(a, b), np.array([-1])]
    return np.concatenate(words), np.concatenate(back)


def contaminated(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """``id, item_id, item_words, covered, coverage, tiles`` for items covered to ``coverage`` or more.

    ``tiles`` are (word in the text, word in the item, length), longest first.
    """
    kind, test_kind = docs.schema[id].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    slim = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("t"))
    schema = f"id {kind}, item {test_kind}, item_words bigint, covered bigint, coverage double, tiles array<struct<text_word:bigint,item_word:bigint,length:bigint>>"
    found = [slim.mapInArrow(_scan(held, coverage, test_kind), schema) for held in _blocks(benchmark, item, item_text, least)]
    return reduce(DataFrame.unionByName, found).withColumnsRenamed({"id": id, "item": item})


def _blocks(benchmark: DataFrame, item: str, item_text: str, least: int):
    """The items as broadcast blocks of about ``BLOCK_WORDS`` words; at least one, maybe empty."""
    tests = benchmark.select(F.col(f"`{item}`").alias("item"), F.col(f"`{item_text}`").alias("t")).where(F.col("t").isNotNull())
    # words are at most half the bytes
    total = tests.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0] // 2 + 1
    blocks = -(-total // BLOCK_WORDS)
    for k in range(blocks):
        part = tests.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == k).toArrow()
        hashes, at = kernel.words(*kernel.text_bytes(part.column("t")), kernel.PLAIN)
        long = [i for i in range(len(at) - 1) if at[i + 1] > at[i]]
        names = part.column("item").to_pylist()
        yield benchmark.sparkSession.sparkContext.broadcast(Items([names[i] for i in long], [hashes[at[i] : at[i + 1]] for i in long], least))


def _scan(held, coverage: float, test_kind: str):
    def run(batches):
        items = held.value
        for batch in batches:
            for first, data, offsets in kernel.doc_slices(batch, "t"):
                hashes, at = kernel.words(data, offsets, kernel.PLAIN)
                rows = list(_matches(items, hashes, at, coverage))
                sizes = [len(items.words[r[1]]) for r in rows]
                tiles = [[{"text_word": t - int(at[r[0]]), "item_word": p, "length": n} for t, p, n in r[3]] for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([first + r[0] for r in rows], pa.int64())),
                        pa.array([items.ids[r[1]] for r in rows], {"bigint": pa.int64(), "int": pa.int32()}.get(test_kind, pa.string())),
                        pa.array(sizes, pa.int64()),
                        pa.array([r[2] for r in rows], pa.int64()),
                        pa.array([r[2] / n for r, n in zip(rows, sizes)], pa.float64()),
                        pa.array(tiles, pa.list_(pa.struct({"text_word": pa.int64(), "item_word": pa.int64(), "length": pa.int64()}))),
                    ],
                    ["id", "item", "item_words", "covered", "coverage", "tiles"],
                )

    return run


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """Rows of ``docs`` that cover no test item, with all columns; one pass for each block, no join."""
    column = docs.columns.index(text)
    for held in _blocks(benchmark, item, item_text, least):
        docs = docs.mapInArrow(_drop(held, coverage, column), docs.schema)
    return docs


def _drop(held, coverage: float, column: int):
    def run(batches):
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            data, offsets = kernel.text_bytes(batch.column(column))
            for i, j in kernel.slices(offsets):
                hashes, at = kernel.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], kernel.PLAIN)
                for doc, _, _, _ in _matches(held.value, hashes, at, coverage):
                    keep[i + doc] = False
            yield batch.filter(pa.array(keep))

    return run
