"""Passages that repeat across or inside documents, found by seeds that are extended.

A *window* is ``length`` following words. A window is a repeat when the same words also start
earlier: in a document that comes before, or further to the front of its own. Every word that a
repeat covers is taken out; all windows are judged on the texts as they came in.

*Seeds.* Runs of ``seed`` words are hashed, and each window picks the smallest hash in it
(leftmost among equals). The pick depends on the window's words alone, so equal windows pick
equal seeds at equal places, and about one word in eight starts a seed. Only (hash, document,
place) is shuffled to learn which seeds occur at two places of different texts.

*Extension.* Such a seed brings the hashes of the windows that picked it, which reach over the
words to its left and right. All occurrences of a seed meet one of them, the *hub* (the first in
document order), and the match grows to both sides as far as windows agree. Matches that touch
become one span, a maximal repeat. No two ordinary occurrences are ever paired, hence the work
is linear in the occurrences, however many documents share a passage.

*The rest.* A window that differs from the hub's may equal one of a third document. These are
grouped by (seed, window) hash, combined map-side; all but the first are repeats. So the result is
exact up to 64-bit collisions of both hashes at once.

Documents whose words are all the same as an earlier one's are settled by a hash of the
whole, and only the first of them takes part in the extension. Texts are moved by document key,
never by passage; a hot seed is a hot key of joins that adaptive execution splits, and the other
side has one row for each seed.

Defined results: documents are ordered by id (null first), rows that share an id by a hash of their
text; repeated rows are documents of their own, the first of them stays. A null or empty text has no words and keeps
the hash of nothing; a text with fewer than ``length`` words keeps all. Texts of any length are read
whole, block by block. An empty table gives an empty result. Columns of any name may be present.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernel
from .shared import clean_up, release, written

LENGTH = 20
SEED = 5


def _joined(text: str | None) -> list[bytes]:
    # bytes.split() parts at the same six characters as the kernel
    return (text or "").encode().split()


def seeds(hashes: np.ndarray, at: np.ndarray, length: int, seed: int):
    """Seeds of texts: place, number of the text, first window and number of windows.

    ``hashes`` are the word hashes of all texts, ``at`` where each begins and ends.
    """
    counts = np.maximum(np.diff(at) - length + 1, 0)
    total = int(counts.sum())
    grams = kernel.combine(hashes, seed)
    if not total:
        none = np.zeros(0, np.int64)
        return grams, none, none, none, none
    rows = np.repeat(np.arange(len(counts)), counts)
    starts = np.arange(total) + np.repeat(at[:-1] - np.cumsum(counts) + counts, counts)
    # leftmost smallest gram of every run, by doubling
    reach, width, best = length - seed + 1, 1, np.arange(len(grams))
    while width < reach:
        step = min(width, reach - width)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(grams[right] < grams[left], right, left)
        width += step
    picks = best[starts]
    new = np.concatenate([[True], picks[1:] != picks[:-1]])
    first = np.flatnonzero(new)
    return grams, picks[first], rows[first], starts[first], np.diff(np.append(first, total))


def _keyed(docs: DataFrame, id: str, text: str) -> DataFrame:
    """Documents under a number that follows their order, with word count and hash of the words."""
    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    # equal rows are interchangeable; the hash spreads the rows of one id over ranges
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = ordered.withColumn("key", F.monotonically_increasing_id())

    def run(batches):
        for batch in batches:
            n, whole = [], []
            for text in batch.column(1):
                words = _joined(text.as_py())
                n.append(len(words))
                whole.append(hashlib.sha256(b" ".join(words)).digest())
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), pa.array(n, pa.int64()), pa.array(whole, pa.binary()), batch.column(1)], ["key", "id", "n_words", "whole", "text"])

    return written(ordered.mapInArrow(run, f"key bigint, id {kind}, n_words bigint, whole binary, text string"), "repeats")


def _seed_rows(keyed: DataFrame, length: int, seed: int) -> DataFrame:
    """``hash, key, place, content``: content tells equal places of equal texts from others."""

    def run(batches):
        for batch in batches:
            for i, data, offsets in kernel.doc_slices(batch, "text"):
                hashes, at = kernel.words(data, offsets, letters=kernel.AS_IS)
                grams, picks, rows, _, _ = seeds(hashes, at, length, seed)
                keys = np.asarray(batch.column(0))[i:][rows]
                whole = np.array([int.from_bytes(w.as_py()[:8], "big") for w in batch.column(1).slice(i, len(offsets) - 1)], np.uint64)
                places = picks - at[rows]
                content = kernel.mix(whole[rows] + places.astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(grams[picks].view(np.int64)), pa.array(keys, pa.int64()), pa.array(places, pa.int32()), pa.array(content.view(np.int64))], ["hash", "key", "place", "content"])

    return keyed.where(F.col("n_words") >= length).select("key", "whole", "text").mapInArrow(run, "hash bigint, key bigint, place int, content bigint")


def _around(marked: DataFrame, length: int, seed: int) -> DataFrame:
    """Seeds with the hashes of their windows: ``hash, key, first, windows``.

    ``places`` lists the seeds to open. A window that repeats one of its own document is settled
    here: such runs come back with a null hash and as many windows as they have.
    """

    def run(batches):
        for batch in batches:
            for i, data, offsets in kernel.doc_slices(batch, "text"):
                hashes, at = kernel.words(data, offsets, letters=kernel.AS_IS)
                grams, picks, rows, starts, counts = seeds(hashes, at, length, seed)
                wanted = batch.column(2).slice(i, len(offsets) - 1)
                size = np.diff(np.asarray(wanted.offsets))
                open_at = np.asarray(wanted.flatten(), np.int64) + np.repeat(at[:-1], size)
                use = np.isin(picks, open_at)
                picks, rows, starts, counts = picks[use], rows[use], starts[use], counts[use]
                total = int(counts.sum())
                if not total:
                    continue
                owner = np.repeat(np.arange(len(picks)), counts)
                where = starts[owner] + np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
                windows = kernel.combine(hashes, length)[where]
                order = np.lexsort((where, windows, rows[owner]))
                same = (windows[order][1:] == windows[order][:-1]) & (rows[owner][order][1:] == rows[owner][order][:-1])
                seen = np.zeros(total, bool)
                seen[order[1:][same]] = True
                # runs of windows of one seed that are alike in being seen before
                cut = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (seen[1:] != seen[:-1])]))
                of = owner[cut]
                keys = np.asarray(batch.column(0))[i:][rows[of]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(grams[picks[of]].view(np.int64), mask=seen[cut]),
                        pa.array(keys, pa.int64()),
                        pa.array(where[cut] - at[rows[of]], pa.int32()),
                        # a seed's place within its windows: lets occurrences be laid side by side
                        pa.array(picks[of] - where[cut], pa.int32()),
                        pa.ListArray.from_arrays(pa.array(np.append(cut, total), pa.int32()), pa.array(windows.view(np.int64))),
                    ],
                    ["hash", "key", "first", "back", "windows"],
                )

    return marked.select("key", "text", "places").mapInArrow(run, "hash bigint, key bigint, first int, back int, windows array<bigint>")


def _extend(met: DataFrame) -> DataFrame:
    """Occurrences beside their hub: matched windows and those that stay open.

    ``key, first, n, source, source_first`` for matches; open windows have a null ``source`` and
    their ``hash`` and ``window``.
    """
    names = ["key", "first", "n", "source", "source_first", "hash", "window"]

    def run(batches):
        for batch in batches:
            hash_, key, first, back, windows, hub_key, hub_first, hub_back, hub = (batch.column(k) for k in range(9))
            a, b = np.asarray(windows.flatten(), np.int64), np.asarray(hub.flatten(), np.int64)
            a_at = np.asarray(windows.offsets, np.int64) - windows.offsets[0].as_py()
            b_at = np.asarray(hub.offsets, np.int64) - hub.offsets[0].as_py()
            n = np.diff(a_at)
            owner = np.repeat(np.arange(len(n)), n)
            within = np.arange(len(owner)) - a_at[owner]
            # window w of the occurrence lies where the hub's window w + shift does
            shift = np.asarray(hub_back, np.int64) - np.asarray(back, np.int64)
            other = within + shift[owner]
            inside = (other >= 0) & (other < np.diff(b_at)[owner])
            equal = np.zeros(len(owner), bool)
            equal[inside] = a[inside] == b[b_at[owner[inside]] + other[inside]]
            start = np.asarray(first, np.int64)[owner] + within
            keys, hubs = np.asarray(key, np.int64), np.asarray(hub_key, np.int64)
            cut = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (equal[1:] != equal[:-1])])) if len(owner) else np.zeros(0, np.int64)
            length = np.diff(np.append(cut, len(owner)))
            hit = equal[cut]
            cut, length = cut[hit], length[hit]
            of = owner[cut]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[of]), pa.array(start[cut]), pa.array(length), pa.array(hubs[of]), pa.array(np.asarray(hub_first, np.int64)[of] + other[cut]), pa.nulls(len(of), pa.int64()), pa.nulls(len(of), pa.int64())], names
            )
            rest = np.flatnonzero(~equal)
            of = owner[rest]
            none = pa.nulls(len(of), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(keys[of]), pa.array(start[rest]), pa.array(np.ones(len(of), np.int64)), none, none, pa.array(np.asarray(hash_, np.int64)[of]), pa.array(a[rest])], names)

    columns = ["hash", "key", "first", "back", "windows", "hub_key", "hub_first", "hub_back", "hub_windows"]
    return met.select(*columns).mapInArrow(run, ", ".join(f"{c} bigint" for c in names))


def _runs(keyed: DataFrame, firsts: DataFrame, length: int, seed: int) -> DataFrame:
    """Runs of repeated windows: ``key, first, n, source, source_first``."""
    found = written(_seed_rows(keyed, length, seed), "repeats-seeds")
    # seeds at two places of different texts; smallest and largest combine map-side
    ends = found.groupBy("hash").agg(F.min("content").alias("low"), F.max("content").alias("high"))
    twice = written(ends.where("low != high").select("hash"), "repeats-hashes")
    places = found.join(twice, "hash").groupBy("key").agg(F.collect_list("place").alias("places"))
    marked = written(places.join(firsts, "key", "left_semi"), "repeats-places")
    release(found, twice)
    around = written(_around(keyed.join(marked, "key"), length, seed), "repeats-windows")
    release(marked)
    seeded = around.where(F.col("hash").isNotNull())
    hub = seeded.groupBy("hash").agg(F.min(F.struct("key", "first")).alias("h")).select("hash", "h.*")
    named = {"key": "hub_key", "first": "hub_first", "back": "hub_back", "windows": "hub_windows"}
    hubs = written(seeded.join(hub, ["hash", "key", "first"]).withColumnsRenamed(named), "repeats-hubs")
    met = seeded.join(hubs, "hash").where("key != hub_key or first != hub_first")
    extended = written(_extend(met), "repeats-extended")
    release(hubs)
    rest = extended.where("source is null")
    earliest = rest.groupBy("hash", "window").agg(F.min("key").alias("source"), F.max("key").alias("last"))
    earliest = written(earliest.where("source != last").drop("last"), "repeats-rest")
    later = rest.drop("source").join(earliest, ["hash", "window"]).where("key != source")
    own = around.where(F.col("hash").isNull())
    columns = ["key", F.col("first").cast("bigint").alias("first"), "n", "source", F.col("source_first").cast("bigint").alias("source_first")]
    none = F.lit(None).cast("bigint")
    return (
        extended.where("source is not null").select(*columns)
        .unionByName(later.select(*columns))
        .unionByName(own.withColumns({"n": F.size("windows").cast("bigint"), "source": F.col("key"), "source_first": none}).select(*columns))
    )


def _cut(rows: DataFrame, length: int, texts: bool) -> DataFrame:
    """The words of texts that no repeated window covers: number taken out, hash, kept words."""
    names = ["key", "n_removed", "kept_sha256", *(["kept"] if texts else [])]

    def run(batches):
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            for key, text, runs in zip(*(batch.column(k) for k in range(3))):
                words = _joined(text.as_py())
                depth = np.zeros(len(words) + 1, np.int64)
                for r in runs.as_py() or []:
                    depth[r["first"]] += 1
                    depth[r["first"] + r["n"] + length - 1] -= 1
                gone = np.cumsum(depth)[:-1] > 0
                left = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
                row = [key.as_py(), int(gone.sum()), hashlib.sha256(left).hexdigest(), left.decode()]
                for column, value in zip(columns, row):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return rows.mapInArrow(run, "key bigint, n_removed bigint, kept_sha256 string" + (", kept string" if texts else ""))


def _listed(runs: DataFrame) -> DataFrame:
    # a document has at most one run for each of its windows
    return runs.groupBy("key").agg(F.collect_list(F.struct("first", "n")).alias("runs"))


def _parts(docs: DataFrame, id: str, text: str, length: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    keyed = _keyed(docs, id, text)
    clean_up(docs.sparkSession)
    firsts = written(keyed.groupBy("whole").agg(F.min("key").alias("key")).select("key", "whole"), "repeats-firsts")
    return keyed, firsts, written(_runs(keyed, firsts.select("key"), length, seed), "repeats-runs")


def without_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, seed: int = SEED, texts: bool = False) -> DataFrame:
    """``id, n_words, n_removed, kept_sha256`` of every row; with ``texts`` also the ``kept`` words.

    ``kept_sha256`` is the hash of the kept words, joined by one space.
    """
    keyed, firsts, runs = _parts(docs, id, text, length, seed)
    bare = keyed.select("key", "text").join(_listed(runs), "key", "left" if texts else "inner")
    cut = written(_cut(bare, length, texts), "repeats-cut")
    release(runs)
    marked = keyed.select("key", "id", "n_words", "whole").join(firsts.select("key", F.lit(True).alias("is_first")), "key", "left").join(cut, "key", "left")
    copy = F.col("is_first").isNull() & (F.col("n_words") >= length)
    nothing = hashlib.sha256(b"").hexdigest()
    out = [
        F.col("id").alias(id),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("whole")))).alias("kept_sha256"),
    ]
    return marked.select(*out, *([F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept")] if texts else []))


def maximal_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """``id, first, n_words, source, source_first``: spans of words and the earlier document that has them.

    Runs of windows that follow one another at the same distance from the same source are one
    span. ``source_first`` is null where only the source document is known (matches found besides the
    hub, or within a document). A copy of a whole document is one span.
    """
    keyed, firsts, runs = _parts(docs, id, text, length, seed)
    shift = F.col("source_first") - F.col("first")
    line = Window.partitionBy("key", "source", shift).orderBy("first")
    # runs of one seed end where those of the next begin
    starts = F.coalesce(F.col("first") > F.max(F.col("first") + F.col("n") + (length - 1)).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    grouped = runs.withColumn("new", starts.cast("int")).withColumn("span", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    ends = F.max(F.col("first") + F.col("n")) + (length - 1) - F.min("first")
    spans = grouped.groupBy("key", "source", shift.alias("shift"), "span").agg(F.min("first").alias("first"), ends.alias("n_words"), F.min("source_first").alias("source_first"))
    spans = spans.select("key", "first", "n_words", "source", "source_first")
    narrow = keyed.select("key", "id", "n_words", "whole")
    copies = narrow.join(firsts.withColumnRenamed("key", "source"), "whole").where((F.col("key") != F.col("source")) & (F.col("n_words") >= length))
    zero = F.lit(0).cast("bigint")
    spans = spans.unionByName(copies.select("key", zero.alias("first"), "n_words", "source", zero.alias("source_first")))
    names = narrow.select("key", "id")
    return spans.join(names, "key").join(names.select(F.col("key").alias("source"), F.col("id").alias("source_id")), "source").select(F.col("id").alias(id), "first", "n_words", F.col("source_id").alias("source"), "source_first")
