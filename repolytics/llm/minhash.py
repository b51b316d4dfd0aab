"""Near-duplicate detection by min-max hashing.

Every permutation of the shingle hashes gives two signature values, its minimum and its
maximum, so half as many permutations are evaluated. Bands of four values propose pairs; each
pair is confirmed on the whole shingle sets, and links close to components.

* Equal sets form one class first; only classes are banded.
* Signatures rule out candidates before any text moves: of a bucket's pairs only those are
  confirmed whose signatures agree in all but 0.2 of the wanted similarity, and only members with
  such a partner have their whole sets brought to the blocks below. A pair of similarity 0.8 fails
  this once in ten million.
* A bucket does not emit its pairs. Its members are compared with the bucket's *hub*, the
  class that shares most buckets with others. Members whose component then equals the hub's
  are settled. The others are compared with the bucket's members block against block inside
  the tasks, blocks being bounded in count and bytes; only links that join components leave a
  task. No pair is left out and no group is gathered in one place. What this
  costs grows with the number of members that stay apart, times the bucket's size.

Defined results: null and empty texts, and texts without a word, have an empty set and link
with nothing; rows without id are returned unlinked (component null, kept); rows that share
an id share its component; an empty table gives an empty result; columns of any name may be present.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .components import components
from .shared import release, written

BANDS, ROWS = 32, 4
CHUNK, BLOCK_BYTES = 256, 1 << 20


@dataclass(frozen=True)
class NearDup:
    """``width`` words a shingle; link when ``100 * intersection >= percent * union``.

    32 bands of 4 values miss a pair of similarity 0.8 once in twenty million.
    """

    width: int = 5
    percent: int = 80
    seed: int = 1

    @property
    def permutations(self) -> int:
        return BANDS * ROWS // 2

    @property
    def least_equal(self) -> int:
        """Signature values a linked pair has in common, 5.6 deviations below what is expected."""
        return int(2 * self.permutations * (self.percent / 100 - 0.2))


def _constants(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def signature(shingles: np.ndarray, multiply: np.ndarray, add: np.ndarray) -> np.ndarray:
    """``[min, max]`` of each permutation, interleaved, as 32-bit values."""
    low = np.full(len(multiply), np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(len(multiply), np.uint64)
    for i in range(0, len(shingles), 1024):
        values = shingles[i : i + 1024, None] * multiply + add
        values ^= values >> np.uint64(29)
        low = np.minimum(low, values.min(axis=0))
        high = np.maximum(high, values.max(axis=0))
    out = np.empty(2 * len(multiply), np.uint64)
    out[0::2], out[1::2] = low, high
    return (kernel.mix(out) >> np.uint64(32)).astype(np.uint32)


def _bands(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band; the band's number is part of it."""
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = kernel.mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key.view(np.int64)


def sketches(docs: DataFrame, id: str, text: str, spec: NearDup) -> DataFrame:
    """``id, n_shingles, set_hash, sig`` of every row, whole texts."""
    width, (multiply, add) = spec.width, _constants(spec.permutations, spec.seed)

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for first, data, offsets in kernel.doc_slices(batch, "t"):
                hashes, at = kernel.words(data, offsets)
                n, sets, sigs = [], [], []
                for i in range(len(offsets) - 1):
                    s = kernel.shingle_set(hashes[at[i] : at[i + 1]], width)
                    n.append(len(s))
                    # two sums of scrambled values stand for the set, whatever its order
                    sets.append(np.array([len(s), kernel.mix(s).sum(dtype=np.uint64), kernel.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)], np.uint64).tobytes())
                    sigs.append(signature(s, multiply, add).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(n)), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(sigs, pa.binary())], ["id", "n_shingles", "set_hash", "sig"])

    slim = docs.select(F.col(f"`{id}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("t"))
    return slim.mapInArrow(run, "id bigint, n_shingles bigint, set_hash binary, sig binary")


def _alike(pairs: DataFrame, classes: DataFrame, spec: NearDup) -> DataFrame:
    """Pairs ``a, b`` whose sizes and signatures allow a link; one byte of each value is compared."""
    percent, least = spec.percent, spec.least_equal

    def brief(batches):
        for batch in batches:
            short = [np.frombuffer(s, np.uint32).astype(np.uint8).tobytes() for s in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(short, pa.binary())], ["rep", "n", "s"])

    def run(batches):
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
            good = pa.array((one == two).sum(axis=1) >= least, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], ["a", "b"])

    short = classes.select("rep", "n_shingles", "sig").mapInArrow(brief, "rep bigint, n bigint, s binary")
    one = short.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa"))
    two = short.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb"))
    both = pairs.join(one, "a").join(two, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def _confirm(pairs: DataFrame, texts: DataFrame, spec: NearDup) -> DataFrame:
    """Pairs ``a, b`` linked on their whole shingle sets."""
    width, percent = spec.width, spec.percent

    def sets(column):
        data, offsets = kernel.text_bytes(column)
        for i, j in kernel.slices(offsets):
            part = data[offsets[i] : offsets[j]]
            hashes, at = kernel.words(part, offsets[i : j + 1] - offsets[i])
            for k in range(j - i):
                yield kernel.shingle_set(hashes[at[k] : at[k + 1]], width)

    def run(batches):
        for batch in batches:
            linked = []
            for x, y in zip(sets(batch.column(2)), sets(batch.column(3))):
                both = len(x) + len(y)
                common = both - len(np.union1d(x, y))
                linked.append(100 * common >= percent * (both - common))
            mask = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    one = texts.select(F.col("id").alias("a"), F.col("t").alias("ta"))
    two = texts.select(F.col("id").alias("b"), F.col("t").alias("tb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


def _dealt(rows: DataFrame, each) -> DataFrame:
    """``rows`` of ``band, main, klass, rep, ..., n_shingles`` with their ``block`` of the group, a
    member taking ``each`` bytes."""
    group = ["band", "main", "klass"]
    many = F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum(each) / BLOCK_BYTES))
    numbered = rows.join(rows.groupBy(*group).agg(many.alias("blocks")), group)
    return numbered.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks"))).drop("blocks")


def _open_members(rows: DataFrame, comps: DataFrame, classes: DataFrame, spec: NearDup) -> DataFrame:
    """Members of buckets that hold several components: ``band, main, klass, rep, comp, sig, n_shingles``.

    ``main`` tells whether a member belongs to the bucket's largest component, ``klass`` is its
    class of sizes.
    """
    now = rows.join(comps, F.col("rep") == F.col("node"), "left").select("band", "rep", F.coalesce("component", "rep").alias("comp"))
    by_comp = now.groupBy("band", "comp").agg(F.count("*").alias("n"))
    buckets = by_comp.groupBy("band").agg(F.max_by("comp", "n").alias("main"), F.count("*").alias("comps")).where("comps > 1").select("band", "main")
    # sizes that differ by more than one class cannot be similar enough
    klass = F.floor(F.log(F.col("n_shingles")) / F.log(F.lit(100 / spec.percent))).alias("klass")
    open_rows = now.join(buckets, "band").join(classes, "rep")
    return open_rows.select("band", (F.col("comp") == F.col("main")).alias("main"), klass, "rep", "comp", "sig", "n_shingles")


def _blocks(members: DataFrame, *more: str) -> DataFrame:
    """Members of one block in one row; blocks are bounded in count and bytes."""
    return written(members.groupBy("band", "main", "klass", "block").agg(F.collect_list(F.struct("rep", "comp", "sig", "n_shingles", *more)).alias("members")))


def _block_pairs(blocks: DataFrame) -> DataFrame:
    """``band, one, two, same``: the blocks of a bucket that can hold linked members."""
    place = F.struct("main", "klass", "block")
    one = blocks.select("band", place.alias("pa"), F.col("members").alias("one"))
    two = blocks.select("band", place.alias("pb"), F.col("members").alias("two"))
    near = (F.abs(F.col("pa.klass") - F.col("pb.klass")) <= 1) & ~(F.col("pa.main") & F.col("pb.main")) & (F.col("pa") <= F.col("pb"))
    return one.join(two, "band").where(near).select("band", "one", "two", (F.col("pa") == F.col("pb")).alias("same"))


def _active(blocks: DataFrame, spec: NearDup) -> DataFrame:
    """``band, rep`` of members that agree with one of another component by their signatures."""
    percent, least = spec.percent, spec.least_equal

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                found = set()
                for i, partners in _candidates(row["band"], row["one"], row["two"], row["same"], percent, least):
                    found.add(row["one"][i]["rep"])
                    found.update(row["two"][k]["rep"] for k in partners)
                yield pa.RecordBatch.from_arrays([pa.array([row["band"]] * len(found), pa.int64()), pa.array(list(found), pa.int64())], ["band", "rep"])

    return _block_pairs(blocks).mapInArrow(run, "band bigint, rep bigint").distinct()


def _between_components(members: DataFrame, docs: DataFrame, spec: NearDup) -> DataFrame:
    """Links between components of one bucket, found block against block inside the tasks.

    Pairs are never emitted: signatures tell first which members can have a link at all; only
    their whole sets are moved and compared, and of the links a block pair finds only those that
    join components leave it.
    """
    members = written(members)
    signature_bytes = F.lit(2 * spec.permutations * 4)
    brief = _blocks(_dealt(members, signature_bytes))
    active = written(_active(brief, spec))
    release(brief)
    wanted = active.select(F.col("rep").alias("id")).distinct()
    whole = _shingle_sets(docs.join(wanted, "id", "left_semi"), spec)
    dealt = _dealt(members.join(active, ["band", "rep"]).select(*members.columns), F.col("n_shingles") * 8)
    blocks = _blocks(dealt.join(whole, "rep"), "shingles")
    percent, least = spec.percent, spec.least_equal

    def run(batches):
        for batch in batches:
            found = set()
            for row in batch.to_pylist():
                found.update(_compare(row["band"], row["one"], row["two"], row["same"], percent, least))
            found = sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], ["a", "b"])

    links = written(_block_pairs(blocks).mapInArrow(run, "a bigint, b bigint").distinct())
    release(members, active, blocks)
    return links


def _shingle_sets(texts: DataFrame, spec: NearDup) -> DataFrame:
    """``rep, shingles`` of every id, the set as 64-bit values."""
    width = spec.width

    def run(batches):
        for batch in batches:
            for first, data, offsets in kernel.doc_slices(batch, "t"):
                hashes, at = kernel.words(data, offsets)
                found = [kernel.shingle_set(hashes[at[i] : at[i + 1]], width).tobytes() for i in range(len(offsets) - 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(found)), pa.array(found, pa.binary())], ["rep", "shingles"])

    return texts.select("id", "t").mapInArrow(run, "rep bigint, shingles binary")


def _candidates(band: int, one: list[dict], two: list[dict], same: bool, percent: int, least: int):
    """For each member of ``one``: its place and the places in ``two`` it may be linked with."""
    sigs = np.frombuffer(b"".join(m["sig"] for m in two), np.uint32).reshape(len(two), -1)
    sizes = np.array([m["n_shingles"] for m in two])
    comps = np.array([m["comp"] for m in two])
    for i, m in enumerate(one):
        sig, own = np.frombuffer(m["sig"], np.uint32), m["n_shingles"]
        equal = sigs == sig
        good = (equal.sum(axis=1) >= least) & (comps != m["comp"]) & (100 * np.minimum(sizes, own) >= percent * np.maximum(sizes, own))
        if same:
            good[: i + 1] = False
        if good.any():
            here = int(np.flatnonzero(_bands(sig) == band)[0])
            # a pair that meets in several buckets is compared in the first of them
            first = equal.reshape(len(two), BANDS, ROWS).all(axis=2).argmax(axis=1)
            partners = np.flatnonzero(good & (first == here)).tolist()
            if partners:
                yield i, partners


def _compare(band: int, one: list[dict], two: list[dict], same: bool, percent: int, least: int):
    sets = [np.frombuffer(m["shingles"], np.uint64) for m in two]
    root: dict[int, int] = {}

    def find(c):
        while root.get(c, c) != c:
            c = root[c]
        return c

    for i, partners in _candidates(band, one, two, same, percent, least):
        m, own = one[i], np.frombuffer(one[i]["shingles"], np.uint64)
        for k in partners:
            a, b = find(m["comp"]), find(two[k]["comp"])
            if a == b:
                continue
            common = len(np.intersect1d(own, sets[k], assume_unique=True))
            if 100 * common >= percent * (len(own) + len(sets[k]) - common):
                root[max(a, b)] = min(a, b)
                yield min(m["rep"], two[k]["rep"]), max(m["rep"], two[k]["rep"])


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", spec: NearDup = NearDup()) -> DataFrame:
    """One row per row of ``docs``: ``id, n_shingles, component_id, kept``.

    Tables are removed as soon as the next one is written: signatures are held once, by class.
    """
    sketched = written(sketches(docs, id, text, spec))
    filled = sketched.where("n_shingles > 0 and id is not null")
    # an id on several rows links their sets, which takes numbered rows
    if not filled.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        release(sketched)
        return _with_shared_ids(docs, id, text, spec)
    classes = filled.groupBy("set_hash").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    classes = written(classes)
    rows = written(sketched.select("id", "n_shingles", "set_hash"))
    release(sketched)
    member = rows.where("n_shingles > 0 and id is not null").select("id", "set_hash")

    def explode(batches):
        for batch in batches:
            sigs = [np.frombuffer(s, np.uint32) for s in batch.column(1).to_pylist()]
            keys = np.concatenate([_bands(s) for s in sigs]) if sigs else np.zeros(0, np.int64)
            reps = np.repeat(np.asarray(batch.column(0)), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(reps)], ["band", "rep"])

    banded = classes.select("rep", "sig").mapInArrow(explode, "band bigint, rep bigint")
    shared = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    placed = written(banded.join(shared, "band"))
    popular = placed.groupBy("rep").agg(F.sum("n").alias("pop"))
    ranked = written(placed.select("band", "rep").join(popular, "rep"))
    release(placed)
    hubs = ranked.groupBy("band").agg(F.max(F.struct("pop", (-F.col("rep")).alias("r"))).alias("h")).select("band", (-F.col("h.r")).alias("hub"))
    star = ranked.join(hubs, "band").where("rep != hub").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
    star = written(_alike(star, classes, spec))
    wanted = star.select(F.col("a").alias("id")).unionByName(star.select(F.col("b").alias("id"))).distinct()
    wanted = written(wanted)
    slim = docs.select(F.col(f"`{id}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("t"))
    texts = written(slim.join(wanted, "id", "left_semi"))
    links = written(_confirm(star, texts, spec))
    release(star, wanted, texts)
    comps = components(links)
    more = _between_components(_open_members(ranked.select("band", "rep"), comps, classes, spec), slim, spec)
    release(ranked)
    comps = components(links.unionByName(more))
    release(links, more)
    # back from classes to rows
    of_class = member.join(classes.select("set_hash", "rep"), "set_hash").join(comps, F.col("rep") == F.col("node"), "left")
    of_id = of_class.select("id", F.coalesce("component", "rep").alias("component_id"))
    return _result(rows, of_id, id)


def _result(rows: DataFrame, of_id: DataFrame, id: str) -> DataFrame:
    out = rows.select("id", "n_shingles").join(of_id, "id", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def _with_shared_ids(docs: DataFrame, id: str, text: str, spec: NearDup) -> DataFrame:
    """Ids on several rows: rows get numbers, are linked by text, then ids close over rows."""
    numbered = written(docs.select(F.col(f"`{id}`").cast("bigint").alias("own"), F.col(f"`{text}`").alias("t")).withColumn("n", F.monotonically_increasing_id()))
    linked = written(near_duplicates(numbered, "n", "t", spec).join(numbered.select("n", "own"), "n"))
    known = linked.where("own is not null and n_shingles > 0")
    least = known.groupBy("component_id").agg(F.min("own").alias("b"))
    pairs = known.join(least, "component_id").select(F.col("own").alias("a"), "b")
    comps = components(pairs)
    of_id = known.select(F.col("own").alias("id")).distinct().join(comps, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("component_id"))
    return _result(linked.select(F.col("own").alias("id"), "n_shingles"), of_id, id)


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", spec: NearDup = NearDup()) -> DataFrame:
    """Rows of ``docs`` that stay: one document of each component, all columns whole."""
    drop = written(near_duplicates(docs, id, text, spec).where("not kept").select(F.col(id).alias("__drop")).distinct())
    return docs.join(drop, F.col(f"`{id}`").cast("bigint") == F.col("__drop"), "left_anti")
