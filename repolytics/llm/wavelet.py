"""Token ids as one wavelet matrix per shard.

A shard holds the ids of a run of documents in ascending id order. Bit plane after bit plane,
from the highest bit, the sequence is stably split into zeros and ones; with counts of ones
before each block of 512 bits, rank and select on the planes give the token at a place, the
number of times a token occurs before a place, and the place of its k-th occurrence. A file
holds a head (JSON), the documents' ids and lengths, and every plane with its counts, each
part compressed by itself, so a query opens only the parts it needs.

Order comes from a range-partitioned sort by id; a task writes its rows as shards of bounded
size. Files get a name of their own for every attempt and the table of files is written by
Spark, so an attempt that is lost or repeated leaves at most an unlisted file. They are read
back by Spark's ``binaryFile`` source.

Defined results: a null text is empty (one end id); rows without id come first; rows that share an id follow
one another in the order of their texts; an empty table gives no file and an empty result; columns of any
name may be present.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import scratch_path
from .shared import written
from .tokens import encoded, encoder

MAGIC = b"WVMX1\n"
SHARD_TOKENS = 4_000_000
# Rows that share an id are put in ranges by this much of their texts, and by all of it inside.
RANGE_CHARS = 48
_RANK = 512
# bits of a plane worked on at a time, so that their places stay near the processor
_STRETCH = 1 << 16


def split_planes(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    """The bit planes, highest first; each is stably sorted by the planes before it."""
    now, planes = ids.astype(np.uint16 if bits <= 16 else np.uint32), []
    for b in range(bits - 1, -1, -1):
        ones = (now & now.dtype.type(1 << b)).astype(bool)
        planes.append(ones)
        split = np.empty_like(now)
        zero, one = 0, len(now) - int(np.count_nonzero(ones))
        for i in range(0, len(now), _STRETCH):
            here, own = ones[i : i + _STRETCH], now[i : i + _STRETCH]
            low, high = np.flatnonzero(~here), np.flatnonzero(here)
            own.take(low, out=split[zero : zero + len(low)], mode="clip")
            own.take(high, out=split[one : one + len(high)], mode="clip")
            zero, one = zero + len(low), one + len(high)
        now = split
    return planes


def join_planes(planes: list[np.ndarray]) -> np.ndarray:
    """All ids at once: the splits undone from the last plane to the first."""
    n, bits = len(planes[0]) if planes else 0, len(planes)
    now = np.zeros(n, np.uint16 if bits <= 16 else np.uint32)
    for b, ones in enumerate(reversed(planes)):
        before = np.empty_like(now)
        zero, one = 0, n - int(np.count_nonzero(ones))
        for i in range(0, n, _STRETCH):
            here, own = ones[i : i + _STRETCH], before[i : i + _STRETCH]
            low, high = np.flatnonzero(~here), np.flatnonzero(here)
            own[low] = now[zero : zero + len(low)]
            own[high] = now[one : one + len(high)] | now.dtype.type(1 << b)
            zero, one = zero + len(low), one + len(high)
        now = before
    return now


def write_shard(ids: np.ndarray, bits: int, docs: list, lengths: list[int]) -> bytes:
    """The bytes of one file."""
    pack = zstandard.ZstdCompressor(level=1).compress
    parts = [pack(json.dumps(docs).encode()), pack(np.array(lengths, "<i8").tobytes())]
    zeros = []
    for ones in split_planes(ids, bits):
        packed = np.packbits(ones, bitorder="little")
        padded = np.zeros(-(-len(packed) // (_RANK // 8)) * (_RANK // 8), np.uint8)
        padded[: len(packed)] = packed
        counts = np.bitwise_count(padded).reshape(-1, _RANK // 8).sum(axis=1, dtype=np.int64)
        zeros.append(len(ones) - int(counts.sum()))
        parts += [pack(np.concatenate([[0], np.cumsum(counts)]).astype("<u4").tobytes()), pack(packed.tobytes())]
    head = json.dumps({"tokens": len(ids), "bits": bits, "zeros": zeros, "parts": [len(p) for p in parts]}).encode()
    return MAGIC + struct.pack("<I", len(head)) + head + b"".join(parts)


class Shard:
    """Queries on one file's bytes."""

    def __init__(self, data: bytes):
        if not data.startswith(MAGIC):
            raise ValueError("not a wavelet shard")
        size = struct.unpack_from("<I", data, len(MAGIC))[0]
        at = len(MAGIC) + 4
        head = json.loads(data[at : at + size])
        self.tokens, self.bits, self.zeros = head["tokens"], head["bits"], head["zeros"]
        ends = np.concatenate([[0], np.cumsum(head["parts"])]) + at + size
        self._data, self._ends, self._open = data, ends, {}

    def _part(self, k: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self._data[self._ends[k] : self._ends[k + 1]])

    @property
    def documents(self) -> list:
        return json.loads(self._part(0))

    @property
    def lengths(self) -> np.ndarray:
        return np.frombuffer(self._part(1), "<i8")

    def _plane(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self._open:
            self._open[k] = (np.frombuffer(self._part(2 + 2 * k), "<u4"), np.frombuffer(self._part(3 + 2 * k), np.uint8))
        return self._open[k]

    def _ones(self, k: int, place: int) -> int:
        """Ones before ``place`` in plane ``k``."""
        counts, packed = self._plane(k)
        block = place // _RANK
        rest = packed[block * (_RANK // 8) : -(-place // 8)]
        ones = int(counts[block]) + int(np.bitwise_count(rest).sum())
        return ones - (int(rest[-1] >> (place % 8)).bit_count() if place % 8 and len(rest) else 0)

    def _select(self, k: int, bit: int, nth: int) -> int:
        """Place of the ``nth`` (from 0) ``bit`` of plane ``k``."""
        counts, packed = self._plane(k)
        before = counts if bit else np.arange(len(counts)) * _RANK - counts.astype(np.int64)
        block = int(np.searchsorted(before, nth, "right")) - 1
        here = np.unpackbits(packed[block * (_RANK // 8) : (block + 1) * (_RANK // 8)], bitorder="little") == bit
        return block * _RANK + int(np.flatnonzero(here)[nth - int(before[block])])

    def access(self, place: int) -> int:
        """The token at ``place``."""
        if not 0 <= place < self.tokens:
            raise IndexError(place)
        token = 0
        for k in range(self.bits):
            packed = self._plane(k)[1]
            bit, ones = packed[place // 8] >> (place % 8) & 1, self._ones(k, place)
            place = self.zeros[k] + ones if bit else place - ones
            token = token << 1 | int(bit)
        return token

    def _range(self, token: int, end: int) -> tuple[int, int]:
        first = 0
        for k in range(self.bits):
            a, b = self._ones(k, first), self._ones(k, end)
            first, end = (self.zeros[k] + a, self.zeros[k] + b) if token >> (self.bits - 1 - k) & 1 else (first - a, end - b)
        return first, end

    def count(self, token: int, end: int | None = None) -> int:
        """Occurrences of ``token`` before place ``end``."""
        if token < 0 or token >> self.bits:
            return 0
        first, last = self._range(token, self.tokens if end is None else end)
        return last - first

    def locate(self, token: int, nth: int) -> int:
        """Place of the ``nth`` occurrence (from 0) of ``token``, or -1."""
        if nth < 0 or nth >= self.count(token):
            return -1
        place = self._range(token, self.tokens)[0] + nth
        for k in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - k) & 1
            place = self._select(k, bit, place - self.zeros[k] if bit else place)
        return place

    def ids(self) -> np.ndarray:
        """All tokens in order."""
        n = self.tokens
        return join_planes([np.unpackbits(self._plane(k)[1], bitorder="little", count=n).view(bool) for k in range(self.bits)])


def _qualified(spark: SparkSession, folder: str) -> str:
    """The folder as a URI: a plain path belongs to the cluster's default store, not to a task's disk."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _open_store(folder: str):
    """File system and path of a folder named by URI."""
    from pyarrow import fs

    # Hadoop writes file:/path, pyarrow wants file:///path
    return fs.FileSystem.from_uri(folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder)


def write_shards(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", end: int = 2, folder: str | None = None, most: int = SHARD_TOKENS) -> DataFrame:
    """Write all documents; the table of files: ``file, part, shard, tokens``, in order of (part, shard)."""
    folder = _qualified(docs.sparkSession, folder or scratch_path(docs.sparkSession, "wavelet"))
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("t"))
    # range bounds are sampled on the driver: they hold the beginnings of texts, not texts
    ordered = rows.repartitionByRange(F.col("id").asc_nulls_first(), F.substring("t", 1, RANGE_CHARS)).sortWithinPartitions(F.col("id").asc_nulls_first(), "t")

    def run(batches):
        store, root = _open_store(folder)
        store.create_dir(root, recursive=True)
        part, shard, bits = TaskContext.get().partitionId(), 0, encoder(path).bits
        held: list[np.ndarray] = []
        names: list = []
        lengths: list[int] = []
        total = 0

        def flush():
            name = f"{part:07d}-{shard:05d}-{uuid.uuid4().hex}.wvm"
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(write_shard(np.concatenate(held), bits, names, lengths))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([total], pa.int64())], ["file", "part", "shard", "tokens"])

        for batch in batches:
            for first, ids, at in encoded(batch, 1, path):
                own = batch.column(0).slice(first, len(at) - 1).to_pylist()
                for i, name in enumerate(own):
                    held += [ids[at[i] : at[i + 1]], np.array([end], np.uint32)]
                    names.append(name)
                    lengths.append(int(at[i + 1] - at[i]) + 1)
                    total += lengths[-1]
                    if total >= most:
                        yield flush()
                        shard, held, names, lengths, total = shard + 1, [], [], [], 0
        if names:
            yield flush()

    return written(ordered.mapInArrow(run, "file string, part int, shard int, tokens bigint").withColumn("folder", F.lit(folder)))


def read_shards(spark: SparkSession, files: DataFrame, id_type: str = "bigint") -> DataFrame:
    """``id, start, n_tokens, ids_crc32`` of every document, from the files named in ``files``."""
    first = files.select("folder").first()
    if first is None:
        return spark.createDataFrame([], f"id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint")
    # tokens before a part, over one row for each part; then those before a shard in its part
    parts = files.groupBy("part").agg(F.sum("tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.withColumn("within", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(parts, "part").select("file", (F.col("base") + F.col("within")).alias("base"))
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}

    def run(batches):
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard = Shard(data.as_py())
                lengths = shard.lengths
                at = np.concatenate([[0], np.cumsum(lengths)])
                ids = shard.ids().astype("<u4")
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(crc)), pa.array(shard.documents, kinds[id_type]), pa.array(at[:-1]), pa.array(lengths), pa.array(crc, pa.int64())], ["file", "id", "place", "n_tokens", "ids_crc32"])

    stored = spark.read.format("binaryFile").option("pathGlobFilter", "*.wvm").load(first["folder"])
    stored = stored.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    rows = stored.mapInArrow(run, f"file string, id {id_type}, place bigint, n_tokens bigint, ids_crc32 bigint")
    # files of attempts that were not kept are not listed and drop out here
    return rows.join(starts, "file").select("id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")
