"""Which tokens of two tokenizers cover the same bytes, by an associative monoid of fragments.

Both tokenizers cut the bytes of *space + text*. Where a token of A and one of B end at the same
byte, a *group* closes. A *fragment* is what a byte range knows by itself: the open tokens before its
first common end, the closed groups after it, and the open tokens behind its last one. Two
neighbours compose: open tail and open head become a group, or stay open where no common end was
met. Composition is associative, so ranges may be worked on anywhere and joined as a tree.

Ordinary texts are one range. A long text is cut at every ``chunk`` bytes, wherever that falls; each
piece is a row of its own, tokenised in a task of its own (with the rest of the word at both
ends, for exact tokens), and the fragments are composed ``FAN`` at a time in rounds of grouping.
A cut inside a stretch that neither tokenizer can be cut in, longer than ``stretch`` bytes, is left out.

Tokens come from *units*: a single space between two characters that are not white space starts a
part of A's pattern, and no piece of B holds a space behind another character, so both end tokens there.
Units repeat; each is tokenised and aligned once per block of texts, all of a block together.
With a vocabulary B that has such pieces, whole texts are the units.

A block sends each id pair once with its count; pairs are added up by Spark and come back to
the block that asked, as rows beside it. A pair that occurs everywhere is thus one row for each block.
Block rows are large: their numbers are kept as bytes, and few of them lie together in a file (``ROWS``), as
all that lie together are read at once.

Defined results: null and empty texts, and those that either tokenizer does not give back byte for
byte (U+2581, for one), have no tokens: zeros and an empty string. Repeated rows are rows of their own, each counting
towards the links; rows without id keep a null id. Ties for the highest count are all best. An empty table gives an
empty result. Columns of any name may be present.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel, tokens
from .shared import written

CHUNK = 1 << 16
STRETCH = 1 << 12
BLOCK = 4 << 20
SLICE = 4096
FAN = 16
# rows of blocks, of pieces or of whole texts that a reader of a written table holds at once
ROWS = 8
_FEW = {"parquet.block.row.count.limit": str(ROWS)}
_TEXT = pa.large_string()


@dataclass(frozen=True)
class Fragment:
    """``head`` and ``tail`` are ``(a, b)`` tuples of ``(id, end)``; ``groups`` closed ones of that
    form. Without a common end (``cut``) all tokens are in ``head``."""

    head: tuple = ((), ())
    groups: tuple = ()
    tail: tuple = ((), ())
    cut: bool = False

    @staticmethod
    def of(a: list, b: list) -> Fragment:
        """The fragment of tokens ``(id, end)``, in order."""
        common = sorted({end for _, end in a} & {end for _, end in b})
        if not common:
            return Fragment((tuple(a), tuple(b)))
        parts, i, j = [], 0, 0
        for end in common:
            m, n = i, j
            while i < len(a) and a[i][1] <= end:
                i += 1
            while j < len(b) and b[j][1] <= end:
                j += 1
            parts.append((tuple(a[m:i]), tuple(b[n:j])))
        return Fragment(parts[0], tuple(parts[1:]), (tuple(a[i:]), tuple(b[j:])), True)

    def __add__(self, other: Fragment) -> Fragment:
        if not self.cut:
            return Fragment(_join(self.head, other.head), other.groups, other.tail, other.cut)
        open_ = _join(self.tail, other.head)
        if not other.cut:
            return Fragment(self.head, self.groups, open_, True)
        closed = (open_,) if open_[0] or open_[1] else ()
        return Fragment(self.head, self.groups + closed + other.groups, other.tail, True)


def _join(x: tuple, y: tuple) -> tuple:
    return x[0] + y[0], x[1] + y[1]


NOTHING = Fragment()
EDGE = Fragment(cut=True)
"""A common end by itself: the start of a text or of a unit."""


def links(group: tuple) -> list[tuple[int, int]]:
    """Pairs of ids whose tokens share a byte; both sides of a group begin at the same byte."""
    a, b = group
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        out.append((a[i][0], b[j][0]))
        x, y = a[i][1], b[j][1]
        i, j = i + (x <= y), j + (y <= x)
    return out


def group_text(group: tuple) -> str:
    return ",".join(str(t) for t, _ in group[0]) + "|" + ",".join(str(t) for t, _ in group[1])


@dataclass
class Stream:
    """Tokens of units laid one after the other: ids, byte ends, and how many lie before each unit."""

    sound: np.ndarray
    ends: np.ndarray
    a: np.ndarray
    a_ends: np.ndarray
    a_at: np.ndarray
    b: np.ndarray
    b_ends: np.ndarray
    b_at: np.ndarray


@dataclass
class Units:
    """What each unit adds: ``n_a, n_b, n_groups, n_links``, its groups as text, its pairs."""

    sound: np.ndarray
    counts: np.ndarray
    texts: list[str]
    pair_at: np.ndarray
    pairs: np.ndarray


class Aligner:
    """Both tokenizers. One object lives as long as its Python worker."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        if not tokens.Encoder(path_a).byte_level:
            raise ValueError("the first tokenizer must be byte-level")
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        byte_of = {letter: byte for byte, letter in tokens._byte_letters().items()}
        self.a_bytes = [bytes(byte_of.get(c, 32) for c in n) for n in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        # an id with what follows it: inside its side of a group, and at the end of the side
        marks = ((len(names), ","), (len(names), "|"), (len(pieces), ","), (len(pieces), ";"))
        self.parts = np.array([f"{i}{mark}" for n, mark in marks for i in range(n)], object)
        self.part_size = np.array([len(x) for x in self.parts], np.int64)

    def units(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Units without their leading space, where each text's begin and end, and the order of
        the texts in which they come."""
        if not self.cuts:
            return np.arange(len(texts)), texts, np.arange(len(texts) + 1)
        edge = pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " "))
        careful = pc.or_(pc.match_substring_regex(texts, tokens._BESIDE), edge)
        plain = pc.split_pattern(texts.filter(pc.invert(careful)), " ")
        rest = pa.array([tokens._CUT.split(t) for t in texts.filter(careful).to_pylist()], pa.large_list(_TEXT))
        lists = [x.cast(pa.large_list(_TEXT)) for x in (plain, rest)]
        sizes = np.concatenate([np.diff(np.asarray(x.offsets)) for x in lists])
        flat = pa.concat_arrays([x.flatten() for x in lists])
        return np.argsort(np.asarray(careful), kind="stable"), flat, np.concatenate([[0], np.cumsum(sizes)])

    def _tokens(self, units: list[str]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Of a few units: which are sound, bytes and numbers of tokens of each, ids of both sides."""
        raw = [(" " + u).encode() for u in units]
        a = [e.ids for e in self.a.encode_batch_fast([" " + u for u in units], add_special_tokens=False)]
        b = self.b.encode(units, num_threads=1)
        parts = [[names[i] for ids in side for i in ids] for side, names in ((a, self.a_bytes), (b, self.b_bytes))]
        sound = np.ones(len(units), bool)
        ends = np.cumsum([len(r) for r in raw])
        whole = b"".join(raw)
        for k, side in enumerate((a, b)):
            at = np.cumsum([len(x) for x in side])
            loose = np.cumsum([0, *map(len, parts[k])])[at] != ends
            if loose.any() or b"".join(parts[k]) != whole:
                names = (self.a_bytes, self.b_bytes)[k]
                sound &= np.array([b"".join([names[i] for i in x]) == r for x, r in zip(side, raw)], bool)
        if not sound.all():
            a, b, raw = ([v if good else v[:0] for v, good in zip(side, sound)] for side in (a, b, raw))
        sizes = [np.array([len(x) for x in side], np.int64) for side in (raw, a, b)]
        return sound, sizes, [np.array([i for ids in side for i in ids], np.int64) for side in (a, b)]

    def stream(self, units: list[str]) -> Stream:
        """Tokens of the units that both tokenizers give back byte for byte; the others have none."""
        # a few units at a time: the library's encodings are far larger than their ids
        found = [self._tokens(units[i : i + SLICE]) for i in range(0, len(units), SLICE)] or [self._tokens([])]
        sound = np.concatenate([f[0] for f in found])
        size, n_a, n_b = (np.concatenate([f[1][k] for f in found]) for k in range(3))
        a, b = (np.concatenate([f[2][k] for f in found]) for k in range(2))
        at_a, at_b = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))
        return Stream(sound, np.cumsum(size), a, np.cumsum(self.a_size[a]), at_a, b, np.cumsum(self.b_size[b]), at_b)

    def align(self, units: list[str]) -> Units:
        """All units at once: between two neighbouring ends of either side lies one link."""
        s = self.stream(units)
        common = np.intersect1d(s.a_ends, s.b_ends, assume_unique=True)
        ends = np.union1d(s.a_ends, s.b_ends)
        pairs = s.a[np.searchsorted(s.a_ends, ends)] << 32 | s.b[np.searchsorted(s.b_ends, ends)] if len(ends) else np.zeros(0, np.int64)
        pair_at = np.concatenate([[0], np.searchsorted(ends, s.ends, "right")])
        group_at = np.concatenate([[0], np.searchsorted(common, s.ends, "right")])
        counts = np.stack([np.diff(x) for x in (s.a_at, s.b_at, group_at, pair_at)], axis=1)
        if not len(ends):
            return Units(s.sound, counts, [""] * len(units), pair_at, pairs)
        of_a, of_b = np.searchsorted(common, s.a_ends), np.searchsorted(common, s.b_ends)
        n_a, n_b = len(self.a_size), len(self.b_size)
        codes = np.concatenate([s.a + n_a * (common[of_a] == s.a_ends), 2 * n_a + s.b + n_b * (common[of_b] == s.b_ends)])
        codes = codes[np.argsort(np.concatenate([of_a * 2, of_b * 2 + 1]), kind="stable")]
        text = "".join(self.parts[codes].tolist())
        cut = np.concatenate([[0], np.cumsum(self.part_size[codes])])[s.a_at + s.b_at].tolist()
        # the mark behind the last id of a unit is left out
        return Units(s.sound, counts, [text[i : max(i, j - 1)] for i, j in zip(cut, cut[1:])], pair_at, pairs)


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


_BLOCK_ARRAYS = {"key": "string", "n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "groups": "string"}


def _block_schema(kind: str) -> str:
    arrays = ", ".join(f"{n} array<{t}>" for n, t in _BLOCK_ARRAYS.items())
    return f"block bigint, ids array<{kind}>, {arrays}, unit_at array<bigint>, codes binary, pair_n binary, pair_of binary, pairs array<bigint>, weights array<bigint>"


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32 as bytes, one, two or four for each, behind a byte that says how many."""
    most = int(numbers.max()) if len(numbers) else 0
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4
    return bytes([width]) + numbers.astype(f"<u{width}").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1)


def _block(ids: pa.Array, key: list, numbers: np.ndarray, groups: list, at: np.ndarray, codes: np.ndarray, pair_at: np.ndarray, unit_pairs: np.ndarray) -> dict:
    """A block row: texts as runs of units (``unit_at``, ``codes``), units as lists of pairs (``pair_n`` numbers of
    ``pair_of`` each), pairs with their counts.

    ``numbers`` has a row ``n_a, n_b, n_groups, n_links`` for each text."""
    pairs, pair_of = np.unique(unit_pairs, return_inverse=True)
    sizes = np.diff(pair_at)
    times = np.repeat(np.bincount(codes, minlength=len(sizes)), sizes)
    weights = np.zeros(len(pairs), np.int64)
    np.add.at(weights, pair_of, times)
    return {
        "block": uuid.uuid4().int >> 65,
        "ids": ids,
        "key": key,
        **{n: numbers[:, k] for k, n in enumerate(["n_a", "n_b", "n_groups", "n_links"])},
        "groups": groups,
        "unit_at": at,
        "codes": _packed(codes),
        "pair_n": _packed(sizes),
        "pair_of": _packed(pair_of),
        "pairs": pairs,
        "weights": weights,
    }


def _texts_block(own: Aligner, ids: pa.Array, texts: pa.Array, whole: bool) -> dict:
    """The block of short texts; unsound ones have no units."""
    order, units, at = own.units(texts)
    coded = units.dictionary_encode()
    table = own.align(coded.dictionary.to_pylist())
    codes = np.asarray(coded.indices).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), np.diff(at))
    bad = np.asarray(pc.binary_length(texts.take(pa.array(order)))) == 0
    bad[row[~table.sound[codes]]] = True
    codes, sizes = codes[~bad[row]], np.where(bad, 0, np.diff(at))
    at = np.concatenate([[0], np.cumsum(sizes)])
    # one number after the other: a block has many times as many units as texts
    numbers = np.stack([np.diff(np.concatenate([[0], np.cumsum(table.counts[codes, k])])[at]) for k in range(4)], axis=1)
    groups = []
    for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
        text = ";".join([table.texts[c] for c in codes[i:j].tolist()])
        groups.append(text if whole else hashlib.sha256(text.encode()).hexdigest() if i < j else "")
    return _block(ids.take(pa.array(order)), [None] * len(texts), numbers, groups, at, codes, table.pair_at, table.pairs)


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    """Rows of scalars, numpy arrays and lists; a name that is missing is null."""
    columns = []
    for field in schema:
        values = [r.get(field.name) for r in rows]
        if pa.types.is_list(field.type):
            parts = [None if v is None else v if isinstance(v, pa.Array) else pa.array(v, field.type.value_type) for v in values]
            flat = pa.concat_arrays([p.cast(field.type.value_type) for p in parts if p is not None] or [pa.array([], field.type.value_type)])
            offsets = np.concatenate([[0], np.cumsum([0 if p is None else len(p) for p in parts])])
            mask = pa.array([p is None for p in parts])
            columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat, mask=mask))
        else:
            columns.append(pa.array(values, field.type))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _rows(batch: pa.RecordBatch):
    """The rows of a batch one after the other: those of long texts are large in Python."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def _arrow(df_schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(df_schema)
    plain = [pa.field(f.name, pa.list_(f.type.value_type) if pa.types.is_list(f.type) else f.type) for f in schema]
    return pa.schema(plain)


def _pieces(own: Aligner, text: str, chunk: int, stretch: int) -> list[dict]:
    """Byte ranges of a long text: ``part, low, high`` and ``at, text``, the units they touch.

    Offsets count from the added space; ``text`` leaves the space of its first unit out.
    """
    _, units, _ = own.units(pa.array([text], _TEXT))
    sizes = np.asarray(pc.binary_length(units)).astype(np.int64) + 1
    ends = np.cumsum(sizes)
    cuts = np.arange(chunk, ends[-1], chunk)
    holder = np.searchsorted(ends, cuts)
    cuts = np.concatenate([[0], cuts[sizes[holder] <= stretch], [ends[-1]]])
    listed, out = units.to_pylist(), []
    for part, (low, high) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
        i, j = int(np.searchsorted(ends, low, "right")), int(np.searchsorted(ends, high))
        out.append({"part": part, "low": low, "high": high, "at": int(ends[i] - sizes[i]), "piece": " ".join(listed[i : j + 1])})
    return out


def _flat(open_: tuple) -> list[int]:
    """Open tokens as numbers: how many of A, then id and end of each."""
    return [len(open_[0]), *(x for side in open_ for token in side for x in token)]


def _open(flat: list[int]) -> tuple:
    pairs = list(zip(flat[1::2], flat[2::2]))
    return tuple(pairs[: flat[0]]), tuple(pairs[flat[0] :])


def _numbers(groups: tuple) -> tuple[list[int], list[int]]:
    """``n_a, n_b, n_groups, n_links`` of groups and their pairs."""
    pairs = [x << 32 | y for g in groups for x, y in links(g)]
    return [sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(pairs)], pairs


def _range(own: Aligner, piece: dict) -> tuple[bool, Fragment]:
    """The fragment of one byte range: the tokens that end in it."""
    _, units, _ = own.units(pa.array([piece["piece"]], _TEXT))
    s = own.stream(units.to_pylist())
    if not s.sound.all():
        return False, NOTHING
    sides = []
    for ids, ends in ((s.a, s.a_ends + piece["at"]), (s.b, s.b_ends + piece["at"])):
        inside = (ends > piece["low"]) & (ends <= piece["high"])
        sides.append(list(zip(ids[inside].tolist(), ends[inside].tolist())))
    return True, (EDGE if piece["low"] == 0 else NOTHING) + Fragment.of(*sides)


def _compose(rows: list[dict]) -> dict:
    """One row for neighbouring fragments, in order. ``made`` gathers the pairs of the groups that closed."""
    if not all(r["sound"] for r in rows):
        return {"sound": False}
    whole, closed, made, made_n = NOTHING, [], [], np.zeros(4, np.int64)
    for r in rows:
        whole = whole + Fragment(_open(r["head"]), (), _open(r["tail"]), r["cut"])
        numbers, pairs = _numbers(whole.groups)
        closed += [*map(group_text, whole.groups), *([r["closed"]] if r["closed"] else [])]
        made += [*pairs, *r["made"]]
        made_n += np.array(numbers) + np.array(r["made_n"])
        whole = Fragment(whole.head, (), whole.tail, whole.cut)
    return {"sound": True, "cut": whole.cut, "head": _flat(whole.head), "tail": _flat(whole.tail), "closed": ";".join(closed), "made": made, "made_n": made_n}


_FRAGMENT = "sound boolean, cut boolean, head array<bigint>, tail array<bigint>, closed string, made array<bigint>, made_n array<bigint>"


def _reduce(fragments: DataFrame, kind: str) -> DataFrame:
    """One fragment for each long text: ``FAN`` neighbours at a time."""
    most = fragments.agg(F.max("part")).first()[0]
    now, schema = fragments, f"key string, id {kind}, part int, {_FRAGMENT}"
    arrow = _arrow(now.sparkSession.createDataFrame([], schema).schema)

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        one = {"key": rows[0]["key"], "id": rows[0]["id"], "part": rows[0]["part"] // FAN, **_compose(rows)}
        return pa.Table.from_batches([_batch([one], arrow)])

    while most:
        now = now.groupBy("key", F.floor(F.col("part") / FAN).alias("p")).applyInArrow(run, schema)
        most //= FAN
    return now


def _blocks(docs: DataFrame, path_a: str, path_b: str, id: str, text: str, chunk: int, stretch: int, whole: bool) -> tuple[DataFrame, DataFrame]:
    """Block rows of all texts, and the composed fragments of the long ones."""
    spark = docs.sparkSession
    kind = docs.schema[id].dataType.simpleString()
    schema = f"{_block_schema(kind)}, text_key string, id {kind}, part int, low bigint, high bigint, at bigint, piece string"
    arrow = _arrow(spark.createDataFrame([], schema).schema)

    def first(batches):
        for batch in batches:
            texts = batch.column(1).cast(_TEXT).fill_null("")
            _, offsets = kernel.text_bytes(texts)
            long = np.diff(offsets) > chunk
            short = np.flatnonzero(~long)
            ids, few = batch.column(0).take(pa.array(short)), texts.take(pa.array(short))
            _, at = kernel.text_bytes(few)
            for i, j in kernel.slices(at, BLOCK):
                yield _batch([_texts_block(aligner(path_a, path_b), ids.slice(i, j - i), few.slice(i, j - i), whole)], arrow)
            for k in np.flatnonzero(long).tolist():
                one = {"text_key": uuid.uuid4().hex, "id": batch.column(0)[k].as_py()}
                for piece in _pieces(aligner(path_a, path_b), texts[k].as_py(), chunk, stretch):
                    yield _batch([one | piece], arrow)

    stored = written(docs.select(F.col(f"`{id}`"), F.col(f"`{text}`").cast("string")).mapInArrow(first, schema), "alignment", **_FEW)
    columns = [f.name for f in spark.createDataFrame([], _block_schema(kind)).schema]
    pieces = stored.where("text_key is not null").select("text_key", "id", "part", "low", "high", "at", "piece")
    names = ["text_key", "id", "part", "low", "high", "at", "piece"]
    schema2 = f"{_block_schema(kind)}, id {kind}, text_key string, part int, {_FRAGMENT}"
    arrow2 = _arrow(spark.createDataFrame([], schema2).schema)

    def ranges(batches):
        for batch in batches:
            for piece in _rows(batch):
                sound, f = _range(aligner(path_a, path_b), piece)
                numbers, pairs = _numbers(f.groups)
                row = {"id": piece["id"], "text_key": piece["text_key"], "part": piece["part"], "sound": sound, "cut": f.cut, "head": _flat(f.head), "tail": _flat(f.tail)}
                row |= {"closed": ";".join(map(group_text, f.groups)), "made": [], "made_n": [0, 0, 0, 0]}
                own = _block(pa.array([piece["id"]], arrow2.field("ids").type.value_type), [piece["text_key"]], np.array([numbers]), [""], np.array([0, 1]), np.zeros(1, np.int64), np.array([0, len(pairs)]), np.array(pairs, np.int64))
                yield _batch([own | row], arrow2)

    # a task for each piece's neighbours in hash order: the pieces of one text go to many tasks
    opened = written(pieces.repartition("text_key", "part").select(*names).mapInArrow(ranges, schema2), "alignment-pieces", **_FEW)
    one = opened.select(F.col("text_key").alias("key"), "id", "part", *[c.split(" ")[0] for c in _FRAGMENT.split(", ")])
    composed = written(_reduce(one, kind), "alignment-texts", **_FEW)

    def closing(batches):
        for batch in batches:
            for r in _rows(batch):
                groups = r["closed"] if whole else hashlib.sha256(r["closed"].encode()).hexdigest()
                yield _batch([_block(pa.array([r["id"]], arrow2.field("ids").type.value_type), [r["key"]], np.array([r["made_n"]]), [groups], np.array([0, 1]), np.zeros(1, np.int64), np.array([0, len(r["made"])]), np.array(r["made"], np.int64))], arrow3)

    arrow3 = _arrow(spark.createDataFrame([], _block_schema(kind)).schema)
    good = composed.where("sound")
    last = written(good.select("key", "id", "closed", "made", "made_n").mapInArrow(closing, _block_schema(kind)), "alignment-closing", **_FEW)
    # a text that one piece finds unsound has no tokens in any
    kept = opened.join(good.select(F.col("key").alias("text_key")), "text_key", "left_semi").select(*columns)
    return stored.where("block is not null").select(*columns).unionByName(kept).unionByName(last), composed


def _counts(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of blocks (``block, at, pair, weight``) and of the corpus (``pair, n, best``)."""
    each = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "weights")).alias("at", "p")).select("block", "at", F.col("p.pairs").alias("pair"), F.col("p.weights").alias("weight"))
    counts = each.groupBy("pair").agg(F.sum("weight").alias("n"))
    counts = written(counts.withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF)), "alignment-counts")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return each, written(counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "alignment-pairs")


def link_counts(docs: DataFrame, path_a: str, path_b: str, id: str = "doc_id", text: str = "text", chunk: int = CHUNK, stretch: int = STRETCH) -> DataFrame:
    """``a, b, n, best``: how often tokens of two ids share a byte, and whether that is most for ``b``."""
    blocks, _ = _blocks(docs, path_a, path_b, id, text, chunk, stretch, False)
    _, counts = _counts(blocks)
    return counts.select(F.shiftrightunsigned("pair", 32).alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b"), "n", "best")


def align(docs: DataFrame, path_a: str, path_b: str, id: str = "doc_id", text: str = "text", chunk: int = CHUNK, stretch: int = STRETCH, groups: bool = False) -> DataFrame:
    """``id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row.

    ``path_a`` is a byte-level file of the tokenizers library, ``path_b`` a sentencepiece model.
    With ``groups`` the last column is ``groups``, the aligned ids themselves (``a1,a2|b1;a3|b2``).
    """
    kind = docs.schema[id].dataType.simpleString()
    blocks, composed = _blocks(docs, path_a, path_b, id, text, chunk, stretch, groups)
    each, counts = _counts(blocks)
    found = each.drop("weight").join(counts, "pair").select(F.col("block").alias("of"), "at", "n", "best")
    columns = ["block", "ids", *_BLOCK_ARRAYS, "unit_at", "codes", "pair_n", "pair_of", "n_pairs"]
    schema = f"id {kind}, key string, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string"
    arrow = _arrow(docs.sparkSession.createDataFrame([], schema).schema)

    def run(block: pa.Table, found: pa.Table) -> pa.Table:
        row = {c: block.column(c)[0] for c in block.column_names}
        at = np.asarray(found.column("at"))
        codes, sizes, pair_of = (_unpacked(row[c].as_py()) for c in ("codes", "pair_n", "pair_of"))
        pair_at = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        unit_at = np.asarray(row["unit_at"].values, np.int64)
        out = []
        for name in ("best", "n"):
            value = np.zeros(row["n_pairs"].as_py(), np.int64)
            value[at] = np.asarray(found.column(name).cast(pa.int64()))
            unit = np.concatenate([[0], np.cumsum(value[pair_of])])
            unit = unit[pair_at[1:]] - unit[pair_at[:-1]]
            total = np.concatenate([[0], np.cumsum(unit[codes])])
            out.append(pa.array(total[unit_at[1:]] - total[unit_at[:-1]], pa.int64()))
        ints = [row[c].values for c in ("n_a", "n_b", "n_groups", "n_links")]
        return pa.Table.from_arrays([row["ids"].values, row["key"].values, *ints, *out, row["groups"].values], schema=arrow)

    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    # a block and its pairs meet in a task one block at a time
    asked = blocks.withColumn("n_pairs", F.size("pairs")).select(*columns).groupBy("block")
    rows = written(asked.cogroup(found.groupBy("of")).applyInArrow(run, schema), "alignment-rows")
    long = rows.where("key is not null").groupBy("key").agg(F.first("id").alias("id"), *[F.sum(c).alias(c) for c in numbers], F.max("groups").alias("groups"))
    none = composed.where("not sound").select("id", *[F.lit(0).cast("bigint").alias(c) for c in numbers], F.lit("").alias("groups"))
    every = rows.where("key is null").drop("key").unionByName(long.drop("key")).unionByName(none)
    return every.withColumnsRenamed({"id": id, "groups": "groups" if groups else "groups_sha256"})
