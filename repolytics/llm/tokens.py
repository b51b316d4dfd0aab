"""Token ids of whole texts by the tokenizers library, each distinct piece encoded once.

A byte-level BPE vocabulary splits texts by a pattern before merging. Texts are cut where a new part of
that pattern begins whatever stands further left or right: at white space, and between letters, digits and
signs that bytes tell apart (``_cuts``). The ids of a text are those of its pieces one after the other.
Pieces repeat, hence each is encoded once and looked up afterwards; the new ones of a block are given to the
library's model together. Nearly all are one part as they are; only the others are split by the pattern itself.
What is held is counted in bytes; beyond ``MOST_BYTES`` only pieces stay that several blocks had.
Vocabularies of another kind are encoded text by text.
"""

from __future__ import annotations

import os
import re
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import kernel

# Bytes that the looked-up pieces of one worker may hold; a block's pieces come on top.
MOST_BYTES = 64 << 20
_ENTRY = 160
BLOCK = 4 << 20
# parts given to the model in one call
_AT_ONCE = 256
# signs that are one part when they follow a word and end a piece (an apostrophe may begin another)
_AFTER_WORD = string.punctuation.replace("'", "")
# for pieces of two tokenizers (``alignment``): single spaces, and where white space of any kind is beside one
_CUT = re.compile(r"(?<=\S) (?=\S)")
_BLANK_SIGN = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_BESIDE = f"{_BLANK_SIGN}\\x20|\\x20{_BLANK_SIGN}"
# kinds of bytes that tell parts of the pattern apart: letters, digits, signs; 0 says nothing
_LETTER, _DIGIT, _SIGN = 1, 2, 3
_KIND = np.zeros(256, np.uint8)
_KIND[[ord(c) for c in string.ascii_letters]] = _LETTER
_KIND[[ord(c) for c in string.digits]] = _DIGIT
_KIND[[ord(c) for c in string.punctuation]] = _SIGN
# first bytes of U+00C0 to U+024F and U+0400 to U+047F: letters but for two signs
_LEAD = np.zeros(256, bool)
_LEAD[[*range(0xC3, 0xCA), 0xD0, 0xD1]] = True
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0D]] = True
# whatever any engine may take for white space: single bytes, first bytes of others, and those as numbers
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
_BLANK_LEAD = np.zeros(256, bool)
_BLANK_LEAD[[0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True
_BLANKS = np.sort([int.from_bytes(chr(c).encode()) for c in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)])
# the parts of the pattern that byte-level vocabularies split by (fixed by the vocabulary)
_PARTS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[int, str]:
    """The visible letter that stands for each byte: itself if printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def _gather(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of ``ids`` from ``starts``, one after the other."""
    ends = np.cumsum(lengths)
    return ids[np.repeat(starts - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]


def _kinds(data: np.ndarray) -> np.ndarray:
    """The kind of each byte of UTF-8 texts."""
    kind = _KIND[data]
    lead = np.flatnonzero(_LEAD[data])
    lead = lead[(data[lead] != 0xC3) | ((data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7))]
    kind[lead] = kind[lead + 1] = _LETTER
    return kind


def _blanks(data: np.ndarray) -> np.ndarray:
    """Which bytes may belong to white space."""
    blank = _BLANK[data]
    lead = np.flatnonzero(_BLANK_LEAD[data])
    if len(lead):
        two = data[lead] == 0xC2
        three = np.where(two, lead, lead + 2)
        number = data[lead].astype(np.int64) << 8 | data[lead + 1]
        number = np.where(two, number, number << 8 | data[three])
        lead = lead[_BLANKS[np.minimum(np.searchsorted(_BLANKS, number), len(_BLANKS) - 1)] == number]
        blank[lead] = blank[lead + 1] = True
        lead = lead[data[lead] != 0xC2]
        blank[lead + 2] = True
    return blank


def _changes(data: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Whether a byte (but the first) begins a part as the one before is of another kind. What an apostrophe begins
    is not known, only that it ends letters and digits."""
    return (kind[1:] != kind[:-1]) & (kind[1:] != 0) & (kind[:-1] != 0) & (data[:-1] != ord("'"))


def _cuts(data: np.ndarray, offsets: np.ndarray, loose: np.ndarray | None = None, spaces: bool = True) -> np.ndarray:
    """Where pieces begin in the bytes of texts; no part of the pattern crosses such a place, and the parts on
    either side are what they are without the other side.

    ``loose`` texts are cut at single spaces only, or not at all without ``spaces``.
    """
    start = np.zeros(len(data) + 1, bool)
    start[offsets] = True
    white, blank = _WHITE[data], _blanks(data)
    cut = start[:-1].copy()
    # where white space begins
    cut[1:] |= white[1:] & ~blank[:-1]
    # its last sign before something else goes with that or stands alone; those before it stay together
    cut[1:-1] |= white[1:-1] & white[:-2] & ~blank[2:] & ~start[2:-1]
    # all but a space stand alone then
    cut[1:] |= cut[:-1] & white[:-1] & (data[:-1] != 0x20) & ~blank[1:]
    cut[1:] |= _changes(data, _kinds(data))
    if loose is not None and loose.any():
        single = data == 0x20
        single[1:] &= ~blank[:-1]
        single[:-1] &= ~blank[1:]
        here = np.repeat(loose, np.diff(offsets))
        cut[here] = start[:-1][here] | (single[here] & spaces)
    return np.flatnonzero(cut)


def _is_word(piece: str) -> bool:
    return piece[1:].isalpha() and (piece[0] == " " or piece[0].isalpha())


class Encoder:
    """``encode`` a text column to ids. One object lives as long as its Python worker."""

    def __init__(self, path: str, most: int = MOST_BYTES):
        import regex
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        # a task has one core: the library is not to start threads of its own
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.whole = Tokenizer.from_file(path)
        kind = str(self.whole.pre_tokenizer)
        self.byte_level = kind.startswith("ByteLevel(") and "use_regex=True" in kind and "add_prefix_space=False" in kind and self.whole.normalizer is None
        self.most = most
        self.parts = regex.compile(_PARTS)
        self.letters = _byte_letters()
        # the same model for many parts at once, a space between them: no letter is a space
        self.many = Tokenizer(self.whole.model)
        self.many.pre_tokenizer = CharDelimiterSplit(" ")
        self.code_points = np.array([ord(self.letters[b]) for b in range(255)] + [ord(" ")], "<u4")
        n_ids = int(self.whole.get_vocab_size(with_added_tokens=True))
        self.bytes_of = np.array([len(self.whole.id_to_token(i) or "") for i in range(n_ids)], np.int64) if self.byte_level else None
        added = [re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(added)) if added else None
        self.has_special = self.special is not None
        # a special string with white space inside is not to be cut there
        self.spaces = not any(c.isspace() for t in self.whole.get_added_tokens_decoder().values() for c in t.content)
        self.bits = max(1, (n_ids - 1).bit_length())
        self._clear()

    def _clear(self) -> None:
        # the looked-up pieces; the ids of each begin at its slot
        self.known = pa.array([], pa.large_string())
        self.slots, self.lengths, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.held = 0
        # how many blocks had each piece
        self.seen = np.zeros(0, np.int32)

    def _trim(self) -> None:
        """Keep the pieces that most blocks had, half the bound at most."""
        known, sizes = self.known, self.lengths
        cost = np.diff(kernel.text_bytes(known)[1]) + 4 * sizes + _ENTRY
        for least in (2, 3, 5, 9, 17):
            keep = np.flatnonzero(self.seen >= least)
            if int(cost[keep].sum()) <= self.most // 2:
                break
        else:
            keep = keep[:0]
        ids, sizes = _gather(self.ids, self.slots[keep], sizes[keep]), sizes[keep]
        self._clear()
        self.known, self.ids, self.lengths, self.slots = known.take(pa.array(keep)), ids, sizes, np.cumsum(sizes) - sizes
        self.held, self.seen = int(cost[keep].sum()), np.ones(len(keep), np.int32)

    def _merge(self, part: str) -> list[int]:
        name = part.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.whole.model.tokenize(name)]

    def _merge_all(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts, one after the other, and how many each has."""
        ids, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        data, offsets = kernel.text_bytes(parts)
        for i in range(0, len(parts), _AT_ONCE):
            want = offsets[i + 1 : i + 1 + _AT_ONCE] - offsets[i]
            # 0xff occurs in no text and stands for the space between parts
            coded = np.insert(data[offsets[i] : offsets[i] + want[-1]], want[:-1], 0xFF)
            names = self.code_points[coded].tobytes().decode("utf-32-le")
            own = np.array(self.many.encode_batch_fast([names], add_special_tokens=False)[0].ids, np.uint32)
            # an id stands for as many bytes as its name has letters, so parts end where their bytes do
            ends = np.cumsum(self.bytes_of[own])
            last = np.searchsorted(ends, want)
            if not len(ends) or ends[-1] != want[-1] or (ends[last] != want).any():
                lists = [self._merge(p) for p in parts.slice(i, _AT_ONCE).to_pylist()]
                own, last = np.array([x for one in lists for x in one], np.uint32), np.cumsum([len(one) for one in lists]) - 1
            ids.append(own)
            lengths.append(np.diff(last, prepend=-1))
        return np.concatenate(ids), np.concatenate(lengths)

    def _split(self, piece: str) -> list[str]:
        """The parts of a piece without special strings."""
        if _is_word(piece):
            return [piece]
        word = piece.rstrip(_AFTER_WORD)
        if len(word) < len(piece) and _is_word(word):
            return [word, piece[len(word) :]]
        return self.parts.findall(piece)

    def _single(self, pieces: pa.Array) -> np.ndarray:
        """Which pieces are one part by their bytes: one kind throughout, perhaps after a space."""
        data, offsets = kernel.text_bytes(pieces)
        kind = _kinds(data)
        other = (kind == 0) | (data == ord("'"))
        other[1:] |= _changes(data, kind)
        first = offsets[:-1]
        other[first] = (kind[first] == 0) & (data[first] != 0x20) | (data[first] == ord("'"))
        found = np.add.reduceat(other, first, dtype=np.int64) == 0
        if self.has_special:
            found &= ~np.asarray(pc.match_substring_regex(pieces, self.special.pattern))
        return found

    def _new(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces not met before, one after the other, and how many each has."""
        single = self._single(pieces)
        if single.all():
            return self._merge_all(pieces)
        number: dict[str, int] = {}
        whole: dict[int, list[int]] = {}
        places, counts = [], np.ones(len(pieces), np.int64)
        mixed = np.flatnonzero(~single)
        for i, piece in zip(mixed.tolist(), pieces.take(pa.array(mixed)).to_pylist()):
            if self.has_special and self.special.search(piece):
                own = [piece]
                whole[number.setdefault(piece, len(number))] = self.whole.encode(piece, add_special_tokens=False).ids
            else:
                own = self._split(piece)
            places += [number.setdefault(part, len(number)) for part in own]
            counts[i] = len(own)
        lost = [part for part, k in number.items() if k not in whole]
        alone = pieces.filter(pa.array(single))
        merged, sizes = self._merge_all(pa.concat_arrays([alone, pa.array(lost, pa.large_string())]))
        ids = np.concatenate([merged, np.array([x for own in whole.values() for x in own], np.uint32)])
        sizes = np.concatenate([sizes, np.array([len(x) for x in whole.values()], np.int64)])
        # the number of each part among all that were encoded: single pieces, parts of others, whole ones
        order = np.zeros(len(number), np.int64)
        order[[k for k in number.values() if k not in whole] + list(whole)] = len(alone) + np.arange(len(number))
        upto = np.concatenate([[0], np.cumsum(counts)])
        parts = np.zeros(int(upto[-1]), np.int64)
        of_mixed = np.repeat(~single, counts)
        parts[~of_mixed], parts[of_mixed] = np.arange(len(alone)), order[np.array(places, np.int64)]
        starts, sizes = (np.cumsum(sizes) - sizes)[parts], sizes[parts]
        return _gather(ids, starts, sizes), np.diff(np.concatenate([[0], np.cumsum(sizes)])[upto])

    def _find(self, pieces: pa.Array) -> np.ndarray:
        """Numbers of distinct pieces; the ids of those not met before are added in one go."""
        found = pc.index_in(pieces, value_set=self.known)
        lost = found.is_null()
        at = np.asarray(found.fill_null(0)).astype(np.int64)
        if lost.true_count:
            new = pieces.filter(lost)
            ids, sizes = self._new(new)
            at[np.asarray(lost)] = len(self.known) + np.arange(len(new))
            self.held += len(kernel.text_bytes(new)[0]) + 4 * len(ids) + _ENTRY * len(new)
            self.known = pa.concat_arrays([self.known, new])
            self.slots = np.concatenate([self.slots, len(self.ids) + np.cumsum(sizes) - sizes])
            self.lengths, self.ids = np.concatenate([self.lengths, sizes]), np.concatenate([self.ids, ids])
            self.seen = np.concatenate([self.seen, np.zeros(len(new), np.int32)])
        self.seen[at] += 1
        return at

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, offsets)`` of a block of texts; null is empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        if not self.byte_level:
            found = [e.ids for e in self.whole.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.array([i for ids in found for i in ids], np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in found])])
        data, offsets = kernel.text_bytes(texts)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        loose = None if self.special is None else np.asarray(pc.match_substring_regex(texts, self.special.pattern))
        self.has_special = loose is not None and bool(loose.any())
        if self.held > self.most:
            self._trim()
        starts = _cuts(data, offsets, loose, self.spaces)
        ends = np.append(starts, len(data))
        pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(data)).dictionary_encode()
        found = self._find(pieces.dictionary)[np.asarray(pieces.indices)]
        sizes = self.lengths[found]
        return _gather(self.ids, self.slots[found], sizes), np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(starts, offsets)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(batch: pa.RecordBatch, column: int, path: str):
    """Yield ``(first row, ids, offsets)`` for blocks of rows of a batch."""
    texts = batch.column(column).cast(pa.large_string()).fill_null("")
    _, offsets = kernel.text_bytes(texts)
    for i, j in kernel.slices(offsets, BLOCK):
        yield i, *encoder(path).encode(texts.slice(i, j - i))
