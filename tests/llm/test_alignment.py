import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from cases import documents, empty, texts

from repolytics.llm import alignment
from repolytics.llm.alignment import EDGE, NOTHING, Fragment
from repolytics.llm.queries import vocabulary
from repolytics.llm.tokens import _byte_letters

PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def own():
    return alignment.Aligner(vocabulary(), PIECES)


def whole_text(own, text):
    """Tokens of the whole text as ``(id, start, end)``, or none."""
    if not text:
        return [], []
    raw = (" " + text).encode()
    a = own.a.encode(" " + text, add_special_tokens=False)
    back = {c: b for b, c in _byte_letters().items()}
    sides = [(a.ids, [bytes(back[c] for c in t) for t in a.tokens])]
    b = own.b.encode(text)
    sides.append((b, [bytes([int(p[3:5], 16)]) if own.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, map(own.b.id_to_piece, b))]))
    out = []
    for ids, parts in sides:
        if b"".join(parts) != raw:
            return [], []
        ends = list(itertools.accumulate(map(len, parts)))
        out.append([(i, e - len(p), e) for i, p, e in zip(ids, parts, ends)])
    return tuple(out)


def brute(own, rows):
    sides = [whole_text(own, t) for _, t in rows]
    pairs = [[(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]] if len(a) < 4000 else overlapping(a, b) for a, b in sides]
    counts = Counter(p for found in pairs for p in found)
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for (id, _), (a, b), found in zip(rows, sides, pairs):
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, low = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(t) for t, s, e in side if low < e <= end) for side in (a, b)) if len(a) < 4000 else None)
            low = end
        text = ";".join(groups) if None not in groups else in_groups(a, b, ends)
        out.append((id, len(a), len(b), len(ends), len(found), sum(counts[p] == best[p[1]] for p in found), sum(counts[p] for p in found), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return out


def overlapping(a, b):
    """The same for long texts: every byte names its tokens."""
    of_b = [k for k, (_, s, e) in enumerate(b) for _ in range(s, e)]
    return [(t, b[k][0]) for t, s, e in a for k in range(of_b[s], of_b[e - 1] + 1)]


def in_groups(a, b, ends):
    group = {end: k for k, end in enumerate(ends)}

    def split(side):
        out, now = [[] for _ in ends], 0
        for t, _, e in side:
            out[now].append(str(t))
            now += e in group
        return out

    return ";".join(",".join(x) + "|" + ",".join(y) for x, y in zip(split(a), split(b)))


def awkward(seed, n):
    rng = random.Random(seed)
    bits = [" ", "  ", "\n", "\t", "a", "the", "Abc", "é", "ß", "'s", "12", "...", "!", " ", "　", "<|endoftext|>", "<s>", "<0x41>", "日本", "​", "\x1c", "\r\n", "😀", " word", " other", "ing ", "x y", "\x00"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(n)] + ["a▁b", "▁", "plain ▁ text", " a", "a ", " "]


def test_units_give_the_tokens_of_whole_texts(own):
    import pyarrow as pa

    for text in awkward(3, 3000):
        _, units, _ = own.units(pa.array([text], pa.large_string()))
        found = own.stream(units.to_pylist())
        want = whole_text(own, text)
        assert found.sound.all() == bool(want[0]), repr(text)
        if want[0]:
            sides = [list(zip(ids.tolist(), ends.tolist())) for ids, ends in ((found.a, found.a_ends), (found.b, found.b_ends))]
            assert sides == [[(t, e) for t, _, e in side] for side in want], repr(text)


def test_units_of_a_block_equal_single_units(own):
    units = sorted({u for t in awkward(4, 400) for u in t.split(" ") if u})
    table = own.align(units)
    for k, unit in enumerate(units):
        s = own.stream([unit])
        fragment = EDGE + Fragment.of(list(zip(s.a.tolist(), s.a_ends.tolist())), list(zip(s.b.tolist(), s.b_ends.tolist())))
        numbers, pairs = alignment._numbers(fragment.groups)
        assert table.sound[k] == s.sound[0] and table.counts[k].tolist() == numbers, unit
        assert table.pairs[table.pair_at[k] : table.pair_at[k + 1]].tolist() == pairs
        assert table.texts[k] == ";".join(map(alignment.group_text, fragment.groups))


def test_fragments_compose_associatively():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(1, 25)
        a = [(rng.randint(0, 9), e) for e in sorted(rng.sample(range(1, n + 1), rng.randint(0, n)))]
        b = [(rng.randint(0, 9), e) for e in sorted(rng.sample(range(1, n + 1), rng.randint(0, n)))]
        cuts = sorted({0, n, *(rng.randint(0, n) for _ in range(rng.randint(0, 5)))})
        parts = [Fragment.of([t for t in a if i < t[1] <= j], [t for t in b if i < t[1] <= j]) for i, j in zip(cuts, cuts[1:])]
        whole = Fragment.of(a, b)
        while len(parts) > 1:
            k = rng.randrange(len(parts) - 1)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        assert parts[0] == whole == NOTHING + whole == whole + NOTHING
        assert EDGE + (EDGE + whole) == EDGE + whole


@pytest.mark.parametrize("chunk,stretch", [(1 << 16, 1 << 12), (40, 30), (7, 6), (300, 2)])
def test_equals_brute_force(spark, own, chunk, stretch):
    given = [None, "", *awkward(chunk, 120), "nospace" * 60, "日本語" * 50, "ok text " * 30 + "▁" + " more text" * 30]
    if chunk > 1000:
        given += texts()
    rows = list(enumerate(given)) + [(5, "the same id"), (None, "no id"), (None, "no id")]
    found = alignment.align(documents(spark, rows), vocabulary(), PIECES, chunk=chunk, stretch=stretch).collect()
    order = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in found), key=order) == sorted(brute(own, rows), key=order)


def test_groups_links_and_empty_table(spark, own):
    rows = [(1, "a small text"), (2, "another small text " * 20)]
    found = {r["doc_id"]: r["groups"] for r in alignment.align(documents(spark, rows), vocabulary(), PIECES, chunk=50, groups=True).collect()}
    for id, text in rows:
        a, b = whole_text(own, text)
        sides = list(zip(*(g.split("|") for g in found[id].split(";"))))
        for side, want in zip(sides, (a, b)):
            assert [int(t) for x in side for t in x.split(",")] == [t for t, *_ in want]
    pairs = Counter(p for _, t in rows for p in overlapping(*whole_text(own, t)))
    counted = alignment.link_counts(documents(spark, rows), vocabulary(), PIECES, chunk=50).collect()
    assert {(r["a"], r["b"]): r["n"] for r in counted} == pairs
    assert alignment.align(empty(spark), vocabulary(), PIECES).count() == 0


def test_few_block_rows_lie_together(spark):
    """A reader holds all rows of a row group at once, so a file of many large rows has many groups."""
    docs = documents(spark, [(i, f"text {i} " * 40) for i in range(30)])
    blocks, composed = alignment._blocks(docs, vocabulary(), PIECES, "doc_id", "text", 50, 30, False)
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for df in (blocks, composed) for f in df.inputFiles()]
    assert max(m.num_rows for m in files) > alignment.ROWS
    assert max(m.row_group(k).num_rows for m in files for k in range(m.num_row_groups)) <= alignment.ROWS
    # numbers of units and links are bytes, not lists of wide numbers
    assert {dict(blocks.dtypes)[c] for c in ("codes", "pair_n", "pair_of")} == {"binary"}


def test_counts_come_back_as_rows(spark):
    """No list of all pairs of a block is gathered, neither by an aggregate nor for a join."""
    docs = documents(spark, [(i, f"text {i}") for i in range(5)])
    plans = []

    def kept(df, name="llm", **options):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return written(df, name, **options)

    written, alignment.written = alignment.written, kept
    try:
        found = alignment.align(docs, vocabulary(), PIECES).collect()
    finally:
        alignment.written = written
    assert len(found) == 5 and all("collect_list" not in plan for _, plan in plans)


@pytest.mark.parametrize("most", [0, 255, 256, 65535, 65536, (1 << 32) - 1])
def test_numbers_as_bytes(most):
    numbers = np.array([0, most, most // 2], np.int64)
    assert alignment._unpacked(alignment._packed(numbers)).tolist() == numbers.tolist()
    assert alignment._unpacked(alignment._packed(numbers[:0])).tolist() == []
