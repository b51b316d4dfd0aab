import hashlib
import random
import re

import numpy as np
import pytest
from cases import documents, empty, texts

from repolytics.llm import kernel, repeats

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, length):
    """Rows in order: first start of every window, then the words under later ones."""
    seen, out = set(), []
    for id, text in rows:
        words = SPLIT.findall(text or "")
        gone = [False] * len(words)
        for s in range(len(words) - length + 1):
            window = tuple(words[s : s + length])
            if window in seen:
                gone[s : s + length] = [True] * length
            seen.add(window)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((id, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def mosaic(seed, n):
    """Documents made of shared passages, their variants, repeated lines and words of their own."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 40))] for _ in range(12)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 6)):
            part = list(rng.choice(passages))
            if rng.random() < 0.4:
                part[rng.randrange(len(part))] = rng.choice(vocabulary)
            words += part * rng.choice([1, 1, 1, 3])
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(words)))
    return rows


@pytest.mark.parametrize("length,seed", [(20, 5), (6, 3), (8, 1), (4, 4)])
def test_equals_brute_force(spark, length, seed):
    rows = mosaic(length, 120) + [(200, None), (201, ""), (202, "  "), (203, "one two"), (204, "Same same SAME " * 40)]
    rows += [(300 + i, t) for i, t in enumerate(texts())]
    docs = documents(spark, rows)
    found = repeats.without_repeats(docs, length=length, seed=seed, texts=True).collect()
    want = brute(ordered(rows), length)
    assert sorted(tuple(r) for r in found) == sorted(want)


def test_repeated_rows_and_missing_ids(spark):
    text = " ".join(f"a{i}" for i in range(30))
    rows = [(7, text), (7, text), (None, text), (None, None), (3, text + " b"), (7, None)]
    found = repeats.without_repeats(documents(spark, rows)).collect()
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], []).append((r["n_words"], r["n_removed"]))
    assert {k: sorted(v) for k, v in by.items()} == {None: [(0, 0), (30, 0)], 3: [(31, 30)], 7: [(0, 0), (30, 30), (30, 30)]}
    assert repeats.without_repeats(empty(spark)).count() == 0


def test_spans_are_maximal_and_true(spark):
    rows = mosaic(5, 80)
    words = {i: SPLIT.findall(t) for i, t in rows}
    covered = {i: set() for i in words}
    spans = repeats.maximal_repeats(documents(spark, rows), length=6, seed=3).collect()
    for r in spans:
        covered[r["doc_id"]] |= set(range(r["first"], r["first"] + r["n_words"]))
        assert r["n_words"] >= 6 and (r["source"] <= r["doc_id"])
        if r["source_first"] is not None:
            a, b = words[r["doc_id"]], words[r["source"]]
            assert a[r["first"] : r["first"] + r["n_words"]] == b[r["source_first"] : r["source_first"] + r["n_words"]]
    assert {i: len(c) for i, c in covered.items()} == {r[0]: r[2] for r in brute(rows, 6)}


def test_equal_windows_pick_equal_seeds():
    rng = np.random.default_rng(1)
    words = kernel.mix(rng.integers(0, 3, 400).astype(np.uint64))
    at = np.array([0, 0, 5, 130, 400])
    grams, picks, rows, starts, counts = repeats.seeds(words, at, 10, 3)
    seen, n = {}, 0
    for pick, row, start, count in zip(picks, rows, starts, counts):
        for s in range(start, start + count):
            assert at[row] <= s and s + 10 <= at[row + 1] and s <= pick <= s + 7
            assert seen.setdefault(tuple(words[s : s + 10]), pick - s) == pick - s
            n += 1
    assert n == sum(max(b - a - 9, 0) for a, b in zip(at[:-1], at[1:]))
