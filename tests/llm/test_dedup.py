import hashlib
import random
from collections import defaultdict

import pytest
from cases import documents, empty, prose, texts, words
from repolytics.llm import exact_dedup, minhash
from repolytics.llm.components import components


def shingles(text, width):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, width):
    """Component of each id by comparing all pairs."""
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, shingles(t, width)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_equal_brute_force(spark, width):
    rng, rows = random.Random(width), list(enumerate(texts()))
    # a large family whose members differ more among themselves than from the original
    base = prose(rng, 120).split(" ")
    for _ in range(150):
        rows.append((len(rows), " ".join(w if rng.random() > 0.03 else "y" + str(rng.random()) for w in base)))
    got = {r["doc_id"]: r for r in minhash.near_duplicates(documents(spark, rows), spec=minhash.NearDup(width)).collect()}
    want = brute(rows, width)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["n_shingles"] == len(shingles(t, width)) and r["kept"] == (want[i] == i) for i, t in rows for r in [got[i]])


def test_near_duplicates_awkward_rows(spark):
    docs = documents(spark)
    rows = minhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    assert all(r["component_id"] is None and r["kept"] for r in rows if r["doc_id"] is None)
    assert len({r["component_id"] for r in rows if r["doc_id"] == 3}) == 1
    assert minhash.near_duplicates(empty(spark)).count() == 0
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 3


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 80), (70, 70)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {80: 80, 90: 80, 100: 80}


def test_exact_groups_equal_brute_force(spark):
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    low = lambda i: -1 if i is None else i
    got = exact_dedup.mark_duplicates(docs).collect()
    want = sorted((low(i), low(max(groups[t], key=low)), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    assert sorted((low(r["doc_id"]), low(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)
    stay = exact_dedup.drop_duplicates(docs)
    assert stay.columns == docs.columns
    assert sorted((low(r["doc_id"]), r["text"] or "") for r in stay.collect()) == sorted((low(max(v, key=low)), t) for t, v in groups.items())
    assert exact_dedup.mark_duplicates(empty(spark)).count() == 0 == exact_dedup.drop_duplicates(empty(spark)).count()
