import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from cases import documents, empty, prose, words
from repolytics.llm import kernel, lm, quality, toxicity


def test_words_follow_the_pattern():
    texts = ["", "  a B c\x0bd ", "é\x1cf", None, "x" * 5000 + " y"]
    hashes, at = kernel.words(*kernel.text_bytes(pa.array(texts)))
    names = [w for t in texts for w in words(t)]
    assert np.diff(at).tolist() == [len(words(t)) for t in texts]
    again = dict(zip(names, hashes.tolist()))
    assert len(set(again.values())) == len(again) and kernel.words(*kernel.text_bytes(pa.array(["A  a"])))[0].tolist() == [again["a"]] * 2


def test_blocks_do_not_change_words(monkeypatch):
    text = pa.array([prose(random.Random(1), 500), None, "z" * 3000, prose(random.Random(2), 300)])
    whole = kernel.words(*kernel.text_bytes(text))
    monkeypatch.setattr(kernel, "BLOCK", 97)
    small = kernel.words(*kernel.text_bytes(text))
    assert all((a == b).all() for a, b in zip(whole, small))


def test_lm_equals_brute_force(spark):
    docs = documents(spark)
    rows = docs.select("doc_id", "text").collect()
    got = lm.lm_scores(docs, chunk_bytes=20_000, part_keys=2_000).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = [words(r["text"]) + [None] for r in rows]
    count = Counter(w for r, t in zip(rows, tokens) if not held(r["doc_id"]) for w in t)
    n, v = sum(count.values()), len(count)
    key = lambda i: -1 if i is None else i
    want = sorted((key(r["doc_id"]), held(r["doc_id"]), len(t), sum(count[w] > 0 for w in t), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), 4)) for r, t in zip(rows, tokens))
    assert sorted((key(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] <= 0 for r in got)
    assert lm.lm_scores(empty(spark)).count() == 0


def test_lm_is_a_distribution_and_beats_the_base(spark):
    rng = random.Random(5)
    sentence = "a b c d e f g h".split()
    rows = [(i, " ".join(rng.choice([sentence, sentence[::-1]]) * 3)) for i in range(200)]
    got = lm.lm_scores(documents(spark, rows)).where("held_out").collect()
    assert sum(r["score"] for r in got) > 0.6 * sum(r["base_score"] for r in got)
    weights = lm.fit_weights(np.array([0, lm._LEVELS * lm._LEVELS + 5]), np.array([3.0, 4.0]), 10)
    assert np.allclose(weights.sum(axis=1), 1) and (weights >= 0).all()


def test_machine_identity():
    m = quality.Machine.empty()
    m.factors[:5] = np.random.default_rng(1).normal(0, 1, (5, quality.FACTORS))
    number, value = np.array([0, 2, 4]), np.array([1.0, 0.5, 2.0])
    pairs = sum(float(m.factors[number[i]] @ m.factors[number[j]]) * value[i] * value[j] for i in range(3) for j in range(i))
    assert np.isclose(m.scores(number, value, np.array([0, 3]))[0], 1 / (1 + math.exp(-pairs)))


def labelled(spark, n=600):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        good, toxic = rng.random() > 0.2, rng.random() < 0.2
        lines = [prose(rng, 12) for _ in range(rng.randint(2, 12))]
        if toxic:
            lines[rng.randrange(len(lines))] += " " + rng.choice(["vile", "rotten"]) + "!"
        text = ". ".join(lines)
        rows.append((i, text if good else text.upper().replace(" ", " $$ ")))
        labels.append((i, int(good), int(toxic)))
    return documents(spark, rows), spark.createDataFrame(labels + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int"), labels


def test_classifiers_on_held_out_rows(spark):
    docs, labels, rows = labelled(spark)
    truth = {i: (q, t) for i, q, t in rows}
    for k, got in enumerate((quality.quality_scores(docs, labels), toxicity.toxicity_scores(docs, labels))):
        held = [r for r in got.collect() if r["held_out"]]
        assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held)
        assert np.mean([r["predicted"] == truth[r["doc_id"]][k] for r in held]) > 0.95
    worst = toxicity.toxicity_scores(docs, labels).where("n_offending > 0").join(docs.select("doc_id", "text"), "doc_id").collect()
    hits = [any(w in r["text"].encode()[r["worst_start"] : r["worst_end"]].decode().lower() for w in ("vile", "rotten")) for r in worst]
    assert worst and np.mean(hits) > 0.95


def test_classifiers_awkward_rows(spark):
    docs = documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for score in (quality.quality_scores, toxicity.toxicity_scores):
        rows = score(docs, none).collect()
        assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in rows)
        assert score(empty(spark), none).count() == 0
    assert quality.keep_good(docs, none).columns == docs.columns
    extra = docs.withColumn("score", docs.n_chars).withColumn("given", docs.n_chars)
    assert quality.keep_good(extra, none).count() == docs.count()


def test_counts_beyond_32_bits_add_up():
    big = 2**32 - 10
    keys = np.array([3, 8], np.uint64)
    rows = [(c, 0, 0, keys.tobytes(), lm._packed(np.array([big, c + 1]))) for c in (0, 1)] + [(0, 0, 1, keys.tobytes(), lm._packed(np.array([2**40, 1])))]
    chunk, part, kind, k, n = zip(*rows)
    table = pa.table({"chunk": pa.array(chunk, pa.int64()), "part": pa.array(part, pa.int64()), "kind": pa.array(kind, pa.int32()), "keys": pa.array(k, pa.binary()), "counts": pa.array(n, pa.binary())})
    out = lm._sum_part(table).to_pylist()
    assert [lm._unpacked(r["totals"], 2).tolist() for r in out] == [[2 * big, 3], [2 * big, 3], [2**40, 1]]
    assert out[0]["tokens"] == 2 * big + 3 and out[0]["distinct"] == 2 and len(lm._packed(np.array([2**32 - 1]))) == 4
