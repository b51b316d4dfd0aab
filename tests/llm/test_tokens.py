import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from cases import documents, empty
from repolytics.llm import packing, wavelet
from repolytics.llm.queries import vocabulary
from repolytics.llm.tokens import Encoder


@pytest.fixture(scope="module")
def encoder():
    return Encoder(vocabulary())


def test_pieces_give_the_ids_of_whole_texts(encoder):
    rng = random.Random(3)
    bits = [" ", "  ", "\n", " \n", "\t", "a", "Ab", "é", "ß", "'s", "'ll", "12", "...", "!", " ", "　", "<|endoftext|>", "日本", "​", "\x1c", "\r\n", "😀", "x y"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + [None, "", " ", "  "]
    ids, at = encoder.encode(pa.array(texts))
    want = encoder.whole.encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert all(ids[at[i] : at[i + 1]].tolist() == want[i].ids for i in range(len(texts)))


def ids_of(encoder, text, end):
    return np.array(encoder.whole.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def test_packing_round_trip(spark, encoder):
    docs = documents(spark)
    sequences, whole = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs, vocabulary(), with_ids=True).collect():
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        whole[r["doc_id"]].append((r["start"], bytes(r["ids"])))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    want = defaultdict(int)
    for r in docs.collect():
        want[r["doc_id"]] += len(ids_of(encoder, r["text"], 0))
    assert {k: sum(len(b) // 4 for _, b in v) for k, v in whole.items()} == want
    single = [r for r in docs.collect() if r["doc_id"] in (6, 20, 30)]
    for r in single:
        assert b"".join(b for _, b in sorted(whole[r["doc_id"]])) == ids_of(encoder, r["text"], 0).tobytes()
    assert packing.pack(empty(spark), vocabulary()).count() == 0


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(1)
    histogram = np.bincount(np.minimum(rng.geometric(0.004, 30_000), 1024), minlength=1025)
    plan, filled = packing.make_plan(histogram), defaultdict(int)
    for n in np.flatnonzero(histogram).tolist():
        sequence, offset = plan.place(np.full(histogram[n], n), np.arange(histogram[n]))
        for s in sequence.tolist():
            filled[s] += n
    assert len(filled) == plan.n_sequences and max(filled.values()) <= 1024
    assert plan.n_sequences * 1024 < 1.005 * (np.arange(1025) * histogram).sum()


def test_wavelet_queries_and_file():
    rng = np.random.default_rng(2)
    for n, bits in ((0, 5), (1, 1), (700, 3), (5000, 17)):
        ids = rng.integers(0, 1 << bits, n).astype(np.uint32)
        shard = wavelet.Shard(wavelet.write_shard(ids, bits, ["a"], [n]))
        assert shard.ids().tolist() == ids.tolist() and shard.documents == ["a"]
        for place in rng.integers(0, max(n, 1), 20 if n else 0).tolist():
            token = int(ids[place])
            assert shard.access(place) == token
            assert shard.count(token, place) == int((ids[:place] == token).sum())
            where = np.flatnonzero(ids == token)
            k = int(rng.integers(0, len(where)))
            assert shard.locate(token, k) == int(where[k]) and shard.locate(token, len(where)) == -1
        assert shard.count(1 << bits) == 0


def test_shards_round_trip(spark, encoder):
    docs = documents(spark)
    files = wavelet.write_shards(docs, vocabulary(), most=3000)
    rows = wavelet.read_shards(spark, files).orderBy("start").collect()
    assert files.count() > 3
    low = lambda i: -1 if i is None else i
    want, at = [], 0
    for r in sorted(docs.collect(), key=lambda r: (low(r["doc_id"]), r["text"] is not None, (r["text"] or "").encode())):
        ids = ids_of(encoder, r["text"], 2)
        want.append((r["doc_id"], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [tuple(r) for r in rows] == want
    assert wavelet.read_shards(spark, wavelet.write_shards(empty(spark), vocabulary())).count() == 0


def test_memory_of_looked_up_pieces_is_bounded():
    rng = random.Random(8)
    small = Encoder(vocabulary(), most=20_000)
    # texts without spaces: one piece each, of many parts
    texts = ["".join(rng.choice("ab1.é") for _ in range(40)) for _ in range(400)]
    for i in range(0, 400, 20):
        ids, at = small.encode(pa.array(texts[i : i + 20]))
        want = small.whole.encode_batch(texts[i : i + 20], add_special_tokens=False)
        assert all(ids[at[k] : at[k + 1]].tolist() == want[k].ids for k in range(20))
        assert len(small.known) + len(small.slots) < 800 and small.held < 120_000


def test_new_parts_are_merged_together(monkeypatch):
    """The parts of a block go to the model in a few calls, not one by one; the ids are those of the texts."""
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("abcdeéß日") for _ in range(rng.randint(1, 9))) + rng.choice(["", ".", ",!", "'s", "12", ".\nNo"]) for _ in range(200)) for _ in range(60)]
    for sizes in (True, False):
        some = Encoder(vocabulary(), most=100_000)
        want = some.whole.encode_batch(texts, add_special_tokens=False)
        with monkeypatch.context() as m:
            if sizes:
                m.setattr(some, "_merge", lambda part: pytest.fail(f"{part} alone"))
            else:  # ids whose bytes are not known: then one by one
                some.bytes_of = np.full_like(some.bytes_of, 7)
            for i in range(0, 60, 15):
                ids, at = some.encode(pa.array(texts[i : i + 15]))
                assert all(ids[at[k] : at[k + 1]].tolist() == want[i + k].ids for k in range(15))


def test_a_plain_folder_belongs_to_the_default_store(spark, tmp_path):
    assert wavelet._qualified(spark, str(tmp_path)).startswith("file:")
    files = wavelet.write_shards(documents(spark), vocabulary(), folder=f"{tmp_path}/shards")
    assert files.first()["folder"].startswith("file:/") and wavelet.read_shards(spark, files).count() == documents(spark).count()


def test_pieces_are_cut_where_bytes_tell_parts_apart(encoder, monkeypatch):
    """Words, numbers and signs are pieces of their own, found by bytes: the pattern itself is not run on them."""
    some = Encoder(vocabulary())
    monkeypatch.setattr(some, "_split", lambda piece: pytest.fail(f"{piece!r} split by the pattern"))
    texts = ["Né à Orléans, en 1802.", "(Voir p.12;x=3) ", "Слово, и 5%.", None]
    ids, at = some.encode(pa.array(texts))
    want = encoder.whole.encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert [ids[at[k] : at[k + 1]].tolist() for k in range(4)] == [w.ids for w in want]


def test_white_space_of_all_kinds_and_special_strings(encoder, tmp_path):
    rng = random.Random(11)
    blanks = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x1f", "\x85", "\xa0", " ", "᠎", " ", "​", " ", "　", "﻿"]
    others = ["a", "É", "×", "÷", "ж", "҂", "'", "'s", "s", "1", "½", "²", "...", "(", "’", "日本", "。", "́", "\x00", "😀"]
    more = encoder.whole.from_file(vocabulary())
    more.add_special_tokens(["<end of text>", "<b>"])
    more.save(f"{tmp_path}/more.json")
    for some, special in ((Encoder(vocabulary()), ["<|endoftext|>", "<|end"]), (Encoder(f"{tmp_path}/more.json"), ["<end of text>", "<b>", "<end"])):
        bits = rng.sample(blanks, 9) + rng.sample(others, 12)
        texts = ["".join(rng.choice(bits + special * (i % 7 == 0)) for _ in range(rng.randint(0, 20))) for i in range(3000)]
        ids, at = some.encode(pa.array(texts))
        want = some.whole.encode_batch(texts, add_special_tokens=False)
        assert all(ids[at[i] : at[i + 1]].tolist() == want[i].ids for i in range(len(texts)))
