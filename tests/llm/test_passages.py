import random
import re

import numpy as np
import pyarrow as pa
import regex
from cases import documents, empty, prose
from repolytics.llm import decontam, kernel, licenses, queries, quotes


def hashes(text):
    return kernel.words(*kernel.text_bytes(pa.array([text])), kernel.PLAIN)[0]


def brute_tiles(text, test, least):
    """Greedy tiling with all maximal matches looked for again after every tile."""
    a, b, tiles = [False] * len(text), [False] * len(test), []
    while True:
        best = (0, 0, 0)
        for p in range(len(test)):
            for t in range(len(text)):
                n = 0
                while p + n < len(test) and t + n < len(text) and text[t + n] == test[p + n] and not a[t + n] and not b[p + n]:
                    n += 1
                best = max(best, (n, -p, -t))
        if best[0] < least:
            return tiles
        n, p, t = best[0], -best[1], -best[2]
        a[t : t + n], b[p : p + n] = [True] * n, [True] * n
        tiles.append(n)


def test_tiles_equal_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        test = [rng.randint(0, 6) for _ in range(rng.randint(5, 30))]
        text = []
        for _ in range(4):
            k = rng.randrange(len(test))
            text += test[k : k + rng.randint(1, 15)] + [rng.randint(0, 6)]
        x, y = kernel.mix(np.array(text, np.uint64)), kernel.mix(np.array(test, np.uint64))
        tiles = decontam.tile(x, y, 5)
        used = [(t + i, p + i) for t, p, n in tiles for i in range(n)]
        assert len({t for t, _ in used}) == len({p for _, p in used}) == len(used)
        assert all(x[t] == y[p] for t, p in used) and all(n >= 5 for _, _, n in tiles)
        assert sum(n for _, _, n in tiles) >= 0.8 * sum(brute_tiles(text, test, 5))


def test_decontamination(spark):
    rng = random.Random(2)
    item = prose(rng, 40).split(" ")
    other = prose(rng, 300)
    reordered = " ".join(item[20:] + ["zz"] + item[:20])
    rows = [(1, other + " " + " ".join(item).upper() + ", " + other), (2, other + " " + reordered), (3, other), (4, " ".join(item[:12])), (5, None), (6, ""), (None, " ".join(item)), (7, (" ".join(item) + " ") * 3000)]
    bench = spark.createDataFrame([(0, " ".join(item)), (1, "too short"), (2, None), (3, "")], "item_id long, text string")
    docs = documents(spark, rows)
    got = decontam.contaminated(docs, bench).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["item_id"]) for r in got) == [(-1, 0), (1, 0), (2, 0), (7, 0)]
    assert {r["doc_id"]: len(r["tiles"]) for r in got}[2] == 2
    clean = decontam.keep_clean(docs, bench)
    assert sorted(r["doc_id"] for r in clean.collect()) == [3, 4, 5, 6] and clean.columns == docs.columns
    assert decontam.contaminated(empty(spark), bench).count() == 0
    assert decontam.contaminated(docs, bench.where("item_id > 5")).count() == 0
    assert decontam.contaminated(documents(spark), bench).count() == 0


def test_decontamination_in_blocks(spark, monkeypatch):
    rng = random.Random(3)
    items = [(i, prose(rng, 30)) for i in range(20)]
    docs = documents(spark, [(i, prose(rng, 50) + " " + t) for i, t in items])
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 400)
    got = decontam.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(i, i) for i in range(20)]


def test_license_passages_equal_brute_force(spark):
    rng = random.Random(6)
    line = "Licensed under the Apache License, Version 2.0."
    rows = [(1, prose(rng, 50) + "\n" + line.upper() + " " + prose(rng, 9)), (2, line + line), (3, prose(rng, 80)), (4, None), (5, ""), (6, "licensed under an apache license version 2.0"), (7, "Released under MIT")]
    got = {(r["doc_id"], r["license"]): r["dice"] for r in licenses.scan(documents(spark, rows)).collect()}

    def best(text, template):
        x, y = kernel.combine(hashes(text or ""), 2).tolist(), kernel.combine(hashes(template), 2).tolist()
        top = 0.0
        for i in range(len(x)):
            for j in range(i + 1, min(len(x), i + 2 * len(y)) + 1):
                shared = sum(min(x[i:j].count(g), y.count(g)) for g in set(y))
                top = max(top, 2 * shared / (j - i + len(y)))
        return top

    want = {(i, n): b for i, t in rows for n, s in licenses.TEMPLATES.items() if len(s) < 90 and (b := best(t, s)) >= licenses.LEAST}
    assert want and {k: round(v, 9) for k, v in got.items() if k in want or len(licenses.TEMPLATES[k[1]]) < 90} == {k: round(v, 9) for k, v in want.items()}
    assert licenses.scan(documents(spark, rows)).where("doc_id = 2 and license = 'Apache-2.0 line'").count() == 2
    assert licenses.scan(empty(spark)).count() == 0 and licenses.scan(documents(spark)).count() == 0


def test_quotes_link_and_nest(spark):
    rows = [
        ("a", 0, "Hello there\nsecond line"),
        ("a", 1, "> hello   THERE\n> second line!\n\nI answer."),
        ("a", 2, "> I answer.\n>> Hello there\n>> second line\nDeeper"),
        ("a", 3, "> Hello there\n> second line\nOther branch"),
        ("a", 4, "> never said\nLost"),
        ("a", 5, None),
        ("b", 0, "> Hello there\n> second line\nother thread"),
        (None, 0, "x"),
        (None, 1, ">x\ny"),
    ]
    got = quotes.conversations(spark.createDataFrame(rows, "c string, n long, t string"), "c", "n", "t").collect()
    by = {(r["thread"], r["position"]): (r["body"], r["reply_to"], r["depth"], r["root"], r["reply_order"]) for r in got}
    assert len(got) == len(rows)
    assert by["a", 1] == ("I answer.", 0, 1, 0, 1)
    assert by["a", 2] == ("Deeper", 1, 2, 0, 2)
    assert by["a", 3] == ("Other branch", 0, 1, 0, 3)
    assert by["a", 4] == ("Lost", None, 0, 4, 4) and by["a", 5] == ("", None, 0, 5, 5)
    assert by["b", 0][1] is None and by[None, 1] == ("y", 0, 1, 0, 1)


def test_quotes_repeated_rows_chains_and_empty(spark):
    chain = [("t", 0, "m 0")] + [("t", i, f"> m {i - 1}\nm {i}") for i in range(1, 60)]
    frame = spark.createDataFrame(chain + [chain[5], chain[0]], "c string, n long, t string")
    got = quotes.conversations(frame, "c", "n", "t").collect()
    assert len(got) == 62 and max(r["depth"] for r in got) == 59
    assert sorted(r["reply_order"] for r in got) == list(range(62))
    assert quotes.conversations(frame.where("n > 100"), "c", "n", "t").count() == 0


def test_items_shorter_than_a_seed(spark):
    docs = documents(spark, [(1, "so: the Quick brown, fox! runs. the quick brown fox"), (2, "the quick brown"), (3, "fox the quick"), (4, "brown fox"), (5, None), (6, "fox")])
    items = spark.createDataFrame([(1, "The quick brown fox"), (2, "fox"), (3, ""), (4, None), (5, "quick brown"), (5, "quick brown")], "item_id bigint, text string")
    found = decontam.contaminated(docs, items).collect()
    got = sorted((r["doc_id"], r["item_id"], r["covered"], r["coverage"], r["tiles"][0]["text_word"]) for r in found)
    assert got == [(1, 1, 4, 1.0, 1), (1, 2, 1, 1.0, 4), (1, 5, 2, 1.0, 2), (1, 5, 2, 1.0, 2), (2, 5, 2, 1.0, 1), (2, 5, 2, 1.0, 1), (3, 2, 1, 1.0, 0), (4, 2, 1, 1.0, 1), (6, 2, 1, 1.0, 0)]
    assert sorted(r["doc_id"] for r in decontam.keep_clean(docs, items.where("item_id = 1")).collect()) == [2, 3, 4, 5, 6]


def norm(text):
    return " ".join(regex.findall(r"[\p{L}\p{N}]+", text.lower()))


def quoted_by_hand(rows):
    """The rules of the module, message by message; rows are in order of their positions."""
    threads, out = {}, []
    for thread, position, text in rows:
        lines = []
        for raw in re.split(r"\r?\n", text or ""):
            marks = re.match(r"^(\s*>)*", raw).group(0)
            lines.append((marks.count(">"), re.sub(r"^(\s*>)+ ?", "", raw)))
        passages, run = set(), []
        for depth, body in [*lines, (None, "")]:
            if run and (depth != run[0][0] or not norm(body)):
                passages.add((run[0][0], " ".join(norm(b) for _, b in run)))
                run = []
            if depth is not None and norm(body):
                passages.add((depth, norm(body)))
                run.append((depth, body))
        seen = threads.setdefault(thread, [])
        votes = {}
        for depth, key in passages:
            holders = [p for p, own in seen if key in own]
            if depth and holders:
                votes[depth, holders[-1]] = votes.get((depth, holders[-1]), 0) + len(key.split(" "))
        parent = max(votes, key=lambda v: (-v[0], votes[v], v[1]))[1] if votes else None
        seen.append((position, {k for d, k in passages if not d}))
        out.append([thread, position, "\n".join(b for d, b in lines if not d).strip(), parent])
    return out


def depth_first(linked):
    children, result = {}, {}
    for thread, position, _, parent in linked:
        children.setdefault((thread, parent), []).append(position)
    for thread in {r[0] for r in linked}:
        n, stack = 0, [(p, 0, p) for p in reversed(children.get((thread, None), []))]
        while stack:
            p, depth, root = stack.pop()
            result[thread, p] = (depth, root, n)
            n += 1
            stack += [(c, depth + 1, root) for c in reversed(children.get((thread, p), []))]
    return sorted(((t, p, body, parent, *result[t, p]) for t, p, body, parent in linked), key=str)


def test_quotes_equal_brute_force(spark):
    rng = random.Random(6)
    said = [f"Sentence {i}, with words {i * 7}." for i in range(12)] + ["", "Thanks!"]
    rows = []
    for thread in ("a", "b", None):
        texts = []
        for position in range(40):
            parts = ["\n".join(rng.choice(said) for _ in range(rng.randint(0, 3)))]
            for _ in range(rng.randint(0, 3)):
                if texts:
                    quote = rng.choice(texts[-6:]).split("\n")
                    quote = quote[rng.randint(0, 1) :] if rng.random() < 0.5 else [" ".join(quote)]
                    parts.insert(rng.randint(0, len(parts)), "\n".join(rng.choice(["> ", ">", " >> "]) + q for q in quote))
            texts.append("\n".join(parts))
            rows.append((thread, position, texts[-1]))
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "thread string, position long, t string, body string, m long").repartition(5)
    got = quotes.conversations(frame, "thread", "position", "t")
    found = sorted((tuple(r) for r in got.select("thread", "position", "body", "reply_to", "depth", "root", "reply_order").collect()), key=str)
    assert found == depth_first(quoted_by_hand(rows))


def test_planted_quotes_are_found(spark):
    """Every style of quoting leads to the turn that was answered, and the body is the turn."""
    turns = [(c, n, "\n".join(f"Line {k} of turn {n} in talk {c}, long enough to be broken somewhere." for k in range((c + n) % 4 + 1))) for c in range(30) for n in range(8)]
    table = spark.createDataFrame([*turns, (99, 0, None), (99, 1, "")], "conv_id long, turn long, text string")
    planted = queries.quoted_messages(table)
    want = {(r["conv_id"], r["turn"]): r["answered"] for r in planted.collect()}
    got = quotes.conversations(planted, "conv_id", "turn", "text").collect()
    own = {(c, n): t or "" for c, n, t in [*turns, (99, 0, None), (99, 1, "")]}
    assert {(r["thread"], r["position"]): r["body"] for r in got} == own
    assert {(r["thread"], r["position"]): r["reply_to"] for r in got if r["thread"] != 99} == {k: v for k, v in want.items() if k[0] != 99}
    assert len({k: v for k, v in want.items() if v is not None and k[1] - v > 1}) > 60


def test_a_very_long_message_and_a_deep_thread(spark):
    long = "\n".join(f"row {i}" for i in range(5000))
    rows = [("x", 0, long), ("x", 1, "> row 4321\nshort")] + [("d", i, (f"> step {i - 1}\n" if i else "") + f"step {i}") for i in range(300)]
    got = {(r["thread"], r["position"]): r for r in quotes.conversations(spark.createDataFrame(rows, "c string, n long, t string"), "c", "n", "t").collect()}
    assert got["x", 1]["reply_to"] == 0 and got["x", 0]["body"] == long
    assert [got["d", i]["depth"] for i in range(300)] == [got["d", i]["reply_order"] for i in range(300)] == list(range(300))
