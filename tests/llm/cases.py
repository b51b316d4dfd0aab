"""Small tables with the awkward rows every operator has to bear, and plain brute-force versions."""

import random
import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use inside or return
        T.StructField("id", T.StringType()),
        T.StructField("kept", T.StringType()),
        T.StructField("t", T.LongType()),
    ]
)


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def prose(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta eta theta iota kappa mu nu xi pi rho sigma tau phi chi psi omega".split()) + str(rng.randint(0, 40)) for _ in range(n))


def texts(seed=1):
    rng = random.Random(seed)
    out = [None, "", "   \n\t ", "one", "one two three", "One TWO three"]
    for n in (5, 40, 200, 400):
        base = prose(rng, n).split(" ")
        out += [" ".join(base)] * 2
        for share in (0.005, 0.02, 0.05, 0.1, 0.3):
            out.append(" ".join(w if rng.random() > share else "x" + w for w in base))
    out.append(prose(rng, 60_000))
    out += ["Ünïcode  ß  日本\n\n é"] * 3
    return out


def documents(spark, rows=None):
    """Every text under an id of its own, then a repeated row, a shared id and rows without id."""
    if rows is None:
        rows = list(enumerate(texts()))
        rows += [rows[7], (3, "another text under a known id"), (None, "no id"), (None, None), (None, rows[8][1])]
    full = [(i, t, None, "src0", None if t is None else len(t), "clash", "clash", 1) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
