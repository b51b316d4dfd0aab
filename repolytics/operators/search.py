"""Keyword search over written postings.

``write_postings`` reads the texts once and keeps, for each word and document, how often the word
occurs. The rows are dealt by word and document and sorted by word within each file: a search reads the
row groups of its words only and never the texts. A word that occurs in every document is spread over all files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordering import with_position

# Fixed value: what separates words.
NOT_A_WORD = r"[^\p{L}\p{N}]+"


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """``term, <key>, n``: words of each text without case and how often they occur. Counted
    inside the row; nothing is shuffled."""
    words = F.array_remove(F.split(F.lower(text), NOT_A_WORD), "")
    # runs of the sorted words: each begins where a word differs from the one before
    ordered = df.select(key, F.array_sort(words).alias("w"))
    # no filter on the words: it would be moved below and take the texts apart a second time
    places = F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1))
    starts = F.filter(places, lambda i: (i == 0) | (F.get("w", i) != F.get("w", i - 1)))
    ranked = ordered.withColumn("s", starts)
    run = F.transform("s", lambda i, k: F.struct(F.get("w", i).alias("term"), (F.coalesce(F.get("s", k + 1), F.size("w")) - i).cast("bigint").alias("n")))
    return ranked.select(key, F.explode(run).alias("p")).select("p.term", key, "p.n")


def write_postings(df: DataFrame, key: str, text: str, path: str) -> str:
    rows = postings(df, key, text)
    # dealt by hash: ranges would have to be sampled, which takes all texts apart once more
    rows.repartition("term", key).sortWithinPartitions("term", key).write.mode("overwrite").parquet(path)
    return path


def search(spark: SparkSession, path: str, key: str, terms: list[str], limit: int | None = None) -> DataFrame:
    """``position, <key>, hits`` of the documents that hold any of the words, most hits first, then
    by key; the caller may limit them."""
    wanted = sorted({t.lower() for t in terms})
    found = spark.read.parquet(path).where(F.col("term").isin(wanted)).groupBy(key).agg(F.sum("n").alias("hits"))
    if limit is not None:
        found = found.orderBy(F.desc("hits"), key).limit(limit)
    return with_position(found, F.desc("hits"), F.col(key)).select("position", key, "hits")
