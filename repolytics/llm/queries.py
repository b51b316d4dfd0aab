"""The registered queries: every operator on its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import alignment, centroids, decontam, exact_dedup, licenses, lm, minhash, packing, quality, quotes, repeats, toxicity, wavelet
from .registry import llm_query, table


def vocabulary() -> str:
    """The file of the default vocabulary, outside the repository."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@llm_query("op1_minmax_near_duplicates")
def op1(spark, folder):
    return minhash.near_duplicates(table(spark, folder, "documents"), spec=minhash.NearDup(width=4, percent=80))


@llm_query("op2_nnls_packing")
def op2(spark, folder):
    return packing.pack(table(spark, folder, "documents"), vocabulary(), end=0, window=1024)


@llm_query("op3_license_passages")
def op3(spark, folder):
    return licenses.scan(table(spark, folder, "documents"))


@llm_query("op4_deleted_interpolation")
def op4(spark, folder):
    return lm.lm_scores(table(spark, folder, "documents"))


@llm_query("op5_wavelet_shards")
def op5(spark, folder):
    docs = table(spark, folder, "documents")
    files = wavelet.write_shards(docs, vocabulary(), end=2)
    return wavelet.read_shards(spark, files).withColumnRenamed("id", "doc_id")


@llm_query("op6_tiled_decontamination")
def op6(spark, folder):
    found = decontam.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", "item_words", "covered", "coverage", F.size("tiles").alias("n_tiles"), F.to_json("tiles").alias("tiles"))


@llm_query("op7_sentence_toxicity")
def op7(spark, folder):
    return toxicity.toxicity_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@llm_query("op8_factorization_quality")
def op8(spark, folder):
    return quality.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@llm_query(
    "op9_progressive_dedup",
    """
    select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
           doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
    from documents window same as (partition by coalesce(text, ''))
    """,
)
def op9(spark, folder):
    return exact_dedup.mark_duplicates(table(spark, folder, "documents"))


def quoted_messages(turns):
    """The conversations as a mailing list keeps them, with the turn that each one answers as ``answered``.

    By the hash of conversation and turn a message answers one of the three turns before it and quotes that one whole,
    trimmed (without its first line), with other line breaks, or in two parts around the answer with an older turn
    one level deeper.
    """
    key = ["conv_id", "turn"]
    text = turns.groupBy(*key).agg(F.max(F.coalesce("text", F.lit(""))).alias("q"))
    back = F.pmod(F.xxhash64(*key, F.lit("source")), F.lit(3))
    answered = F.when(F.col("turn") > 0, F.greatest(F.lit(0), F.col("turn") - 1 - back))
    rows = turns.withColumns({"answered": answered, "older": answered - 1, "style": F.pmod(F.xxhash64(*key, F.lit("style")), F.lit(4))})
    one = text.select("conv_id", F.col("turn").alias("answered"), F.col("q").alias("q1"))
    two = text.select("conv_id", F.col("turn").alias("older"), F.col("q").alias("q2"))
    joined = rows.join(one, ["conv_id", "answered"], "left").join(two, ["conv_id", "older"], "left")
    mark = lambda c, sign: F.when(c.isNotNull(), F.concat(F.regexp_replace(c, r"(?m)^", sign), F.lit("\n"))).otherwise("")
    lines = F.split("q1", "\n")
    first, rest = lines[0], F.nullif(F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), "\n"), F.lit(""))
    flowed = F.regexp_replace(F.regexp_replace("q1", "\n", " "), r"(.{40}\S*) ", "$1\n")
    own = F.coalesce("text", F.lit(""))
    style = F.col("style")
    message = (
        F.when(style == 0, F.concat(mark(F.col("q1"), "> "), own))
        .when(style == 1, F.concat(mark(F.coalesce(rest, "q1"), "> "), own))
        .when(style == 2, F.concat(mark(flowed, ">"), own))
        .otherwise(F.concat(mark(F.col("q2"), "> > "), mark(first, "> "), own, F.lit("\n"), mark(rest, "> ")))
    )
    return joined.select(*key, message.alias("text"), "answered")


@llm_query("op10_quotation_links")
def op10(spark, folder):
    linked = quotes.conversations(quoted_messages(table(spark, folder, "conversations")), "conv_id", "turn", "text")
    return linked.withColumnsRenamed({"thread": "conv_id", "position": "turn", "body": "text"})


@llm_query("op11_bisector_clusters", centroids.clusters_sql())
def op11(spark, folder):
    return centroids.clusters(table(spark, folder, "embeddings"))


@llm_query("op12_fragment_alignment")
def op12(spark, folder):
    import public_tokenizers

    return alignment.align(table(spark, folder, "documents"), vocabulary(), public_tokenizers.path("piece_bpe_32k.model"))


@llm_query("op13_seeded_repeats")
def op13(spark, folder):
    return repeats.without_repeats(table(spark, folder, "documents"))
