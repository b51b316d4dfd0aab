"""Writers. Everything is written by tasks; nothing passes the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_tsv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").csv(path, sep="\t", header=True, quote="", escapeQuotes=False)
    return path


def write_report(ranked: DataFrame, details: DataFrame, path: str, period: str) -> str:
    """Period report: ranked lines and detail lines as two tab-separated data sets by period."""
    ranked.write.mode("overwrite").partitionBy(period).csv(f"{path}/ranked", sep="\t", header=True)
    details.write.mode("overwrite").partitionBy(period).csv(f"{path}/details", sep="\t", header=True)
    return path


def read_report(spark: SparkSession, path: str, ranked_schema, details_schema) -> tuple[DataFrame, DataFrame]:
    def read(part, schema):
        return spark.read.schema(schema).csv(f"{path}/{part}", sep="\t", header=True)

    return read("ranked", ranked_schema), read("details", details_schema)


def write_documents(rows: DataFrame, path: str, name: str, compression: str = "none", fragment: Column | None = None) -> str:
    """Documents given as fragments (``name, place, fragment``), written as a stream of lines
    ``name<TAB>place<TAB>fragment``.

    Lines are range-sorted by name and place over all files: the third fields of a name's lines,
    read in the order of the files, are the document, of whatever length. One physical file
    per document would mean millions of tiny files. ``compression`` is that of the text files.

    A ``fragment`` made of other columns is built where its line is written: the rows are dealt out as they are.
    """
    if fragment is None:
        # only what a line holds is dealt out
        rows, fragment = rows.select(name, "place", "fragment"), F.col("fragment")
    ordered = rows.repartitionByRange(name, "place").sortWithinPartitions(name, "place")
    line = F.concat_ws("\t", F.col(name), F.col("place").cast("string"), fragment)
    ordered.select(line.alias("value")).write.mode("overwrite").text(path, compression=compression)
    return path


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_name, place, fragment`` of written documents."""
    # a fragment may hold tabs of its own: only the first two separate
    parts = F.split("value", "\t", 3)
    return spark.read.text(path, lineSep="\n").select(parts[0].alias("doc_name"), parts[1].cast("bigint").alias("place"), parts[2].alias("fragment"))


def write_document_files(df: DataFrame, path: str, name: str, document: str) -> str:
    """One folder per document, named after it. For small batches of documents."""
    df.select(F.col(name).alias("doc_name"), F.col(document).alias("value")).write.mode("overwrite").partitionBy("doc_name").text(path)
    return path


def write_snapshot(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path


def read_snapshot(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)
