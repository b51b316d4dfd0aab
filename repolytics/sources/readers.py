"""Readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import lines_of
from .splits import numbered_lines, read_records

CORRUPT = "_corrupt_record"


def read_json_rows(spark: SparkSession, path: str, schema, multi_line: bool = False) -> DataFrame:
    """JSON whose documents are arrays: one row per element, none for an empty array.

    One array per line keeps files splittable; ``multi_line`` reads whole-file documents.
    """
    return spark.read.schema(schema).json(path, multiLine=multi_line)


def rows_at(df: DataFrame, array: str, keep_parent: bool = False) -> DataFrame:
    """Rows held in an array column; a missing array gives none unless the parent must stay."""
    explode = F.explode_outer if keep_parent else F.explode
    others = [c for c in df.columns if c != array]
    return df.select(*others, explode(array).alias("__row")).select(*others, "__row.*")


def read_tsv(spark: SparkSession, path: str, schema: T.StructType, on_bad: str = "fail") -> DataFrame:
    """Headered tab-separated log. ``fail`` raises at a ragged line, ``quarantine`` keeps it aside
    in ``_corrupt_record`` (null on good lines)."""
    options = {"sep": "\t", "header": True, "quote": "", "enforceSchema": True}
    if on_bad == "fail":
        # a line is only known to be ragged when all its fields are parsed, whatever is selected
        return spark.read.options(**options, columnPruning=False).schema(schema).csv(path, mode="FAILFAST")
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return spark.read.options(**options).schema(wide).csv(path, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)


def read_text_docs(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files (gzip is decoded by name) as ``path, text``."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """Numbered lines of texts: ``key, line_no`` from 1, ``line``."""
    return df.select(key, F.posexplode(lines_of(text)).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def read_log(spark: SparkSession, path: str | list[str], ordered: bool = False) -> DataFrame:
    """Log lines: ``line``, or with order ``path, line_no`` from 1, ``line``. Files are split either way."""
    return numbered_lines(spark, path) if ordered else spark.read.text(path, lineSep="\n").select(F.col("value").alias("line"))


def file_inventory(spark: SparkSession, folder: str, glob: str = "*", content: bool = False) -> DataFrame:
    """Files of a folder by glob with their size; bytes are read only when asked for. Spark's file
    sources list no files without bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    cols = ["path", "length", "content"] if content else ["path", "length"]
    return files.select(*cols)


# Contents of files from this size on do not fit one value.
MOST_FILE_BYTES = 2_000_000_000


def hashed_files(spark: SparkSession, folder: str, glob: str = "*", most: int = MOST_FILE_BYTES) -> tuple[DataFrame, DataFrame]:
    """``path, length, sha1`` of the files of a folder by glob, and those refused: ``path, length, reason``.

    Bytes are hashed where they are read, and only of files that are not too large: the limit on
    the length reaches the source, which then leaves the contents unread. Files without bytes are
    not listed (see ``file_inventory``).
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    good = files.where(F.col("length") <= most).select("path", "length", F.sha1("content").alias("sha1"))
    return good, files.where(F.col("length") > most).select("path", "length", F.lit("too large").alias("reason"))


def read_csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Headered comma-separated file; a given schema saves the pass that infers one."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema is not None else reader.csv(path, inferSchema=True)


DATASET_ROW = "row_key string, title string, description string, agency string, link_name string, link_url string"


def read_dataset_rows(spark: SparkSession, path: str) -> DataFrame:
    """Spreadsheet rows landed as headered CSV: a key, four values and a link target.

    Quotes are doubled inside values, so any cell text survives, line breaks included; an empty
    cell is null. Large files are split.
    """
    return read_records(spark, path, DATASET_ROW)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Spread a small input over all cores before heavy row-wise work.

    Only a table with fewer splits than the cluster has cores is shuffled. A large table has
    many more splits than that and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str, lower: int, upper: int, partitions: int, **options) -> DataFrame:
    """Relational table read in parallel ranges of a numeric column."""
    return spark.read.options(**options).jdbc(url, table, column=partition_column, lowerBound=lower, upperBound=upper, numPartitions=partitions)
