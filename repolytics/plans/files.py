"""Registration manifests, download plans and metadata building."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json import registration_record
from ..functions.markup import folder_of, is_file_link, is_folder_link, last_link_label, last_link_target
from ..functions.text import base_name, safe_name
from ..operators.filters import bad_response, split_valid
from ..operators.joins import distinct_keys, keyed_join, pending
from ..operators.trees import expand_tree
from ..sources.readers import MOST_FILE_BYTES, hashed_files

# How uploaded files are registered.
UPLOAD_DESCRIPTION = "NetCDF file upload."
UPLOAD_FOLDER = "data/netcdf"
UPLOAD_CATEGORY = "Data"
UPLOAD_MIME = "application/x-netcdf"


def registration_manifest(files: DataFrame, responses: DataFrame, path: str, content: str, storage: str, status: str) -> tuple[DataFrame, DataFrame]:
    """Registration records of uploaded files, and the files whose upload response is unusable.

    ``files`` has path and content, ``responses`` path, storage identifier and status.
    """
    # hashed where the bytes are read: contents never travel through the join
    return _manifest(files.select(path, F.sha1(content).alias("sha1")), responses, path, storage, status, base_name(path))


def _manifest(hashed: DataFrame, responses: DataFrame, path: str, storage: str, status: str, name: Column) -> tuple[DataFrame, DataFrame]:
    answered = hashed.join(responses.select(path, storage, status), path, "left")
    good, refused = split_valid(answered, bad_response(storage, status))
    record = registration_record(F.col(storage), name, F.col("sha1"), F.lit(UPLOAD_MIME), UPLOAD_DESCRIPTION, UPLOAD_FOLDER, UPLOAD_CATEGORY)
    return good.select(path, name.alias("file_name"), record.alias("record")), refused.select(path, "reason")


def register_folder(
    spark: SparkSession, folder: str, responses: DataFrame, glob: str = "*.nc", storage: str = "storage", status: str = "status", name: Column | None = None, most: int = MOST_FILE_BYTES
) -> tuple[DataFrame, DataFrame]:
    """The flow from files: inventory by glob, hash of the bytes, registration records.

    ``responses`` has path, storage identifier and status of the upload of each file. Returns
    ``path, file_name, record`` and the refused files, ``path, reason``: an unusable response, none
    at all, or a file too large to be read as one value. No file at all is an error.
    """
    hashed, large = hashed_files(spark, folder, glob, most)
    if hashed.select("path").isEmpty() and large.isEmpty():
        raise FileNotFoundError(f"no files {glob} in {folder}")
    good, refused = _manifest(hashed, responses, "path", storage, status, base_name("path") if name is None else name)
    return good, refused.unionByName(large.select("path", "reason"))


def listing_entries(lines: DataFrame, key: str, line: str, base_folder: Column | None = None) -> DataFrame:
    """Files and folders of directory index lines ``key, line``: kind, target, local path."""
    base = F.lit("") if base_folder is None else base_folder
    kind = F.when(is_file_link(line), "file").when(is_folder_link(line), "folder")
    prefix = F.when(base != "", F.concat(base, F.lit("/"))).otherwise("")
    local = F.when(kind == "file", F.concat(prefix, safe_name(last_link_label(line)))).otherwise(F.concat(prefix, folder_of(line)))
    return lines.select(key, kind.alias("kind"), last_link_target(line).alias("target"), local.alias("path")).where(
        F.col("kind").isNotNull()
    )


def download_plan(entries: DataFrame, manifest: DataFrame, present: DataFrame, statuses: DataFrame, key: str, ignore_forbidden: bool) -> DataFrame:
    """What to do with each file still to be fetched: ``fetch``, ``skip`` (forbidden and ignored) or ``fail``.

    A file is forbidden when any of its answers had status 403.
    """
    forbidden = distinct_keys(statuses.where(F.col("status") == 403), key).withColumn("__forbidden", F.lit(True))
    action = F.when(F.col("__forbidden"), F.lit("skip" if ignore_forbidden else "fail")).otherwise("fetch")
    todo = keyed_join(pending(entries, manifest, present, key), forbidden, key, "left")
    return todo.withColumn("action", action).drop("__forbidden")


def listing_tree(indexes: DataFrame, folder: str, line: str, root: str = "") -> DataFrame:
    """All files of a dataset with their local path: ``target, path``.

    ``indexes`` holds the index lines of every folder; a folder link names its folder. Folder
    paths are expanded level by level and joined to the files once.
    """
    entries = listing_entries(indexes, folder, line)
    folders, files = entries.where("kind = 'folder'"), entries.where("kind = 'file'")
    edges = folders.select(F.col(folder).alias("parent"), F.col("path").alias("child"), F.col("path").alias("name"))
    paths = expand_tree(edges, root).select(F.col("node").alias(folder), F.col("path").alias("folder_path"))
    below = files.join(paths, folder).select("target", F.concat_ws("/", "folder_path", "path").alias("path"))
    return files.where(F.col(folder) == root).select("target", "path").unionByName(below)
