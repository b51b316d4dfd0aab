"""Metadata documents and dataset descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import anchor, clean_cell
from .fragments import fragments, late_text, placed_rows
from .ordered import LIST_SIZE, LONG_SERIES, bounded_lists

FIELD = "struct<typeName: string, typeClass: string, multiple: boolean, value: variant>"
METADATA = (
    "struct<datasetVersion: struct<license: struct<name: string, uri: string>, "
    f"metadataBlocks: map<string, struct<displayName: string, fields: array<{FIELD}>>>>>"
)
DESCRIPTION = (
    "struct<name: string, url: string, version: string, license: string, keywords: array<string>, "
    "creator: array<struct<name: string>>, "
    "distribution: array<struct<`@id`: string, contentSize: string, contentUrl: string, "
    "encodingFormat: string, md5: string, name: string>>>"
)

# The licence a new dataset starts with and the label of the citation block.
LICENSE_NAME = "CC0 1.0"
LICENSE_URI = "http://creativecommons.org/publicdomain/zero/1.0"
BLOCK_LABEL = "Citation Metadata"


def _leaf(name: str, value: Column) -> Column:
    return F.struct(
        value.alias("value"), F.lit("primitive").alias("typeClass"), F.lit(False).alias("multiple"), F.lit(name).alias("typeName")
    )


def _field(name: str, cls: str, multiple: bool, value: Column) -> Column:
    """One field as JSON. Fields differ in the type of ``value``, so each is rendered on its own."""
    return F.to_json(
        F.struct(
            value.alias("value"), F.lit(cls).alias("typeClass"), F.lit(multiple).alias("multiple"), F.lit(name).alias("typeName")
        ),
        {"ignoreNullFields": "true"},
    )


def _compound(name: str, parts: dict[str, Column]) -> Column:
    entry = F.struct(*[_leaf(sub, value).alias(sub) for sub, value in parts.items()])
    return _field(name, "compound", True, F.array(entry))


def metadata_json(
    title: Column, description: Column, author: Column, contact: tuple[str, str], source: Column | None = None
) -> Column:
    """Metadata document of one dataset row. Null ``source`` leaves its field out."""
    fields = [
        _field("title", "primitive", False, title),
        # the author has no affiliation: the subfield is left out
        _compound("author", {"authorName": author}),
        _compound("datasetContact", {"datasetContactEmail": F.lit(contact[1]), "datasetContactName": F.lit(contact[0])}),
        _compound("dsDescription", {"dsDescriptionValue": description}),
        _field("subject", "controlledVocabulary", True, F.array(F.lit("Other"))),
    ]
    if source is not None:
        fields.append(F.when(source.isNotNull(), _field("originOfSources", "primitive", False, source)))
    version = F.to_json(F.struct(F.lit(LICENSE_NAME).alias("name"), F.lit(LICENSE_URI).alias("uri")))
    return F.concat(
        F.lit('{"datasetVersion":{"license":'),
        version,
        F.lit(',"metadataBlocks":{"citation":{"fields":['),
        F.concat_ws(",", *fields),
        F.lit(f'],"displayName":"{BLOCK_LABEL}"' + "}}}}"),
    )


def build_metadata(rows: DataFrame, key: str, contact: tuple[str, str]) -> DataFrame:
    """Dataset rows (title, description, agency, link_name, link_url) as metadata documents."""
    return rows.select(
        key,
        metadata_json(
            clean_cell("title"),
            clean_cell("description"),
            clean_cell("agency"),
            contact,
            anchor("link_url", clean_cell("link_name")),
        ).alias("document"),
    )


def _entries(df: DataFrame, keep: list[str], entries: Column | str, *names: str) -> DataFrame:
    """One row for each entry of an array or map, as ``explode`` gives them.

    An inner generator adds a filter on its input, which builds and parses the documents a
    second time; the outer form with the place tested afterwards parses them once.
    """
    return df.select(*keep, F.posexplode_outer(entries).alias("__at", *names)).where(F.col("__at").isNotNull()).drop("__at")


def flatten_metadata(df: DataFrame, key: str, document: str) -> DataFrame:
    """Long rows ``(key, block, type_name, type_class, idx, subfield, value)`` of metadata documents.

    A field's value is text, an array of texts, or an array of maps of subfields; it is parsed
    once as a variant and taken apart by its shape.
    """
    parsed = df.select(key, F.from_json(document, METADATA).alias("__d"))
    blocks = _entries(parsed, [key], "__d.datasetVersion.metadataBlocks", "block", "__b")
    return _flatten_fields(_entries(blocks, [key, "block"], "__b.fields", "__f"), [key, "block"])


def flatten_edit(df: DataFrame, key: str, body: str, block: str = "citation") -> DataFrame:
    """Long rows of an edit body; its fields carry no class."""
    parsed = df.select(key, F.lit(block).alias("block"), F.from_json(body, f"struct<fields: array<{FIELD}>>").alias("__d"))
    return _flatten_fields(_entries(parsed, [key, "block"], "__d.fields", "__f"), [key, "block"])


def _flatten_fields(fields: DataFrame, keys: list[str]) -> DataFrame:
    base = fields.select(*keys, F.col("__f.typeName").alias("type_name"), F.col("__f.typeClass").alias("type_class"), F.col("__f.value").alias("__v"))
    text = F.try_variant_get("__v", "$", "string")
    texts = F.try_variant_get("__v", "$", "array<string>")
    maps = F.try_variant_get("__v", "$", "array<map<string, struct<value: string>>>")
    shape = F.schema_of_variant("__v")
    entry = "array<struct<idx: int, subfield: string, value: string>>"
    single = F.array(F.struct(F.lit(0).alias("idx"), F.lit(None).cast("string").alias("subfield"), text.alias("value")))
    listed = F.transform(
        texts, lambda x, i: F.struct(i.alias("idx"), F.lit(None).cast("string").alias("subfield"), x.alias("value"))
    )
    nested = F.flatten(
        F.transform(
            maps,
            lambda m, i: F.transform(
                F.map_entries(m),
                lambda e: F.struct(i.alias("idx"), e["key"].alias("subfield"), e["value"]["value"].alias("value")),
            ),
        )
    )
    parts = (
        F.when(shape.startswith("ARRAY<OBJECT"), nested.cast(entry))
        .when(shape.startswith("ARRAY"), listed.cast(entry))
        .otherwise(single.cast(entry))
    )
    named = [*keys, "type_name", "type_class"]
    return _entries(base, named, parts, "__p").select(*named, "__p.*")


def merge_edit(rows: DataFrame, edit: DataFrame, key: str, mode: str = "replace") -> DataFrame:
    """Apply flattened edit bodies to flattened documents.

    ``replace`` drops the old rows of every edited field, ``add`` keeps them and numbers the
    new entries behind them. A field edited without a class keeps the class it had.
    """
    field = [key, "block", "type_name"]
    old = rows.groupBy(*field).agg(F.max("type_class").alias("old_class"), (F.max("idx") + 1).alias("old_n"))
    classed = edit.join(old, field, "left").withColumn("type_class", F.coalesce("type_class", "old_class"))
    if mode == "replace":
        kept = rows.join(edit.select(*field).distinct(), field, "left_anti")
    else:
        kept = rows
        classed = classed.withColumn("idx", F.col("idx") + F.coalesce("old_n", F.lit(0)))
    return kept.unionByName(classed.select(*rows.columns))


def _file_columns() -> list[Column]:
    return [
        F.col("__f.@id").alias("file_id"),
        F.col("__f.name").alias("file_name"),
        F.col("__f.contentSize").try_cast("bigint").alias("bytes"),
        F.col("__f.encodingFormat").alias("encoding"),
        F.col("__f.md5").alias("md5"),
    ]


def _description_texts(dataset: dict[str, Column], file: dict[str, Column]) -> tuple[Column, Column, Column]:
    """Of the columns of dataset rows and of file rows: the text before and behind a description's entries, and that of an entry."""
    opening = F.to_json(F.struct(F.lit("sc:Dataset").alias("@type"), F.array(F.struct(F.lit("Person").alias("@type"), dataset["creator"].alias("name"))).alias("creator")))
    closing = F.to_json(F.struct(F.array(dataset["keyword"]).alias("keywords"), *[dataset[c].alias(c) for c in ("license", "name", "url", "version")]))
    head = F.concat(F.regexp_replace(opening, r"\}$", ""), F.lit(',"distribution":['))
    tail = F.concat(F.lit("],"), F.regexp_replace(closing, r"^\{", ""))
    return head, tail, F.to_json(F.struct(*[c.alias(n) for n, c in file.items()]))


def _description_parts(datasets: DataFrame, files: DataFrame, key: str) -> tuple[DataFrame, Column]:
    """``key, head, tail``, the text around a description's entries, and the text of an entry."""
    own = ({c: F.col(f"`{c}`") for c in df.columns if c != key} for df in (datasets, files))
    head, tail, entry = _description_texts(*own)
    return datasets.select(key, head.alias("head"), tail.alias("tail")), entry


def whole_descriptions(
    datasets: DataFrame, files: DataFrame, key: str, order: list[str], part_size: int = LIST_SIZE, long_series: int = LONG_SERIES
) -> DataFrame:
    """``key, document``: one whole document for each dataset row, with all its files.

    Tables as for ``export_description``. Files are numbered within their dataset and gathered in parts of at most
    ``part_size``, so that no task sorts a list of all files of a dataset; the parts are joined in their order. A document
    is one row, so it must fit one; ``export_description`` has no such bound.
    """
    frames, entry = _description_parts(datasets, files, key)
    parts = bounded_lists(files, [key], order, entry, "__l", part_size, long_series).select(key, "part", F.array_join("__l", ",").alias("text"))
    lists = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("__p"))
    entries = F.coalesce(F.array_join("__p.text", ","), F.lit(""))
    return frames.join(lists, key, "left").select(key, F.concat("head", entries, "tail").alias("document"))


def export_description(
    datasets: DataFrame,
    files: DataFrame,
    key: str,
    order: list[str],
    long_series: int = LONG_SERIES,
    shape: tuple[dict[str, Column], dict[str, Column]] | None = None,
    ties: list[Column] | None = None,
) -> DataFrame:
    """Dataset rows and their files as dataset-description JSON: ``key, place, fragment``.

    ``datasets``: key, name, url, version, license, keyword, creator. ``files``: key, ``@id``,
    contentSize, contentUrl, encodingFormat, md5, name, sorted by ``order``. However many files a
    dataset has, it is one document: fragment 0 opens it, each file is a fragment, the last one
    closes it. Both tables are read once.

    With ``shape``, the columns named above as made of other columns of the two tables, the rows come with these
    instead of ``fragment``, and ``description_fragment`` gives its text: a table of fragments is many times as large
    as what they are made of. ``ties`` then sort files that tie on ``order`` as their texts would; datasets of one key
    differ in keyword and creator only.
    """
    if shape is None:
        frames, entry = _description_parts(datasets, files, key)
        return fragments(files, [key], order, entry, frames, long_series=long_series)
    dataset, file = shape
    # as much of head and tail as differs
    head, tail = F.to_json(F.struct(dataset["creator"].alias("name"))), F.to_json(F.array(dataset["keyword"]))
    return placed_rows(files, [key], [*[file[c] for c in order], *(ties or [])], datasets, head, tail, long_series)


def description_fragment(shape: tuple[dict[str, Column], dict[str, Column]]) -> Column:
    """The fragment of a row that ``export_description`` gave with that ``shape``."""
    head, tail, entry = _description_texts(*shape)
    return late_text(entry, head, tail)


def parse_fragments(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Dataset rows and file rows of fragments: the entries are parsed one by one, the dataset is
    what stands around them."""
    text = F.col("fragment")
    around = (F.col("place") == 0) | text.startswith("]")
    ends = rows.groupBy(key).agg(
        F.max(F.when(F.col("place") == 0, text)).alias("head"),
        F.max(F.when(text.startswith("]"), text)).alias("tail"),
        F.count_if(~around).alias("n_files"),
    )
    bare = ends.select(key, F.from_json(F.concat("head", "tail"), DESCRIPTION).alias("__d"), "n_files")
    datasets = bare.select(key, "__d.name", "__d.url", "__d.version", "__d.license", "n_files")
    entry = DESCRIPTION.split("distribution: array<", 1)[1][:-2]
    parsed = rows.where(~around).select(key, F.from_json(F.regexp_replace("fragment", "^,", ""), entry).alias("__f"))
    return datasets, parsed.select(key, *_file_columns())


def parse_description(df: DataFrame, key: str, document: str) -> tuple[DataFrame, DataFrame]:
    """Dataset rows and file rows of description documents held in one value each; sizes become numbers."""
    parsed = df.select(key, F.from_json(document, DESCRIPTION).alias("__d"))
    datasets = parsed.select(
        key, "__d.name", "__d.url", "__d.version", "__d.license", F.size("__d.distribution").cast("bigint").alias("n_files")
    )
    return datasets, _entries(parsed, [key], "__d.distribution", "__f").select(key, *_file_columns())
