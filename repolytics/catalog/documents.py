"""Registered queries: metadata documents and dataset descriptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents as O
from ..operators.trees import children
from ..sources.shapes import dataset_rows, description_tables
from .registry import query
from .snippets import DOCUMENTS, FILES, FLAT_FIELDS

CONTACT = ("Support", "support@example.org")

def metadata(t):
    return O.build_metadata(dataset_rows(t.spread("part")), "row_key", CONTACT)


@query(
    "doc_01_build_metadata",
    """SELECT p_partkey AS row_key, 'CC0 1.0' AS license, p_name AS title, p_brand AS author, 'support@example.org' AS contact, p_type AS description,
         CASE WHEN p_partkey % 2 = 0 THEN '<a href="https://data.example.org/source/' || p_partkey || '">' || p_type || '</a>' END AS origin FROM part""",
)
def doc_01(t):
    """The built documents by their fields, so that both sides name no more of the format than they check."""
    field = lambda at: F.get_json_object("document", f"$.datasetVersion.metadataBlocks.citation.fields{at}")
    return metadata(t).select(
        "row_key",
        F.get_json_object("document", "$.datasetVersion.license.name").alias("license"),
        field("[0].value").alias("title"),
        field("[1].value[0].authorName.value").alias("author"),
        field("[2].value[0].datasetContactEmail.value").alias("contact"),
        field("[3].value[0].dsDescriptionValue.value").alias("description"),
        field("[5].value").alias("origin"),
    )


@query("doc_02_flatten_metadata", f"WITH {FLAT_FIELDS} SELECT row_key, 'citation' AS block, type_name, type_class, idx, subfield, value FROM flat")
def doc_02(t):
    return O.flatten_metadata(metadata(t), "row_key", "document")


def edits(part):
    """Edit bodies for every third part: a new title, a subtitle, two authors."""
    body = F.concat(
        F.lit('{"fields":[{"typeName":"title","value":"Changed '),
        F.col("p_partkey"),
        F.lit('"},{"typeName":"subtitle","value":"Sub"},{"typeName":"author","value":['),
        F.lit('{"authorName":{"typeName":"authorName","value":"'),
        F.col("p_brand"),
        F.lit('"}},{"authorName":{"typeName":"authorName","value":"'),
        F.col("p_type"),
        F.lit('"},"authorAffiliation":{"typeName":"authorAffiliation","value":"'),
        F.col("p_name"),
        F.lit('"}}]}]}'),
    )
    return part.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("row_key"), body.alias("body"))


EDIT_SQL = """edit AS (
  SELECT p_partkey AS row_key, 'title' AS type_name, 'primitive' AS type_class, 0 AS idx, CAST(NULL AS VARCHAR) AS subfield, 'Changed ' || p_partkey AS value FROM part WHERE p_partkey % 3 = 0
  UNION ALL SELECT p_partkey, 'subtitle', NULL, 0, NULL, 'Sub' FROM part WHERE p_partkey % 3 = 0
  UNION ALL SELECT p_partkey, 'author', 'compound', 0, 'authorName', p_brand FROM part WHERE p_partkey % 3 = 0
  UNION ALL SELECT p_partkey, 'author', 'compound', 1, 'authorName', p_type FROM part WHERE p_partkey % 3 = 0
  UNION ALL SELECT p_partkey, 'author', 'compound', 1, 'authorAffiliation', p_name FROM part WHERE p_partkey % 3 = 0)"""


@query(
    "doc_03_edit_replace",
    f"""WITH {FLAT_FIELDS}, {EDIT_SQL} SELECT row_key, type_name, type_class, idx, subfield, value FROM edit
        UNION ALL SELECT * FROM flat WHERE NOT (row_key % 3 = 0 AND type_name IN ('title', 'subtitle', 'author'))""",
)
def doc_03(t):
    merged = O.merge_edit(doc_02(t), O.flatten_edit(edits(t.part), "row_key", "body"), "row_key")
    return merged.drop("block")


@query(
    "doc_03_edit_add",
    f"""WITH {FLAT_FIELDS}, {EDIT_SQL} SELECT row_key, type_name, type_class, CAST(idx + CASE WHEN type_name = 'subtitle' THEN 0 ELSE 1 END AS INTEGER) AS idx, subfield, value FROM edit
        UNION ALL SELECT * FROM flat""",
)
def doc_03_add(t):
    merged = O.merge_edit(doc_02(t), O.flatten_edit(edits(t.part), "row_key", "body"), "row_key", mode="add")
    return merged.drop("block")


def descriptions(t):
    datasets, files = description_tables(t.orders, t.lineitem)
    return O.export_description(datasets, files, "o_orderkey", ["@id", "contentSize"])


@query("doc_04_export_description", f"WITH {DOCUMENTS} SELECT o_orderkey, CAST(part AS INTEGER) AS part, document FROM documents_of_orders")
def doc_04(t):
    datasets, files = description_tables(t.orders, t.lineitem)
    # a document is made of parts of up to 1000 files, and is one row: part 0 of itself
    whole = O.whole_descriptions(datasets, files, "o_orderkey", ["@id", "contentSize"])
    return whole.select("o_orderkey", F.lit(0).alias("part"), "document")


@query(
    "doc_05_parse_files",
    f"WITH {FILES} SELECT o_orderkey, name AS file_id, name AS file_name, bytes, encoding, md5(name) AS md5 FROM files WHERE o_orderkey IN (SELECT o_orderkey FROM orders)",
)
def doc_05(t):
    return O.parse_fragments(descriptions(t), "o_orderkey")[1]


@query(
    "doc_05_parse_datasets",
    f"""WITH {FILES} SELECT o.o_orderkey, 'Order ' || o.o_orderkey AS name, 'https://doi.org/10.5072/' || o.o_orderkey AS url, '1.0' AS version,
        'http://creativecommons.org/publicdomain/zero/1.0' AS license, count(f.name) AS n_files
        FROM orders o LEFT JOIN files f ON f.o_orderkey = o.o_orderkey GROUP BY o.o_orderkey""",
)
def doc_05_datasets(t):
    return O.parse_fragments(descriptions(t), "o_orderkey")[0]


@query("doc_06_children", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def doc_06(t):
    return children(t.nation, "n_regionkey", 2).select("n_nationkey", "n_name")
