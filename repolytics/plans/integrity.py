"""Template integrity, configuration drift and index consistency jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markup import attribute
from ..functions.text import is_property, quote_url_value, strip_unsafe
from ..operators.aggregates import consistency, duplicate_keys, pattern_counts
from ..operators.filters import key_matches, where_key
from ..operators.joins import coverage_matrix, effective_levels, keyed_join, missing_options, options_of, reconcile, table_diff, with_parent
from ..operators.ordering import order_hidden, then_tail
from ..operators.sequence import context_lines, later_duplicates
from ..operators.sets import union_distinct


def template_coverage(catalog: dict[str, DataFrame]) -> DataFrame:
    """Blocks of each template against the parents using it."""
    return coverage_matrix(catalog["parents"], catalog["blocks"], catalog["enabled"], "template_id", "parent_id", "block")


def template_levels(parents: DataFrame, fields: DataFrame, overrides: DataFrame) -> DataFrame:
    """Effective input levels of each template's fields in the parents using it."""
    return effective_levels(parents, fields, overrides, "template_id", "parent_id", "field")


class TemplateCheck:
    """Template integrity from catalog tables, of all templates or of the one asked for by name or number.

    Tables: ``template(id, name, owner_id)``, ``parent(id, name, default_template_id)``,
    ``block(id, name)``, ``enabled(parent_id, block_id)``, ``template_field(template_id,
    field_type_id)``, ``field_type(id, name, block_id, display_order)`` and ``level(parent_id,
    field_type_id, include, required)``. Ids are unique in their tables.
    """

    def __init__(self, tables: dict[str, DataFrame], asked: str | None = None):
        self.tables = tables
        template = tables["template"] if asked is None else find_template(tables["template"], asked)
        self.template = template.select(F.col("id").alias("template_id"), F.col("name").alias("template_name"), F.col("owner_id").alias("parent_id"))
        parent = tables["parent"]
        self.parent = parent.select(F.col("id").alias("parent_id"), F.col("name").alias("parent_name"), F.col("default_template_id").alias("template_id"))
        types = tables["field_type"].select(F.col("id").alias("field_type_id"), F.col("name").alias("field"), "block_id", "display_order")
        self.fields = keyed_join(tables["template_field"].select("template_id", "field_type_id"), types, "field_type_id")

    def associations(self) -> DataFrame:
        """Every template with its owner and that owner's default, if it has an owner."""
        return with_parent(self.template, self.parent.withColumnRenamed("template_id", "default_template_id"), "parent_id")

    def users(self) -> DataFrame:
        """Parents that use a template, as their default or as its owner: each pair once."""
        default = self.parent.where(F.col("template_id").isNotNull()).select("template_id", "parent_id")
        owned = self.template.where(F.col("parent_id").isNotNull()).select("template_id", "parent_id")
        pairs = keyed_join(union_distinct(default, owned), self.template.select("template_id", "template_name"), "template_id")
        return keyed_join(pairs, self.parent.select("parent_id", "parent_name"), "parent_id")

    def coverage(self) -> DataFrame:
        """``position, template_name, parent_name, block, status``: the blocks of a template's fields
        against the parents using it, in order of template, parent and block name."""
        blocks = self.fields.select("template_id", "block_id").distinct()
        matrix = coverage_matrix(self.users(), blocks, self.tables["enabled"].select("parent_id", "block_id"), "template_id", "parent_id", "block_id")
        named = keyed_join(matrix, self.tables["block"].select(F.col("id").alias("block_id"), F.col("name").alias("block")), "block_id")
        order = [F.col(c) for c in ("template_id", "parent_name", "block", "parent_id")]
        return order_hidden(named, order, ["template_name", "parent_name", "block", "status"])

    def levels(self) -> DataFrame:
        """``position, template_name, parent_name, field, include, required``: the effective input level of
        every field of a template, as often as it occurs, in order of parent name and display order."""
        level = effective_levels(self.users(), self.fields, self.tables["level"], "template_id", "parent_id", "field_type_id")
        order = [F.col(c) for c in ("template_id", "parent_name", "display_order", "field", "parent_id")]
        return order_hidden(level, order, ["template_name", "parent_name", "field", "include", "required"])


def config_drift(a: DataFrame, b: DataFrame, raw: str, exclude: str | None) -> dict[str, DataFrame]:
    """Two option listings: options to add, keys set more than once in ``a``, line difference."""
    oa, ob = options_of(a, raw), options_of(b, raw)
    to_add = missing_options(oa, ob, exclude).distinct().withColumn("to_set", quote_url_value("option"))
    return {"to_add": to_add, "repeated": duplicate_keys(oa.distinct(), "key", "option"), "diff": table_diff(oa, ob)}


def later_options(listing: DataFrame, pos: str, raw: str) -> DataFrame:
    """Options of a listing whose key was set before."""
    return later_duplicates(options_of(listing, raw, pos), "key", [pos])


def family_options(listing: DataFrame, raw: str, family: str) -> DataFrame:
    """Properties of one key family, with the number of times their key is set."""
    options = options_of(listing, raw).where(is_property("option") & key_matches("key", include=family))
    counts = options.groupBy("key").agg(F.count("*").alias("n"))
    return keyed_join(options.distinct(), counts, "key")


def properties_to_sync(lines: DataFrame, line: str, exclude: str) -> DataFrame:
    """``name, value`` of system property tags outside an excluded family; both must be set."""
    tags = where_key(lines.where(F.col(line).contains("<system-property ")), line, exclude=exclude)
    found = tags.select(attribute(line, "name").alias("name"), attribute(line, "value").alias("value"))
    return found.where((F.col("name") != "") & (F.col("value") != ""))


def find_template(templates: DataFrame, asked: str, id_col: str = "id", name_col: str = "name") -> DataFrame:
    """Templates by number or by name. A number stands for the name behind it."""
    if asked.isdigit():
        return templates.join(templates.where(F.col(id_col) == int(asked)).select(name_col).distinct(), name_col, "left_semi")
    # compared as a value, never spliced into a statement
    return templates.where(F.col(name_col) == strip_unsafe(F.lit(asked)))


def index_consistency(db: DataFrame, index: DataFrame, key: str, db_rules: dict[str, Column], index_rules: dict[str, Column]) -> dict[str, DataFrame]:
    """Counts with verdicts, and the keys that only one side knows."""
    return {
        "verdicts": consistency(db, index, db_rules, index_rules),
        "unmatched": reconcile(db.select(key), index.select(key), key).where(F.col("status") != "both"),
    }


def index_errors(lines: DataFrame, line: str, patterns: dict[str, str], recent: int, *order: str) -> dict[str, DataFrame]:
    """How often each error pattern occurs, and the latest matching lines."""
    first = next(iter(patterns.values()))
    return {
        "counts": pattern_counts(lines, line, patterns),
        "recent": then_tail(lines, F.col(line).rlike(first), recent, *order),
    }


def error_surroundings(lines: DataFrame, file: str, line_no: str, line: str, hit: str, wanted: str, first: int, around: int = 2) -> DataFrame:
    """Of the lines around each hit (``around`` before and after), those that match ``wanted``; the
    first ``first`` of them in the order of files and lines, with their position."""
    near = context_lines(lines, file, line_no, F.col(line).rlike(hit), around, around)
    found = near.where(F.col(line).rlike(wanted)).orderBy(file, line_no).limit(first)
    return order_hidden(found, [F.col(file), F.col(line_no)], [file, line_no, line])
