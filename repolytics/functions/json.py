"""JSON functions on text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c


def path(col: Column | str, *keys: str) -> Column:
    """Scalar below a chain of object keys, as text. Keys may hold dots."""
    return F.get_json_object(_c(col), "$" + "".join(f"['{k}']" for k in keys))


def first_of(*candidates: Column, default: Column | str | None = None) -> Column:
    """First candidate that is neither null nor false, else the default."""
    usable = [F.nullif(c.cast("string"), F.lit("false")) for c in candidates]
    if default is not None:
        usable.append(F.lit(default) if isinstance(default, str) else default)
    return F.coalesce(*usable)


def first_alternative(document: Column | str, *paths: str, default: Column | str | None = None) -> Column:
    """Value at the first of the paths (``$.a.b``) that is neither null nor the boolean false, else
    the default. The text ``"false"`` is a value. Texts come bare, other values as JSON; a
    document that is no JSON has no values."""
    parsed = F.try_parse_json(_c(document))

    def usable(path: str) -> Column:
        value = F.try_variant_get(parsed, path, "variant")
        kind = F.schema_of_variant(value)
        dropped = F.is_variant_null(value) | ((kind == "BOOLEAN") & ~F.coalesce(F.try_variant_get(parsed, path, "boolean"), F.lit(True)))
        text = F.when(kind == "STRING", F.try_variant_get(parsed, path, "string")).otherwise(F.to_json(value))
        return F.when(value.isNotNull() & ~dropped, text)

    found = [usable(path) for path in paths]
    if default is not None:
        found.append(F.lit(default) if isinstance(default, str) else default)
    return F.coalesce(*found)


def listing_file_id(listing: Column | str, name: Column | str) -> Column:
    """File number behind a name in a ``{name: {dataFile: {id}}}`` listing; null when absent."""
    entries = F.from_json(_c(listing), "map<string, struct<dataFile: struct<id: bigint>>>")
    name = F.lit(name) if isinstance(name, str) else name
    return F.try_element_at(entries, name).getField("dataFile").getField("id")


def registration_record(
    storage_id: Column, file_name: Column, checksum: Column, mime: Column, description: str, folder: str, category: str
) -> Column:
    """Registration JSON of an uploaded file. ``restrict`` is text, as its receiver expects."""
    return F.to_json(
        F.struct(
            F.lit(description).alias("description"),
            F.lit(folder).alias("directoryLabel"),
            F.array(F.lit(category)).alias("categories"),
            F.lit("false").alias("restrict"),
            storage_id.alias("storageIdentifier"),
            file_name.alias("fileName"),
            mime.alias("mimeType"),
            F.struct(F.lit("SHA-1").alias("@type"), checksum.alias("@value")).alias("checksum"),
        )
    )


def names_in(array: Column | str, field: str) -> Column:
    """One field of an array of objects, as an array."""
    return F.transform(_c(array), lambda x: x.getField(field))


def has_name(array: Column | str, field: str, value: str) -> Column:
    return F.array_contains(names_in(array, field), value)
