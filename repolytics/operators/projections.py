"""Projections: display lines, key/value rows, nested shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def display(*cols: str) -> Column:
    """The given columns as one space-separated line."""
    return F.concat_ws(" ", *[F.col(c).cast("string") for c in cols])


def unpivot_record(df: DataFrame, ids: list[str], nested: str | None = None, name="key", value="value") -> DataFrame:
    """Key/value rows of each record: its plain columns, then the fields of its first nested entry."""
    plain = [c for c in df.columns if c not in ids and c != nested]
    cols = [F.col(c).cast("string").alias(c) for c in plain]
    if nested is not None:
        first = F.get(F.col(nested), F.lit(0))
        fields = df.schema[nested].dataType.elementType.names
        cols += [first.getField(f).cast("string").alias(f) for f in fields]
        plain = plain + list(fields)
    return df.select(*ids, *cols).unpivot(ids, plain, name, value)


def project_nested(df: DataFrame, columns: dict[str, str], array: str, fields: list[str]) -> DataFrame:
    """Renamed columns plus an array cut down to the given fields, its order kept."""
    cut = F.transform(F.col(array), lambda x: F.struct(*[x.getField(f).alias(f) for f in fields]))
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in columns.items()], cut.alias(array))
