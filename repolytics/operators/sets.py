"""Set operators: distinct union, validation reports, field merging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import distinct_keys


def union_distinct(*frames: DataFrame) -> DataFrame:
    """Union without duplicates; every side drops its own repeats before the shuffle."""
    return reduce(lambda a, b: a.unionByName(b), frames).distinct()


def check(df: DataFrame, name: str, severity: str, offending: Column) -> DataFrame:
    """One row: how many rows break a check."""
    return df.agg(F.count_if(offending).alias("offending")).select(
        F.lit(name).alias("check"), F.lit(severity).alias("severity"), "offending"
    )


def checks(df: DataFrame, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """Many checks of one table from one scan: ``check, severity, offending`` for each of
    ``name: (severity, offending rows)``."""
    counted = df.agg(*[F.count_if(cond).alias(f"c{i}") for i, (_, cond) in enumerate(rules.values())])
    rows = [F.struct(F.lit(name).alias("check"), F.lit(severity).alias("severity"), F.col(f"c{i}").alias("offending")) for i, (name, (severity, _)) in enumerate(rules.items())]
    return counted.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def validation_report(checks: list[DataFrame]) -> DataFrame:
    """The checks that found something, stacked."""
    return reduce(lambda a, b: a.unionByName(b), checks).where(F.col("offending") > 0)


def validation_summary(report: DataFrame) -> DataFrame:
    return report.agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
        (F.count_if(F.col("severity") == "error") == 0).alias("passed"),
    )


def merge_fields(schema: DataFrame, wanted: DataFrame, multi_valued: list[str]) -> DataFrame:
    """Correct the multi-value flag of listed fields and add those wanted fields not yet there."""
    fixed = schema.withColumn("multi_valued", F.col("multi_valued") | F.col("name").isin(multi_valued))
    new = wanted.join(distinct_keys(schema, "name"), "name", "left_anti")
    return fixed.unionByName(new)
