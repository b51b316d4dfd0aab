"""Rule classification of log lines and the verdict on a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Message patterns of a deployment run, compared without case. Narrower forms of
# a pattern that is listed anyway add nothing and are left out.
MIGRATION = [
    "column.*does not exist",
    "relation.*does not exist.*migration",
    "displayoncreate.*does not exist",
    "INDEX.*displayoncreate.*does not exist",
    "Flyway",
    "database migration",
    "schema migration",
    "Migration.*in.*progress",
    "temporary.*migration.*error",
    "Schema.*update.*pending",
]
BENIGN = [
    "duplicate key value violates unique constraint",
    "already exists",
    "PER01000.*duplicate key",
    "PSQLException.*duplicate key",
    "application.*already registered",
    "PER01003.*Deployment encountered SQL Exceptions",
]
FATAL = [
    "FATAL:",
    "connection refused",
    "could not connect",
    "authentication failed",
    "permission denied",
    "disk full",
    "out of memory",
    "syntax error",
    "table.*does not exist",
    "database.*does not exist",
    "java.lang.OutOfMemoryError",
    "StackOverflowError",
    "NoClassDefFoundError",
    "ClassNotFoundException",
    "UnsupportedClassVersionError",
    "Failed to deploy.*critical",
    "WAR file.*corrupted",
    "Invalid WAR file",
    "Schema validation.*failed",
    "Database connection.*refused",
]
POLICY = [
    "Failed to load default.policy",
    "SecurityException",
    "AccessControlException",
    "Policy file.*not found",
    "Security.*configuration.*error",
    "Permission.*denied.*policy",
]
ERROR = ["error", "exception", "failed"]
REGISTERED = ["application.*already registered"]
DEPLOY_FAILED = ["Command deploy failed"]


def matches_any(line: Column | str, patterns: list[str]) -> Column:
    """Whether a line matches one of the patterns, without case. One alternation, one pass."""
    c = F.col(line) if isinstance(line, str) else line
    return c.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def classify(line: Column | str, rules: list[tuple[str, list[str]]], default: str = "other") -> Column:
    """Class of the first rule family that matches. Families are literal, so this is a plain
    conditional on the row and needs no join with a rule table."""
    out = None
    for name, patterns in rules:
        cond = matches_any(line, patterns)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(default)


DEPLOYMENT_RULES = [
    ("fatal", FATAL),
    ("migration", MIGRATION),
    ("benign", BENIGN),
    ("policy", POLICY),
    ("error", ERROR),
]


def run_verdict(lines: DataFrame, keys: list[str], pos: str, line: str) -> DataFrame:
    """Pass or fail per run, with the flags that ask for a later look.

    A failed deploy command is excused after an "already registered" line. Ordered logic is
    reduced to two minimum positions: any unexcused failure precedes the first flag, so the
    earliest one decides.
    """
    error = matches_any(line, ERROR)
    migration, benign = matches_any(line, MIGRATION), matches_any(line, BENIGN)
    excusable = matches_any(line, DEPLOY_FAILED)
    excused = migration | benign
    per_run = lines.groupBy(*keys).agg(
        F.bool_or(matches_any(line, FATAL)).alias("fatal"),
        F.bool_or(migration).alias("has_migration"),
        F.bool_or(matches_any(line, POLICY)).alias("has_policy"),
        F.count_if(error).alias("error_lines"),
        F.bool_or(error & ~excused & ~excusable).alias("__bad"),
        F.min(F.when(error & ~excused & excusable, F.col(pos))).alias("__deploy_failed"),
        F.min(F.when(error & ~migration & matches_any(line, REGISTERED), F.col(pos))).alias("__registered"),
    )
    unexcused = F.col("__deploy_failed").isNotNull() & F.coalesce(
        F.col("__deploy_failed") < F.col("__registered"), F.lit(True)
    )
    failed = F.coalesce(F.col("fatal") | F.col("__bad") | unexcused, F.lit(False))
    return per_run.withColumn("verdict", F.when(failed, "fail").otherwise("pass")).drop(
        "__bad", "__deploy_failed", "__registered"
    )
