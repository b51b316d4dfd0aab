"""Quotation linking: who answers whom, from the quoted lines of messages.

Every line starting with one or more ``>`` is quoted, as many levels deep as it has marks. Level 0 is
a message's own text. Each line is a passage, and so is each paragraph (neighbouring lines of one
level without a blank one between). Passages are normalised (lower case, letters and digits only) and
hashed: a trimmed quote meets its source by its lines, a reflowed one by its paragraphs, and quotes
between answers count like any others.

A quoted passage belongs to the latest message of its thread before the quoting one that holds the passage as
its own. Its words are votes for that message. A message answers the message with most votes at its shallowest level
that has any, the later one among several; without votes it opens a branch of its own.
Conversations are rebuilt in reply order, depth first, without quotes.

Only DataFrame functions are used. The latest holder of a passage is a running value over the
holders and quoters of that passage, so no pairs are built, however many messages repeat it. Depths, roots,
sizes of branches and places come from pointer doubling over numbers: a thread of any
depth takes a logarithmic number of joins, of the messages that are that deep, and no row holds its ancestors.

Defined results: null or empty texts keep their place with an empty body; a null thread groups the
messages without one; messages of one position follow one another as the table is read; repeated rows are
messages of their own; very long messages are cut inside their row; an empty table gives an empty
result; columns of any name may be present.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import OrderedSeries, Running
from .shared import release, written

_MARKS = r"^(\s*>)+ ?"


def level(line: Column) -> Column:
    """Number of ``>`` before the text of a line."""
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 0), "[^>]", ""))


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _lines(text: Column) -> Column:
    """Lines of a text in order: ``level, body`` (marks taken off), ``norm``."""

    def line(x: Column) -> Column:
        body = F.regexp_replace(x, _MARKS, "")
        return F.struct(level(x).alias("level"), body.alias("body"), normalised(body).alias("norm"))

    return F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), line)


def _paragraphs() -> Column:
    """Paragraphs of more than one line: ``level, norm``."""
    at = lambda i: F.get("__lines", i)

    def starts(i: Column) -> Column:
        before = at(F.greatest(i - 1, F.lit(0)))
        return (i == 0) | (before["level"] != at(i)["level"]) | (before["norm"] == "") | (at(i)["norm"] == "")

    first = F.filter(F.sequence(F.lit(0), F.size("__lines") - 1), starts)
    # as the variable of an outer function the starts are found once
    def cut(s: Column) -> Column:
        return F.transform(s, lambda a, k: F.slice("__lines", a + 1, F.coalesce(F.get(s, k + 1), F.size("__lines")) - a))

    runs = F.filter(F.transform(F.array(first), cut)[0], lambda run: F.size(run) > 1)
    return F.transform(runs, lambda run: F.struct(run[0]["level"].alias("level"), F.array_join(F.transform(run, lambda x: x["norm"]), " ").alias("norm")))


def read_messages(messages: DataFrame, thread: str, position: str, text: str) -> DataFrame:
    """``m, thread, position, body, passages``: every message with a number, its own text, and its
    distinct passages ``level, norm``."""
    slim = messages.select(F.col(f"`{thread}`").alias("thread"), F.col(f"`{position}`").alias("position"), F.col(f"`{text}`").alias("text"))
    cut = slim.select(F.monotonically_increasing_id().alias("m"), "thread", "position", _lines(F.col("text")).alias("__lines"))
    own = F.array_join(F.transform(F.filter("__lines", lambda x: x["level"] == 0), lambda x: x["body"]), "\n")
    single = F.transform("__lines", lambda x: F.struct(x["level"].alias("level"), x["norm"].alias("norm")))
    passages = F.filter(F.array_distinct(F.concat(single, _paragraphs())), lambda p: p["norm"] != "")
    return written(cut.select("m", "thread", "position", F.regexp_replace(own, r"^\s+|\s+$", "").alias("body"), passages.alias("passages")), "quotes")


def link(rows: DataFrame) -> DataFrame:
    """``m, source`` (position and number of the message answered) of messages with a resolved quote."""
    parts = rows.select("m", "thread", "position", F.explode("passages").alias("p")).select(
        "m", "thread", "position", F.col("p.level").alias("level"), F.unhex(F.sha2("p.norm", 256)).alias("key"), F.size(F.split("p.norm", " ")).alias("words")
    )
    # a message's quotes are looked up before its own passages count
    ordered = parts.withColumn("owner", (F.col("level") == 0).cast("int"))
    holder = Running("last", F.when(F.col("owner") == 1, F.struct("position", "m")), before=True)
    found = OrderedSeries.of(ordered, ["thread", "key"], ["position", "m", "owner"]).add({"source": holder}).result()
    votes = found.where("owner = 0 and source is not null").groupBy("m", "level", "source").agg(F.sum("words").alias("words"))
    best = votes.groupBy("m").agg(F.max(F.struct((-F.col("level")).alias("l"), "words", "source")).alias("b"))
    return best.select("m", "b.source")


def _tree(linked: DataFrame) -> DataFrame:
    """``m, depth, root, size`` of messages ``m, position, source``; ``size`` counts the branch below and itself.

    Only messages with an ancestor 2^k steps above take part in round k; the others are settled.
    """
    own = F.struct("position", "m")
    up = F.col("source.m")
    start = linked.select("m", up.alias("up"), up.isNotNull().cast("bigint").alias("depth"), F.coalesce("source", own).alias("root"), F.lit(1).cast("bigint").alias("size"))
    settled, counts = start.where("up is null"), linked.select("m", F.lit(1).cast("bigint").alias("size"))
    now = written(start.where("up is not null"), "quotes")
    while not now.isEmpty():
        # ``size`` counts what is less than 2^k steps below: it is news to the ancestor
        below = written(now.groupBy(F.col("up").alias("m")).agg(F.sum("size").alias("size")), "quotes")
        counts = counts.unionByName(below)
        state = now.select("m", "up", "depth", "root").unionByName(settled.select("m", "up", "depth", "root"))
        above = state.select(F.col("m").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("root").alias("root2"))
        grown = now.join(below.withColumnRenamed("size", "more"), "m", "left").withColumn("size", F.col("size") + F.coalesce("more", F.lit(0)))
        after = grown.join(above, "up").select("m", F.col("up2").alias("up"), (F.col("depth") + F.col("depth2")).alias("depth"), F.col("root2").alias("root"), "size")
        after = written(after, "quotes")
        settled = settled.unionByName(after.where("up is null"))
        release(now)
        now = written(after.where("up is not null"), "quotes")
    sizes = counts.groupBy("m").agg(F.sum("size").alias("size"))
    return settled.drop("up", "size").join(sizes, "m")


def _places(sized: DataFrame) -> DataFrame:
    """``m, place``: the depth-first place in its thread of messages ``m, thread, position, source, size``.

    A message stands behind its parent and the branches of its earlier siblings: the steps from the root
    down to it add up.
    """
    siblings = sized.select("m", "thread", "position", F.col("source.m").alias("up"), "size")
    before = OrderedSeries.of(siblings, ["thread", "up"], ["position", "m"]).add({"before": Running("sum", F.col("size"), before=True)}).result()
    start = written(before.select("m", "up", (F.coalesce("before", F.lit(0)) + F.col("up").isNotNull().cast("bigint")).alias("place")), "quotes")
    settled, now = start.where("up is null"), start.where("up is not null")
    while not now.isEmpty():
        above = now.unionByName(settled).select(F.col("m").alias("up"), F.col("up").alias("up2"), F.col("place").alias("place2"))
        after = written(now.join(above, "up").select("m", F.col("up2").alias("up"), (F.col("place") + F.col("place2")).alias("place")), "quotes")
        settled, now = settled.unionByName(after.where("up is null")), after.where("up is not null")
    return settled.drop("up")


def conversations(messages: DataFrame, thread: str, position: str, text: str) -> DataFrame:
    """``thread, position, body, reply_to, depth, root, reply_order`` of every message.

    ``reply_to`` and ``root`` are positions; ``reply_order`` counts messages depth first from 0
    within a thread.
    """
    rows = read_messages(messages, thread, position, text)
    linked = written(rows.select("m", "thread", "position").join(link(rows), "m", "left"), "quotes")
    sized = written(linked.join(_tree(linked), "m"), "quotes")
    out = rows.select("m", "body").join(sized, "m").join(_places(sized), "m")
    return out.select("thread", "position", "body", F.col("source.position").alias("reply_to"), "depth", F.col("root.position").alias("root"), F.col("place").alias("reply_order"))
