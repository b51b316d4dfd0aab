"""Functions on markup: anchors, attributes and the resolution report section."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, percent_decode

# The addresses of the directory index. The question mark is itself, not a quantifier.
FILE_LINK = 'href="/api/access/datafile/'
FOLDER_LINK = 'href="/api/datasets/[0-9]*/dirindex/\\?.*folder='


def last_link_target(line: Column | str) -> Column:
    """Target of the last anchor on a line, empty when there is none."""
    return F.regexp_extract(_c(line), '.*href="([^"]*)"', 1)


def last_link_label(line: Column | str) -> Column:
    """Text before the last closing anchor tag, back to the nearest tag end."""
    return F.regexp_extract(_c(line), ".*>(.*)</a>", 1)


def is_file_link(line: Column | str) -> Column:
    return _c(line).contains(FILE_LINK)


def is_folder_link(line: Column | str) -> Column:
    return ~is_file_link(line) & _c(line).rlike(FOLDER_LINK)


def folder_of(line: Column | str) -> Column:
    """Decoded folder named by a folder link."""
    return percent_decode(F.regexp_extract(_c(line), '.*folder=([^"]*)"', 1))


def link_targets(html: Column | str) -> Column:
    """Targets of all anchors of a page, in order."""
    return F.regexp_extract_all(_c(html), F.lit('<a [^>]*href="([^"]*)"'), 1)


def link_labels(html: Column | str) -> Column:
    """Labels of all anchors of a page, in order; each tag with a target has one."""
    return F.regexp_extract_all(_c(html), F.lit('<a [^>]*href="[^"]*"[^>]*>([^<]*)</a>'), 1)


def attribute(col: Column | str, name: str) -> Column:
    """Value of the first ``name="…"``; empty when absent."""
    return F.regexp_extract(_c(col), rf'\b{name}="([^"]*)"', 1)


def inner_text(col: Column | str, tag: str) -> Column:
    """Text of the first element with this tag; empty when absent."""
    return F.regexp_extract(_c(col), f"<{tag}(?: [^>]*)?>([^<]*)</{tag}>", 1)


def account_section(html: Column | str, account: str) -> Column:
    """The second ordered list after the line naming the account; empty when absent.

    The first list of an account closes before its list of failures opens, so the section
    runs from the first opening tag behind that close up to the next closing tag.
    """
    pattern = rf"(?s)\Q{account}\E[^\n]*\n.*?</ol>[^\n]*\n.*?<ol>[^\n]*\n(.*?)</ol>"
    return F.regexp_extract(_c(html), pattern, 1)


def failure_items(html: Column | str, account: str) -> Column:
    """``array<struct<pid,hits>>`` of the account's unresolved identifiers, in report order. An anchor
    without a count two lines below is an error."""
    section = account_section(html, account)
    item = r'(?m)^<a [^"\n]*"[^"\n]*doi\.org/([^"\n]*)"[^\n]*\n[^\n]*\n[^(\n]*\(([^()\n]*)\)'
    anchors = F.regexp_extract_all(section, F.lit(r'(?m)^<a [^"\n]*"[^"\n]*doi\.org/'), 0)
    found = F.regexp_extract_all(section, F.lit(item), 1)
    failure = F.raise_error(F.lit("a failed identifier has no count")).cast("array<string>")
    pids = F.when(F.size(anchors) != F.size(found), failure).otherwise(found)
    hits = F.regexp_extract_all(section, F.lit(item), 2)
    return F.zip_with(
        pids,
        hits,
        lambda p, h: F.struct(F.concat(F.lit("doi:"), p).alias("pid"), F.trim(h).try_cast("bigint").alias("hits")),
    )
