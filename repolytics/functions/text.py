"""Text functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The typographic characters cleaned from cells and their plain forms.
TYPOGRAPHIC = "’–"
PLAIN = "'-"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clean_cell(col: Column | str) -> Column:
    """Cell text: null becomes empty, typographic quote and dash become plain, the rest is cast."""
    return F.coalesce(F.translate(_c(col).cast("string"), TYPOGRAPHIC, PLAIN), F.lit(""))


def file_name_of(pid: Column | str) -> Column:
    """Identifier as a file name: colon and slash become underscores."""
    return F.translate(_c(pid), ":/", "__")


def export_name(pid: Column | str, time: Column | str, prefix: str = "croissant") -> Column:
    """File name of an export: prefix, identifier and the time to the second."""
    return F.concat(F.lit(f"{prefix}_"), file_name_of(pid), F.lit("_"), F.date_format(_c(time), "yyyyMMdd_HHmmss"), F.lit(".json"))


def folder_name_of(pid: Column | str, version: Column | str | None = None) -> Column:
    """Identifier as a folder name: only slashes change; a version is appended when given."""
    name = F.translate(_c(pid), "/", "_")
    return name if version is None else F.concat_ws("_", name, F.nullif(_c(version), F.lit("")))


def landing_url(base: Column | str, pid: Column | str) -> Column:
    base = F.lit(base) if isinstance(base, str) else base
    return F.concat(base, F.lit("/dataset.xhtml?persistentId="), _c(pid))


def export_url(base: Column | str, pid: Column | str, exporter: str) -> Column:
    """Export address of a draft; slashes at the end of the base are dropped."""
    base = F.lit(base) if isinstance(base, str) else base
    return F.concat(
        F.regexp_replace(base, "/+$", ""),
        F.lit(f"/api/datasets/export?exporter={exporter}&persistentId="),
        _c(pid),
        F.lit("&version=:draft"),
    )


def percent_decode(col: Column | str) -> Column:
    """Percent-decode; a plus stays a plus, undecodable text is returned unchanged."""
    c = _c(col)
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def safe_name(col: Column | str) -> Column:
    """Keep ASCII letters, digits, dot, underscore and hyphen."""
    return F.regexp_replace(_c(col), "[^A-Za-z0-9._-]", "")


def base_name(col: Column | str) -> Column:
    """Last part of a path; slashes at the end do not count."""
    return F.substring_index(F.regexp_replace(_c(col), "/+$", ""), "/", -1)


def anchor(url: Column | str, label: Column | str) -> Column:
    """An anchor tag when there is a target, else null."""
    u = _c(url)
    return F.when(
        u.isNotNull() & (u != ""),
        F.concat(F.lit('<a href="'), u, F.lit('">'), F.coalesce(_c(label), F.lit("")), F.lit("</a>")),
    )


def strip_unsafe(col: Column | str) -> Column:
    """Drop single quotes, backslashes and semicolons."""
    return F.translate(_c(col), "'\\;", "")


def number_before(col: Column | str, word: str) -> Column:
    """The integer written before ``word``; null when absent."""
    return F.regexp_extract(_c(col), rf"([0-9]+) {word}", 1).try_cast("bigint")


def number_after(col: Column | str, prefix: str) -> Column:
    """The integer written right after the literal ``prefix``; null when absent."""
    return F.regexp_extract(_c(col), rf"\Q{prefix}\E([0-9]+)", 1).try_cast("bigint")


def rewrite(col: Column | str, pattern: str, replacement: str, marker: str | None = None) -> Column:
    """Replace a pattern, only in texts that hold ``marker`` when one is given."""
    c = _c(col)
    new = F.regexp_replace(c, pattern, replacement)
    return new if marker is None else F.when(c.contains(marker), new).otherwise(c)


def lines_of(col: Column | str) -> Column:
    """Lines of a text. A line break at the very end opens no further line."""
    return F.split(F.regexp_replace(_c(col), r"\n\z", ""), "\n", -1)


# --- launch options ------------------------------------------------------------------------


def option_text(col: Column | str) -> Column:
    """Option without trailing comment and blanks; null for lines that are no option.

    One expression that names the input once: a line must start with a dash, be more than a
    comment and hold no version remark; the option ends before the first ``-->``.
    """
    return F.nullif(F.regexp_extract(_c(col), r"^(?!-->)(?!.*JDK versions:)(-.*?)\s*(?:-->.*)?$", 1), F.lit(""))


def option_key(col: Column | str) -> Column:
    """Property name of ``-Dname=value``; other options are their own key."""
    c = _c(col)
    return F.coalesce(F.nullif(F.regexp_extract(c, "^-D([^=]+)=", 1), F.lit("")), c)


def is_property(col: Column | str) -> Column:
    return _c(col).rlike("^-D[^=]+=")


def quote_url_value(col: Column | str) -> Column:
    """Put quotes around the value of a property that holds a web address."""
    return F.regexp_replace(_c(col), "^-D([^=]+)=(.*https?://.*)$", "-D$1='$2'")


# --- keyword search ------------------------------------------------------------------------


def term_hits(col: Column | str, terms: list[str]) -> Column:
    """How often the given words occur in a text, compared without case."""
    words = F.split(F.lower(_c(col)), r"[^\p{L}\p{N}]+")
    wanted = [t.lower() for t in terms]
    return F.size(F.filter(words, lambda w: w.isin(wanted))).cast("bigint")
