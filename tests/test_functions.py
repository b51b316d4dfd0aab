import datetime as dt

import pytest
from pyspark.sql import functions as F

from repolytics.functions import dates as D
from repolytics.functions import json as J
from repolytics.functions import markup as M
from repolytics.functions import numbers as N
from repolytics.functions import text as X


def value(spark, col, **row):
    df = spark.createDataFrame([tuple(row.values()) or (1,)], ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'bigint'}" for k, v in row.items()) or "one int")
    return df.select(col.alias("v")).first()["v"]


@pytest.mark.parametrize("raw, want", [(None, ""), ("it’s 1–2", "it's 1-2"), ("plain", "plain")])
def test_clean_cell(spark, raw, want):
    assert value(spark, X.clean_cell("c"), c=raw) == want


def test_clean_cell_of_number(spark):
    assert value(spark, X.clean_cell("c"), c=12) == "12"


@pytest.mark.parametrize("raw, want", [("a%20b", "a b"), ("a+b", "a+b"), ("%zz", "%zz"), ("caf%C3%A9", "café"), (None, None)])
def test_percent_decode(spark, raw, want):
    assert value(spark, X.percent_decode("c"), c=raw) == want


def test_names(spark):
    assert value(spark, X.file_name_of("c"), c="doi:10.5072/FK2/AB") == "doi_10.5072_FK2_AB"
    assert value(spark, X.folder_name_of("c"), c="doi:10.5072/FK2") == "doi:10.5072_FK2"
    assert value(spark, X.folder_name_of("c", "v"), c="a/b", v="1.2") == "a_b_1.2"
    assert value(spark, X.folder_name_of("c", "v"), c="a/b", v="") == "a_b"
    assert value(spark, X.safe_name("c"), c="ä b(1)_x-2.nc") == "b1_x-2.nc"
    assert value(spark, X.base_name("c"), c="/a/b/c.nc") == "c.nc"
    assert value(spark, X.base_name("c"), c="c.nc") == "c.nc"


def test_urls(spark):
    assert value(spark, X.landing_url("https://h", "c"), c="doi:1") == "https://h/dataset.xhtml?persistentId=doi:1"
    url = value(spark, X.export_url("https://h//", "c", "croissant"), c="doi:1")
    assert url == "https://h/api/datasets/export?exporter=croissant&persistentId=doi:1&version=:draft"


def test_anchor_needs_a_target(spark):
    assert value(spark, X.anchor("u", "l"), u="https://x", l="X") == '<a href="https://x">X</a>'
    assert value(spark, X.anchor("u", "l"), u="", l="X") is None
    assert value(spark, X.anchor("u", "l"), u=None, l="X") is None


def test_strip_unsafe(spark):
    assert value(spark, X.strip_unsafe("c"), c="a'b\\c;d\"") == 'abcd"'


@pytest.mark.parametrize(
    "raw, option, key",
    [
        ("", None, None),
        ("JDK versions: 17", None, None),
        ("-x JDK versions: 17", None, None),
        ("server", None, None),
        ("-Da=1 --> note", "-Da=1", "a"),
        ("-Da=b=c   ", "-Da=b=c", "a"),
        ("-Dflag", "-Dflag", "-Dflag"),
        ("-Xmx2g\t--> a --> b", "-Xmx2g", "-Xmx2g"),
        ("--> only a note", None, None),
        ("-", "-", "-"),
    ],
)
def test_options(spark, raw, option, key):
    assert value(spark, X.option_text("c"), c=raw) == option
    assert value(spark, X.option_key(X.option_text("c")), c=raw) == key


def test_quote_url_value(spark):
    assert value(spark, X.quote_url_value("c"), c="-Du=https://h/p") == "-Du='https://h/p'"
    assert value(spark, X.quote_url_value("c"), c="-Du=plain") == "-Du=plain"


def test_lines(spark):
    assert value(spark, X.lines_of("c"), c="a\n\nb\n") == ["a", "", "b"]
    assert value(spark, X.lines_of("c"), c="a\n\n") == ["a", ""]


def test_numbers_in_text(spark):
    text = "index of 12 collections and 340 datasets"
    assert value(spark, X.number_before("c", "collections"), c=text) == 12
    assert value(spark, X.number_before("c", "datasets"), c=text) == 340
    assert value(spark, X.number_before("c", "files"), c=text) is None


def test_rewrite_only_with_marker(spark):
    assert value(spark, X.rewrite("c", "a+", "x", marker="!"), c="aa!") == "x!"
    assert value(spark, X.rewrite("c", "a+", "x", marker="!"), c="aa") == "aa"


def test_last_anchor_of_a_line(spark):
    line = '<a href="/api/access/datafile/1">one</a> <a href="/api/access/datafile/2">two (b).txt</a>'
    assert value(spark, M.last_link_target("c"), c=line) == "/api/access/datafile/2"
    assert value(spark, M.last_link_label("c"), c=line) == "two (b).txt"
    assert value(spark, M.is_file_link("c"), c=line) is True
    folder = '<a href="/api/datasets/7/dirindex/?folder=sub%20dir%2Fx">sub</a>'
    assert value(spark, M.is_folder_link("c"), c=folder) is True
    assert value(spark, M.folder_of("c"), c=folder) == "sub dir/x"


REPORT = """<html>
<h3>ACME.REPO</h3>
<ol>
<a href="https://doi.org/10.1/ok">
ok</a>
(7)
</ol>
nested words
<ol>
<a href="https://doi.org/10.1/bad">
bad</a>
unresolved (12)
<a href="https://doi.org/10.1/worse">
worse</a>
unresolved (3)
</ol>
<h3>OTHER.REPO</h3>
<ol>
</ol>
<ol>
<a href="https://doi.org/10.2/other">
x</a>
(1)
</ol>
"""


def test_failure_items(spark):
    found = value(spark, M.failure_items("c", "ACME.REPO"), c=REPORT)
    assert [(i["pid"], i["hits"]) for i in found] == [("doi:10.1/bad", 12), ("doi:10.1/worse", 3)]
    assert value(spark, M.failure_items("c", "NOBODY"), c=REPORT) == []
    one_list = REPORT[: REPORT.index("nested words")]
    assert value(spark, M.failure_items("c", "ACME.REPO"), c=one_list) == []


def test_attributes(spark):
    tag = '<system-property description="d" name="a.b" value="v1"></system-property><title>T</title>'
    assert value(spark, M.attribute("c", "name"), c=tag) == "a.b"
    assert value(spark, M.attribute("c", "value"), c=tag) == "v1"
    assert value(spark, M.inner_text("c", "title"), c=tag) == "T"


@pytest.mark.parametrize(
    "raw, want", [("2025-03", dt.date(2025, 3, 1)), ("2025-3", dt.date(2025, 3, 1)), ("2025/03", None), ("2025-13", None), ("x", None)]
)
def test_parse_month(spark, raw, want):
    assert value(spark, D.parse_month("c"), c=raw) == want


def test_strict_parse_raises(spark):
    with pytest.raises(Exception, match="Invalid date format: nope"):
        value(spark, D.strict(D.parse_day("c"), "c", "YYYY-MM-DD"), c="nope")
    assert value(spark, D.strict(D.parse_day("c"), "c", "YYYY-MM-DD"), c=None) is None


def test_month_steps(spark):
    assert D.month_bounds("2024-12") == (dt.date(2024, 12, 1), dt.date(2025, 1, 1))
    assert value(spark, D.next_month(D.parse_day("c")), c="2024-12-31") == dt.date(2025, 1, 1)
    assert value(spark, D.previous_month_end(D.parse_day("c")), c="2024-03-31") == dt.date(2024, 2, 29)
    assert value(spark, D.parse_report_month("c"), c="02_2024") == dt.date(2024, 2, 1)
    months = D.months_between_inclusive(D.parse_day("a"), D.parse_day("b"))
    assert len(value(spark, months, a="2023-11-05", b="2024-02-01")) == 4
    assert value(spark, months, a="2024-03-05", b="2024-02-01") == []


@pytest.mark.parametrize("raw, want", [("12", 12), ("", 5), (None, 5), ("-1", 5), ("1 ", 5), ("12\n", 5), ("9" * 30, 5)])
def test_int_or(spark, raw, want):
    assert value(spark, N.int_or("c", 5), c=raw) == want


@pytest.mark.parametrize("now, base, growth, percent", [(107, 100, 7.0, 107), (1, 3, -66.6, 33), (2, 3, -33.3, 66), (5, 0, None, None)])
def test_percentages_cut(spark, now, base, growth, percent):
    assert value(spark, N.growth_percent("n", "b"), n=now, b=base) == growth
    assert value(spark, N.percent("n", "b"), n=now, b=base) == percent


@pytest.mark.parametrize("a, b, less", [("6.9", "6.10", True), ("6.10", "6.9", False), ("6.6", "6.6", False), ("6.6", "6.6.1", True), ("v5.14", "6.0", True)])
def test_versions(spark, a, b, less):
    assert value(spark, N.version_lt("a", "b"), a=a, b=b) is less


@pytest.mark.parametrize("v, p, want", [("6.6.1", "6.6", True), ("6.60", "6.6", False), ("6", "6.6", False)])
def test_version_prefix(spark, v, p, want):
    assert value(spark, N.version_has_prefix("v", "p"), v=v, p=p) is want


def test_json_paths(spark):
    doc = '{"a": {"b.c": 1}, "no": false, "nil": null}'
    assert value(spark, J.path("c", "a", "b.c"), c=doc) == "1"
    pick = J.first_of(J.path("c", "nil"), J.path("c", "no"), J.path("c", "a", "b.c"), default="d")
    assert value(spark, pick, c=doc) == "1"
    assert value(spark, J.first_of(J.path("c", "nil"), J.path("c", "no"), default="d"), c=doc) == "d"


def test_listing_lookup(spark):
    listing = '{"up.load.txt": {"dataFile": {"id": 42}}}'
    assert value(spark, J.listing_file_id("c", "up.load.txt"), c=listing) == 42
    assert value(spark, J.listing_file_id("c", "absent"), c=listing) is None


def test_registration_record(spark):
    record = J.registration_record(F.col("s"), F.col("n"), F.sha1(F.lit("x")), F.lit("m"), "d", "f", "Data")
    assert value(spark, record, s="s3://1", n="a.nc") == (
        '{"description":"d","directoryLabel":"f","categories":["Data"],"restrict":"false","storageIdentifier":"s3://1",'
        '"fileName":"a.nc","mimeType":"m","checksum":{"@type":"SHA-1","@value":"11f6ad8ec52a2984abaafd7c3b516503785c2072"}}'
    )


def test_term_hits(spark):
    assert value(spark, X.term_hits("c", ["The", "la"]), c="The cat, LA la; their the") == 4
