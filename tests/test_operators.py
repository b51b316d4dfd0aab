import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from repolytics.operators import aggregates as A
from repolytics.operators import documents as D
from repolytics.operators import filters as P
from repolytics.operators import fragments
from repolytics.operators import joins as J
from repolytics.operators import logs as L
from repolytics.operators import ordering as O
from repolytics.operators import projections as R
from repolytics.operators import sequence as S
from repolytics.operators import sets as T
from repolytics.operators.trees import expand_tree
from repolytics.plans import reports
from repolytics.plans.files import download_plan, registration_manifest


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_month_bounds_are_half_open(spark):
    days = ["2024-11-30 23:59:59", "2024-12-01 00:00:00", "2024-12-31 23:59:59", "2025-01-01 00:00:00"]
    df = spark.createDataFrame([(d,) for d in days], "d string").select(F.col("d").cast("timestamp_ntz").alias("ts"), "d")
    assert rows(P.in_month(df, "ts", "2024-12").select("d")) == [(days[1],), (days[2],)]


def test_bad_response_reasons(spark):
    df = spark.createDataFrame([("u", "OK"), ("", "OK"), (None, "OK"), ("null", "OK"), ("u", "ERROR"), ("u", None)], "v string, s string")
    good, bad = P.split_valid(df, P.bad_response("v", "s"))
    assert good.count() == 2
    assert sorted(r["reason"] for r in bad.collect()) == ["error", "missing", "missing", "missing"]


def test_empty_is_not_missing(spark):
    df = spark.createDataFrame([(1, []), (2, None), (3, [1])], "k int, a array<int>")
    assert rows(P.where_empty(df, "a").select("k")) == [(1,)]
    assert rows(A.empty_split(df, "a")) == [(1, 1)]


def test_expired_needs_whole_days(spark):
    df = spark.createDataFrame([("a_1", "2024-01-01 00:00:01"), ("a_2", "2024-01-01 00:00:00"), ("b", "2023-01-01 00:00:00")], "n string, t string")
    df = df.withColumn("t", F.col("t").cast("timestamp_ntz"))
    assert rows(P.expired(df, "t", 7, "n", "a\\_%", "2024-01-09 00:00:00").select("n")) == [("a_2",)]


def test_transferable(spark):
    files = [("a/x.txt", 10), ("a/x.tmp", 10), ("logs/x.txt", 10), ("a/big.txt", 3_000_000), ("catalogs/x.txt", 10)]
    df = spark.createDataFrame(files, "p string, n bigint")
    got = P.transferable(df, "p", "n", folders=P.INDEX_SKIPPED_FOLDERS)
    assert rows(got.select("p")) == [("a/x.txt",), ("catalogs/x.txt",)]


def test_allowed_values(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "f string")
    assert P.not_allowed(df, "f", ["a"]).count() == 2
    with pytest.raises(Exception, match="unknown f"):
        P.require_allowed(df, "f", ["a"]).collect()
    assert P.require_allowed(df.where("f = 'a'"), "f", ["a"]).count() == 1


def test_unpivot_takes_first_nested_entry(spark):
    df = spark.createDataFrame([(1, "A", [(5, "x"), (6, "y")]), (2, "B", [])], "id int, name string, metrics array<struct<n:int,t:string>>")
    got = rows(R.unpivot_record(df, ["id"], "metrics"))
    assert got == rows(spark.createDataFrame([(1, "name", "A"), (1, "n", "5"), (1, "t", "x"), (2, "name", "B"), (2, "n", None), (2, "t", None)], "id int, k string, v string"))


def test_denied_sources(spark):
    log = spark.createDataFrame([("p1", "x"), ("p1", "ok"), ("p2", "x"), ("p3", None)], "pid string, ip string")
    deny = spark.createDataFrame([("x",), ("x",)], "ip string")
    kept, dropped = J.exclude_denied(log, deny, "ip")
    assert rows(kept.select("pid")) == [("p1",), ("p3",)]
    assert rows(dropped) == [(2,)]
    assert J.exclude_denied(log, deny.where("false"), "ip")[0].count() == 4


def test_children_are_streamed_and_not_sorted(spark):
    """However many children a task has, they are not gathered for a sort; repeated and null keys count as ever."""
    parent = spark.createDataFrame([("x", 1), ("y", 2), ("z", 2), ("u", 3), ("n", None)], "p string, k int")
    child = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (4, "c"), (None, "d")], "k int, v string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = J.with_children(parent, child, "k")
        plan = both._jdf.queryExecution().executedPlan().toString()
        found = sorted(map(str, both.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and both.columns == ["k", "p", "v"]
    want = [(1, "x", "a"), (2, "y", "b"), (2, "y", "b"), (2, "z", "b"), (2, "z", "b"), (3, "u", None), (None, "n", None)]
    assert found == sorted(f"Row(k={k!r}, p={p!r}, v={v!r})" for k, p, v in want)


def test_with_children_keeps_childless(spark):
    parent = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    child = spark.createDataFrame([(1, "a"), (1, "b"), (9, "z")], "k int, c string")
    assert rows(J.with_children(parent, child, "k")) == [(1, "a"), (1, "b"), (2, None), (3, None)]


def test_coverage_and_levels(spark):
    parents = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "template int, parent int")
    blocks = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (1, "a")], "template int, block string")
    enabled = spark.createDataFrame([(10, "a"), (10, "a"), (12, "z")], "parent int, block string")
    got = {(r["parent"], r["block"]): r["status"] for r in J.coverage_matrix(parents, blocks, enabled, "template", "parent", "block").collect()}
    assert got == {(10, "a"): "ENABLED", (10, "b"): "MISSING", (11, "a"): "MISSING", (11, "b"): "MISSING", (12, "a"): "MISSING"}
    fields = blocks.distinct().withColumnRenamed("block", "field")
    overrides = spark.createDataFrame([(10, "a", False, True), (11, "b", None, True)], "parent int, field string, include boolean, required boolean")
    levels = {(r["parent"], r["field"]): (r["include"], r["required"]) for r in J.effective_levels(parents, fields, overrides, "template", "parent", "field").collect()}
    assert levels[(10, "a")] == (False, True) and levels[(11, "b")] == (True, True) and levels[(12, "a")] == (True, False)


def test_pending_needs_record_and_file(spark):
    items, manifest, present = (spark.createDataFrame([(k,) for k in ks], "f string") for ks in ("abcd", "abb", "ac"))
    assert rows(J.pending(items, manifest, present, "f")) == [("b",), ("c",), ("d",)]


def test_missing_options(spark):
    a = J.options_of(spark.createDataFrame([("-Da=1",), ("-Db=2 --> x",), ("-Dflag",), ("-Dfile.s3=1",), ("",)], "raw string"), "raw")
    b = J.options_of(spark.createDataFrame([("-Da=other",), ("-Dflagged",)], "raw string"), "raw")
    assert rows(J.missing_options(a, b, "s3|S3").select("option")) == [("-Db=2",), ("-Dflag",)]


def test_retype_and_rekey(spark):
    files = spark.createDataFrame([(1, "bin"), (2, "bin"), (3, "text")], "id int, kind string")
    names = spark.createDataFrame([(1, "a.vtt"), (1, "b.txt"), (2, "vtt"), (3, "c.vtt")], "id int, label string")
    assert rows(J.retype(files, names, "id", "kind", "label", "bin", "%.vtt", "text/vtt")) == [(1, "text/vtt"), (2, "bin"), (3, "text")]
    df = spark.createDataFrame([(1, 5, "HTTP://x"), (2, 5, "x"), (3, 6, "http"), (4, 5, None)], "id int, type int, v string")
    got = J.rekey(df, "type", 5, F.lit(6), F.col("v").ilike("http%"))
    assert rows(got.select("id", "type", "moved")) == [(1, 6, True), (2, 5, False), (3, 6, False), (4, 5, False)]


def test_as_of_day(spark):
    snaps = ["2024-01-01 00:00:00", "2024-01-02 00:00:00", "2024-01-02 23:59:59", "2024-01-03 00:00:00"]
    df = spark.createDataFrame(list(enumerate(snaps)), "i int, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    assert J.as_of(df, "t", "2024-01-02").first()["i"] == 2
    assert J.as_of(df, "t", "2023-12-31").count() == 0


def test_reconcile_parts_sum(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    b = spark.createDataFrame([(2,), (3,)], "k int")
    assert rows(J.reconcile(a, b, "k")) == [(1, 2, 0, "a_only"), (2, 1, 1, "both"), (3, 0, 1, "b_only")]


def test_checksums(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", "1")], "f string, actual string")
    expected = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "REPLACE_WITH_OFFICIAL_SHA")], "f string, wanted string")
    got = {r["f"]: r["status"] for r in J.verify_checksums(files, expected, "f", "actual", "wanted").collect()}
    assert got == {"a": "match", "b": "mismatch", "c": "unverified", "d": "absent"}


def test_known_digest(spark):
    text = "Hello, World!"
    assert spark.range(1).select(F.sha1(F.lit(text))).first()[0] == "0a0a9f2a6772942557ab5355d76af442f8f65e01"


def test_missing_required(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "x"), (3, None)], "g int, n string")
    assert rows(J.missing_required(df, "n", ["a", "b"], "g")) == [(2, "a"), (2, "b"), (3, "a"), (3, "b")]
    assert rows(J.has_all_required(df, "n", ["a", "b"])) == [(True,)]
    assert rows(J.has_all_required(df, "n", ["a", "zz"])) == [(False,)]


def test_table_diff(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "v string")
    b = spark.createDataFrame([("x",), ("z",), (None,)], "v string")
    assert rows(J.table_diff(a, b)) == [("x", "old", 1), ("y", "old", 1), ("z", "new", 1)]
    assert J.table_diff(a, a).count() == 0


def test_apply_changes(spark):
    df = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("nsS3x", "4")], "name string, content string")
    up = spark.createDataFrame([("a", "9"), ("b", ""), ("new", "n")], "name string, content string")
    got = J.apply_changes(df, "name", "content", up, ["c"], ["%S3%"])
    assert rows(got) == [("a", "9"), ("new", "n")]


def test_tree(spark):
    edges = spark.createDataFrame([("root", "a", "A"), ("a", "b", "B"), ("b", "c", "C"), ("x", "y", "Y")], "parent string, child string, name string")
    assert rows(expand_tree(edges, "root")) == [("a", 1, "A"), ("b", 2, "A/B"), ("c", 3, "A/B/C")]
    with pytest.raises(ValueError, match="cycle"):
        expand_tree(edges.union(spark.createDataFrame([("c", "a", "A")], edges.schema)), "root")
    assert expand_tree(edges, "nowhere").count() == 0


def deploy(spark, *lines):
    return spark.createDataFrame([("r", i, line) for i, line in enumerate(lines)], "run string, pos int, line string")


@pytest.mark.parametrize(
    "lines, verdict",
    [
        (["fine"], "pass"),
        (["ERROR: relation x already exists"], "pass"),
        (["some error"], "fail"),
        (["FATAL: boom"], "fail"),
        (["ERROR: column a does not exist"], "pass"),
        (["Command deploy failed", "Exception application a already registered"], "fail"),
        (["Exception application a already registered", "Command deploy failed"], "pass"),
        (["Command deploy failed", "Exception application a already registered", "Command deploy failed"], "fail"),
        (["application a already registered", "Command deploy failed"], "fail"),
    ],
)
def test_run_verdict(spark, lines, verdict):
    # the last case: a registration line without an error word is no error line and sets no flag
    assert L.run_verdict(deploy(spark, *lines), ["run"], "pos", "line").first()["verdict"] == verdict


def test_classify_takes_first_family(spark):
    df = deploy(spark, "table x does not exist", "relation already exists", "nothing")
    got = [r[0] for r in df.orderBy("pos").select(L.classify("line", L.DEPLOYMENT_RULES)).collect()]
    assert got == ["fatal", "benign", "other"]


def test_consistency_classes(spark):
    pairs = [("dataset", -1), ("dataset", 0), ("dataset", 2), ("collection", 0), ("collection", 1), ("collection", -1)]
    df = spark.createDataFrame(pairs, "kind string, d int")
    got = [r[0] for r in df.select(A.consistency_class(F.col("kind"), F.col("d"))).collect()]
    assert got == ["EXCELLENT", "PERFECT", "DISCREPANCY", "PERFECT", "MINOR", "DISCREPANCY"]


def test_baseline(spark):
    base = spark.createDataFrame([("a", 100), ("b", 100), ("c", 100), ("d", 0)], "m string, n bigint")
    now = spark.createDataFrame([("a", 95), ("b", 79), ("c", 121), ("d", 3)], "m string, n bigint")
    got = {r["m"]: (r["floor_ok"], r["range"], r["started"], r["percent_done"]) for r in A.compare_baseline(now, base, "m", "n").collect()}
    assert got["a"] == (True, "ok", True, 95)
    assert got["b"] == (False, "warning", True, 79)
    assert got["c"] == (True, "info", True, 121)
    assert got["d"][3] is None


USAGE = "uri string, performance array<struct<period: string, instance: array<struct<`metric-type`: string, count: bigint>>>>"


def test_usage(spark):
    report = spark.createDataFrame(
        [("a", [("p", [("v", 3), ("w", 9), ("v", None)])]), ("b", [("p", []), ("q", None)]), ("c", [])], USAGE
    )
    assert rows(A.usage_totals(report, "performance", "v")) == [(3, 2)]
    assert rows(A.usage_totals(report, "performance", "none")) == [(None, 0)]
    assert rows(A.usage_summary(report, "performance", "v")) == [(3, 2, 1, 1)]
    assert rows(A.usage_summary(report, "performance", "none")) == [(None, 0, 1, 1)]


def test_later_duplicates(spark):
    df = spark.createDataFrame([("k", 2), ("k", 1), ("k", 3), ("l", 9), (None, 4), (None, 5)], "k string, pos int")
    assert rows(S.later_duplicates(df, "k", ["pos"]).select("k", "pos")) == [("k", 2), ("k", 3)]


def test_context(spark):
    text = "\n".join(["a", "b", "HIT", "c", "d", "e", "f", "g", "HIT", "HIT"])
    df = spark.createDataFrame([(1, text)], "id int, text string")
    found = df.select(F.explode(S.context_of_text(F.col("text"), "HIT")).alias("c")).select("c.line_no")
    assert [r[0] for r in rows(found)] == sorted([1, 10, 2, 3, 4, 5, 7, 8, 9], key=lambda x: str((x,)))


def test_stable_target_and_change(spark):
    def series(*counts):
        start = dt.datetime(2024, 1, 1)
        return spark.createDataFrame([(1, start + dt.timedelta(seconds=i), c) for i, c in enumerate(counts)], "s int, ts timestamp_ntz, n bigint")

    def at(df, n, **kw):
        row = S.stable_at(df, ["s"], "ts", "n", n, **kw).first()
        return None if row is None else row["stable_ts"].second

    assert at(series(0, None, 5, 5, 5, 5), 3) == 5
    assert at(series(5, 5, 6, 6, 6), 3) is None
    assert at(series(1, 4, 9, 9), 3, target=9) == 2
    assert at(series(5, 5, 6, 6), 1) == 1
    assert at(series(5, 5, 6, 6), 1, after_change=True) == 3
    # a decrease does not start over when only increases do
    assert at(series(5, 5, 4, 4, 4), 3, reset="increase") == 4
    assert at(series(5, 5, 4, 4, 4), 3) is None


def test_contiguous_months(spark):
    days = [(1, "2023-11-03"), (1, "2023-12-30"), (1, "2023-12-01"), (1, "2024-02-01"), (2, "2024-05-05")]
    df = spark.createDataFrame(days, "k int, d string").withColumn("d", F.to_date("d"))
    assert rows(S.contiguous_months(df, ["k"], "d")) == [(1, "2023-11", "2023-12", 2, True), (2, "2024-05", "2024-05", 1, False)]


def test_current_state(spark):
    df = spark.createDataFrame([("a", 1, 1, "set"), ("a", 1, 2, "remove"), ("b", 5, 3, "running")], "k string, t int, id int, action string")
    assert rows(S.current_state(df, ["k"], ["t", "id"], "action")) == [("a", "remove", 2), ("b", "running", 1)]


def test_tail_order_matters(spark):
    df = spark.range(10)
    odd = F.col("id") % 2 == 1
    assert rows(O.tail_then(df, 3, odd, "id")) == [(7,), (9,)]
    assert rows(O.then_tail(df, odd, 3, "id")) == [(5,), (7,), (9,)]


def test_merge_fields(spark):
    schema = spark.createDataFrame([("swFunction", "t", False), ("sw", "t", False)], "name string, type string, multi_valued boolean")
    wanted = spark.createDataFrame([("swFunction", "t", False), ("swLanguage", "t", False)], schema.schema)
    assert rows(T.merge_fields(schema, wanted, ["swFunction"])) == [("sw", "t", False), ("swFunction", "t", True), ("swLanguage", "t", False)]


def test_validation(spark):
    df = spark.range(5)
    checks = [T.check(df, "a", "warning", F.col("id") > 3), T.check(df, "b", "error", F.col("id") > 9)]
    report = T.validation_report(checks)
    assert rows(report) == [("a", "warning", 1)]
    assert rows(T.validation_summary(report)) == [(0, 1, True)]


FULL = """{"datasetVersion":{"license":{"name":"CC0 1.0","uri":"u"},"metadataBlocks":{"citation":{"fields":[
{"typeName":"title","typeClass":"primitive","multiple":false,"value":"Gardener’s \\"Roses\\""},
{"typeName":"subject","typeClass":"controlledVocabulary","multiple":true,"value":["A","B"]},
{"typeName":"author","typeClass":"compound","multiple":true,"value":[{"authorName":{"typeName":"authorName","value":"Açores"}},{"authorName":{"value":"Two"},"authorAffiliation":{"value":"X"}}]},
{"typeName":"nothing","typeClass":"compound","multiple":true,"value":[]}]}}}}"""


def test_flatten_all_shapes(spark):
    df = spark.createDataFrame([(1, FULL)], "id int, doc string")
    assert rows(D.flatten_metadata(df, "id", "doc").drop("block", "type_class")) == sorted(
        [
            (1, "title", 0, None, 'Gardener’s "Roses"'),
            (1, "subject", 0, None, "A"),
            (1, "subject", 1, None, "B"),
            (1, "author", 0, "authorName", "Açores"),
            (1, "author", 1, "authorName", "Two"),
            (1, "author", 1, "authorAffiliation", "X"),
        ],
        key=str,
    )


def test_edit_replaces_and_adds(spark):
    base = D.flatten_metadata(spark.createDataFrame([(1, FULL)], "id int, doc string"), "id", "doc")
    body = '{"fields":[{"typeName":"title","value":"New"},{"typeName":"subject","value":["C"]},{"typeName":"subtitle","value":"s"}]}'
    edit = D.flatten_edit(spark.createDataFrame([(1, body)], "id int, body string"), "id", "body")
    merged = D.merge_edit(base, edit, "id")
    got = {(r["type_name"], r["idx"], r["subfield"]): (r["type_class"], r["value"]) for r in merged.collect()}
    assert got[("title", 0, None)] == ("primitive", "New")
    assert got[("subject", 0, None)] == ("controlledVocabulary", "C") and ("subject", 1, None) not in got
    assert got[("subtitle", 0, None)] == (None, "s")
    added = D.merge_edit(base, edit, "id", mode="add").where("type_name = 'subject'")
    assert rows(added.select("idx", "value")) == [(0, "A"), (1, "B"), (2, "C")]


FILE = "id int, `@id` string, contentSize string, contentUrl string, encodingFormat string, md5 string, name string"


def description_of(spark, n, long_series):
    datasets = spark.createDataFrame([(1, "n", "u", "1", "l", "k", "c"), (2, "m", "u", "1", "l", "k", "c")], "id int, name string, url string, version string, license string, keyword string, creator string")
    i = F.col("id")
    files = spark.range(n).select(F.lit(1).alias("id"), F.format_string("f%06d", i).alias("@id"), F.when(i > 0, i.cast("string")).otherwise("big").alias("contentSize"), F.lit("u").alias("contentUrl"), F.lit("text/plain; charset=x").alias("encodingFormat"), F.lit("m").alias("md5"), F.lit("n").alias("name"))
    orphan = spark.createDataFrame([(3, "x", "1", "u", "e", "m", "n")], FILE)
    return D.export_description(datasets, files.unionByName(orphan), "id", ["@id"], long_series)


@pytest.mark.parametrize("n, long_series", [(0, 10**6), (1, 10**6), (25, 10), (1001, 10**6), (1001, 100), (100_000, 20_000)])
def test_one_description_of_any_length(spark, n, long_series):
    docs = description_of(spark, n, long_series)
    parsed, back = D.parse_fragments(docs, "id")
    assert rows(parsed.select("id", "name", "n_files")) == [(1, "n", n), (2, "m", 0)]
    assert back.count() == n and rows(back.where("bytes is null").select("file_id")) == [("f000000",)][:n]
    whole = {r["id"]: json.loads(r["document"]) for r in fragments.whole_texts(docs, ["id"]).collect()}
    assert set(whole) == {1, 2} and [f["@id"] for f in whole[1]["distribution"]] == [f"f{i:06d}" for i in range(n)]
    assert whole[2]["distribution"] == [] and whole[1]["keywords"] == ["k"] and whole[1]["creator"] == [{"@type": "Person", "name": "c"}]
    assert sorted(r["place"] for r in docs.where("id = 1").collect()) == list(range(n + 2))
    # the same from whole documents
    parsed, back = D.parse_description(fragments.whole_texts(docs, ["id"]), "id", "document")
    assert rows(parsed.select("id", "n_files")) == [(1, n), (2, 0)] and back.count() == n


def test_joined_names(spark):
    df = spark.createDataFrame([(1, f"n{i:04d}") for i in range(1500)] * 2 + [(2, "b"), (2, None), (2, "a"), (None, "x")], "k int, name string")
    listed = fragments.whole_texts(A.joined_names(df, ["k"], "name", long_series=400), ["k"], "names")
    assert rows(listed) == [(1, ",".join(f"n{i:04d}" for i in range(1500))), (2, "a,b"), (None, "x")]


def test_failed_identifiers(spark):
    log = spark.createDataFrame(
        [("p1", "/a", "GET", "1", "2024-01-02"), ("p2", "/b", "GET", "2", "2024-01-01"), ("p1", "/c", "HEAD", "9", "2024-01-03"), ("p3", "/d", "GET", "9", "2024-01-04")],
        "pid string, uri string, method string, ip string, time string",
    )
    deny = spark.createDataFrame([("9",)], "ip string")
    report = reports.FailedIdentifiers(log, deny, "https://h")
    assert rows(report.ranked().select("rank", "pid", "hits")) == [(1, "p2", 1), (2, "p1", 1)]
    assert rows(report.details()) == [("p1", 1, "GET /a from 1 at 2024-01-02"), ("p2", 1, "GET /b from 2 at 2024-01-01")]
    assert rows(report.dropped()) == [(2,)] and report.message().count() == 0
    nothing = reports.FailedIdentifiers(log.where("ip = '9'"), deny, "https://h")
    assert nothing.ranked().count() == 0 and nothing.message().count() == 1


@pytest.mark.parametrize(
    "state, want",
    [("11_2023", ["2023-12-01", "2024-01-01"]), (None, []), ("02_2024", ["2024-03-01"]), ("01_2024", [])],
)
def test_due_months_stop_at_a_gap(spark, state, want):
    have = [dt.date(2023, 12, 1), dt.date(2024, 1, 1), dt.date(2024, 1, 1), dt.date(2024, 3, 1), dt.date(2022, 1, 1)]
    df = spark.createDataFrame([(d,) for d in have], "report_month date")
    due = reports.due_months(state, dt.date(2024, 5, 20), df)
    assert sorted(str(r[0]) for r in due.collect()) == want


def test_manifest_and_plan(spark):
    files = spark.createDataFrame([("/d/a.nc", "x"), ("/d/b.nc", "y"), ("/d/c.nc", "z")], "path string, content string")
    answers = spark.createDataFrame([("/d/a.nc", "s3://1", "OK"), ("/d/b.nc", "null", "OK")], "path string, storage string, status string")
    good, refused = registration_manifest(files, answers, "path", "content", "storage", "status")
    assert rows(good.select("file_name")) == [("a.nc",)]
    assert rows(refused) == [("/d/b.nc", "missing"), ("/d/c.nc", "missing")]
    entries, none = spark.createDataFrame([("a",), ("b",)], "target string"), spark.createDataFrame([], "target string")
    statuses = spark.createDataFrame([("a", 403)], "target string, status int")
    for ignore, action in ((True, "skip"), (False, "fail")):
        plan = download_plan(entries, none, none, statuses, "target", ignore)
        assert rows(plan.select("target", "action")) == [("a", action), ("b", "fetch")]
