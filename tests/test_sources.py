import gzip
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repolytics.functions.text import export_name
from repolytics.sources import readers as R
from repolytics.sources import splits
from repolytics.sources import writers as W

LOG = T.StructType([T.StructField(c, T.StringType()) for c in ("pid", "uri", "method", "ip", "time")])


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as f:
        f.write(text)
    return str(path)


def test_json_array_documents(spark, tmp_path):
    put(f"{tmp_path}/d/a.json", '[\n {"name": "b"},\n {"name": "A", "x": 1}\n]')
    put(f"{tmp_path}/d/b.json", "[]")
    got = R.read_json_rows(spark, f"{tmp_path}/d", "name string", multi_line=True)
    assert sorted(r[0] for r in got.collect()) == ["A", "b"]


def test_rows_at_missing_key(spark):
    df = spark.createDataFrame([(1, [("x",)]), (2, None), (3, [])], "t int, installations array<struct<name:string>>")
    assert R.rows_at(df, "installations").count() == 1
    assert R.rows_at(df, "installations", keep_parent=True).count() == 3


def test_tsv(spark, tmp_path):
    good = put(f"{tmp_path}/good.tsv", 'pid\turi\tmethod\tip\ttime\np"1\t/a\tGET\t1\t2024\n')
    assert [tuple(r) for r in R.read_tsv(spark, good, LOG).collect()] == [('p"1', "/a", "GET", "1", "2024")]
    header = put(f"{tmp_path}/header.tsv", "pid\turi\tmethod\tip\ttime\n")
    assert R.read_tsv(spark, header, LOG).count() == 0


@pytest.mark.parametrize("line", ["p\t/a\tGET\t1", "p\t/a\tGET\t1\t2024\textra"])
def test_ragged_tsv(spark, tmp_path, line):
    path = put(f"{tmp_path}/bad.tsv", f"pid\turi\tmethod\tip\ttime\nq\t/b\tGET\t2\t2024\n{line}\n")
    with pytest.raises(Exception):
        R.read_tsv(spark, path, LOG).collect()
    kept = R.read_tsv(spark, path, LOG, on_bad="quarantine").collect()
    assert sorted((r["pid"], r[R.CORRUPT]) for r in kept) == [("p", line), ("q", None)]


def test_gzip_documents_and_logs(spark, tmp_path):
    os.makedirs(f"{tmp_path}/g")
    with gzip.open(f"{tmp_path}/g/r.html.gz", "wt") as f:
        f.write("one\ntwo\n\nfour\n")
    docs = R.read_text_docs(spark, f"{tmp_path}/g")
    assert [(r["line_no"], r["line"]) for r in R.lines(docs, "path", "text").orderBy("line_no").collect()] == [
        (1, "one"),
        (2, "two"),
        (3, ""),
        (4, "four"),
    ]
    assert R.read_log(spark, f"{tmp_path}/g").count() == R.read_log(spark, f"{tmp_path}/g", ordered=True).count() == 4


def test_inventory(spark, tmp_path):
    put(f"{tmp_path}/n/a.nc", "12345")
    put(f"{tmp_path}/n/sub/b.nc", "1")
    put(f"{tmp_path}/n/c.txt", "1")
    files = R.file_inventory(spark, f"{tmp_path}/n", "*.nc", content=True)
    got = {os.path.basename(r["path"]): (r["length"], r["sha"]) for r in files.withColumn("sha", F.sha1("content")).collect()}
    assert got["a.nc"] == (5, "8cb2237d0679ca88db6464eac60da96345513964") and set(got) == {"a.nc", "b.nc"}
    assert R.file_inventory(spark, f"{tmp_path}/n", "*.none").count() == 0


def test_csv(spark, tmp_path):
    path = put(f"{tmp_path}/t.csv", "A,B,C\n1,2,3\n4,5,6\n")
    for df in (R.read_csv(spark, path), R.read_csv(spark, path, "A int, B int, C int")):
        assert [tuple(r) for r in df.orderBy("A").collect()] == [(1, 2, 3), (4, 5, 6)]


def test_dataset_rows_keep_any_text(spark, tmp_path):
    rows = [("1", 'a "quoted", title', "two\nlines", "é’–", "n", "https://x"), ("2", None, "d", "a", "n", None)]
    df = spark.createDataFrame(rows, R.DATASET_ROW)
    df.write.csv(f"{tmp_path}/rows", header=True, quote='"', escape='"')
    assert sorted(tuple(r) for r in R.read_dataset_rows(spark, f"{tmp_path}/rows").collect()) == rows


def test_documents_round_trip(spark, tmp_path):
    """Fragments come back as they were, and the files read in their order are the documents."""
    docs = {f"d{k}": [f'{{"n":"tab\\t{k}","l":[', *[f"{',' if i else ''}{i}" for i in range(k * 100)], "]}"] for k in range(6)}
    rows = [(name, i, text) for name, parts in docs.items() for i, text in enumerate(parts)]
    df = spark.createDataFrame(rows, "doc_name string, place bigint, fragment string").repartition(5)
    path = W.write_documents(df, f"{tmp_path}/docs", "doc_name")
    assert sorted(map(tuple, R_docs(spark, path))) == sorted(rows)
    files = sorted(f for f in os.listdir(path) if f.startswith("part-"))
    lines = [line.split("\t", 2) for f in files for line in open(f"{path}/{f}").read().splitlines()]
    for name, parts in docs.items():
        assert "".join(x[2] for x in lines if x[0] == name) == "".join(parts)
    small = spark.createDataFrame([("a_1", '{"x":"1"}'), ("b", '{"y":"tab\\t"}')], "doc_name string, document string")
    W.write_document_files(small, f"{tmp_path}/files", "doc_name", "document")
    assert {d for d in os.listdir(f"{tmp_path}/files") if d.startswith("doc_name=")} == {"doc_name=a_1", "doc_name=b"}


def test_documents_written_compressed(spark, tmp_path):
    """Compressed files hold the same lines in far fewer bytes, and no column but those of a line is needed."""
    rows = [(f"d{k}", i, f'{{"tab\\t":"{k}","contentUrl":"https://data.example.org/{i}"}}', k) for k in range(3) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_name string, place bigint, fragment string, other int").repartition(4)
    sizes = {}
    for kind in ("none", "gzip"):
        path = W.write_documents(df, f"{tmp_path}/{kind}", "doc_name", kind)
        assert sorted(map(tuple, R_docs(spark, path))) == sorted(r[:3] for r in rows)
        sizes[kind] = sum(os.path.getsize(f"{path}/{f}") for f in os.listdir(path) if f.startswith("part-"))
    assert sizes["gzip"] * 4 < sizes["none"]


def test_export_names_hold_the_time(spark):
    df = spark.sql("SELECT 'doi:10.5072/FK2/X' AS pid, TIMESTAMP_NTZ '2024-03-05 07:08:09' AS t")
    assert df.select(export_name("pid", "t")).first()[0] == "croissant_doi_10.5072_FK2_X_20240305_070809.json"


def R_docs(spark, path):
    return W.read_documents(spark, path).collect()


def test_snapshot(spark, tmp_path):
    df = spark.createDataFrame([("2024-01", 3), ("2024-02", None)], "month string, n bigint")
    path = W.write_snapshot(df, f"{tmp_path}/s")
    assert sorted(map(str, W.read_snapshot(spark, path, df.schema).collect())) == sorted(map(str, df.collect()))


@pytest.fixture
def small_splits(spark):
    """Files are cut every 40 bytes."""
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, "40")
    yield
    spark.conf.set(key, old)


@pytest.mark.parametrize("most", [splits.MOST_BLOCKS, 0])
def test_ordered_log_of_many_splits(spark, tmp_path, small_splits, monkeypatch, most):
    monkeypatch.setattr(splits, "MOST_BLOCKS", most)
    texts = {"a.log": [f"line {i} " + "x" * (i % 90) for i in range(300)], "b.log": ["", "one", ""], "c.log": ["y" * 500]}
    for name, lines in texts.items():
        put(f"{tmp_path}/logs/{name}", "\n".join(lines) + "\n")
    assert spark.read.text(f"{tmp_path}/logs/a.log").rdd.getNumPartitions() > 100
    got = R.read_log(spark, f"{tmp_path}/logs", ordered=True).collect()
    by = {}
    for r in got:
        by.setdefault(os.path.basename(r["path"]), []).append((r["line_no"], r["line"]))
    assert {k: sorted(v) for k, v in by.items()} == {k: list(enumerate(v, 1)) for k, v in texts.items()}


def test_ordered_log_reads_no_whole_file(spark, tmp_path):
    path = put(f"{tmp_path}/one.log", "a\nb\n")
    plan = R.read_log(spark, path, ordered=True)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    # the lines stay where they are read: only the rows of blocks are exchanged
    assert "wholetext" not in plan.lower() and "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def sheet(rows):
    cell = lambda v: "" if v is None else '"' + v.replace('"', '""') + '"'
    head = "row_key,title,description,agency,link_name,link_url"
    return "\n".join([head, *(",".join(map(cell, r)) for r in rows)]) + "\n"


def test_records_with_line_breaks_of_many_splits(spark, tmp_path, small_splits):
    cells = ["plain", 'say "this"', "two\nlines", '\n"\n\n', "a,b", None, 'odd " quote\nnext', "long\n" * 60, "é – ’"]
    rows = [tuple([str(i), *(cells[(i * k + k) % len(cells)] for k in range(1, 6))]) for i in range(200)]
    put(f"{tmp_path}/rows/a.csv", sheet(rows))
    put(f"{tmp_path}/rows/b.csv", sheet(rows[:1]))
    put(f"{tmp_path}/rows/c.csv", sheet([]))
    got = R.read_dataset_rows(spark, f"{tmp_path}/rows")
    whole = spark.read.schema(R.DATASET_ROW).csv(f"{tmp_path}/rows", header=True, quote='"', escape='"', multiLine=True)
    key = lambda r: tuple(v or "" for v in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(rows + rows[:1], key=key) == sorted(map(tuple, whole.collect()), key=key)


def test_windows_line_ends_and_open_quote(spark, tmp_path):
    path = put(f"{tmp_path}/w/w.csv", 'h1,h2,h3,h4,h5,h6\r\n1,"a\r\nb",c,d,e,f\r\n\r\n2,x,y,z,u,v\r\n')
    with open(path, newline="") as f:
        assert "\r\n" in f.read()
    assert sorted(tuple(r) for r in R.read_dataset_rows(spark, path).collect()) == [("1", "a\r\nb", "c", "d", "e", "f"), ("2", "x", "y", "z", "u", "v")]
    bad = put(f"{tmp_path}/bad/bad.csv", 'h1,h2,h3,h4,h5,h6\n1,"never,closed,c,d,e\n2,x,y,z,u,v\n')
    with pytest.raises(Exception, match="quote without end"):
        R.read_dataset_rows(spark, bad).collect()
