import datetime as dt
import gzip
import os
import random

import pytest
from pyspark.sql import functions as F

from repolytics.plans import backfill as B
from repolytics.plans.backfill import ResolutionBackfill, failure_lines


def report(items, other=()):
    def listed(rows):
        return "".join(f'<a href="https://doi.org/10.5072/{p}">\n{p}</a>\n({n})\n' for p, n in rows)

    def account(name, good, bad):
        return f"<h2>{name}</h2>\n<p>ok</p>\n<ol>\n{listed(good)}</ol>\n<p>failed</p>\n<ol>\n{listed(bad)}</ol>\n"

    return "<html>\n" + account("OTHER.ONE", other, other) + account("ACME.REPO", [("fine", 9)], items) + account("THIRD.X", [], other) + "</html>\n"


def put(folder, month, text):
    os.makedirs(folder, exist_ok=True)
    data = text if isinstance(text, bytes) else gzip.compress(text.encode())
    with open(f"{folder}/resolutions_{month}.html.gz", "wb") as f:
        f.write(data)


def job(spark, tmp_path):
    return ResolutionBackfill(spark, f"{tmp_path}/reports", f"{tmp_path}/home", "ACME.REPO", "https://h")


def shown(backfill):
    return sorted((str(r["report_month"]), r["pid"], r["hits"]) for r in backfill.failures().collect())


def test_second_call_continues_and_gaps_wait(spark, tmp_path):
    folder = f"{tmp_path}/reports"
    put(folder, "01_2024", report([("a", 3), ("b", 1)], [("z", 7)]))
    backfill = job(spark, tmp_path)
    # nothing recorded: only the last month is due, and its report is not there
    assert backfill.run(dt.date(2024, 3, 9)) == [] and backfill.last_done() is None and shown(backfill) == []
    assert backfill.message(dt.date(2024, 3, 9), []).endswith("02_2024")
    assert backfill.run(dt.date(2024, 2, 1)) == [dt.date(2024, 1, 1)] and backfill.last_done() == "01_2024"
    put(folder, "02_2024", report([("a", 4)]))
    put(folder, "04_2024", report([("never", 1)]))
    assert backfill.run(dt.date(2024, 6, 1)) == [dt.date(2024, 2, 1)]
    assert backfill.run(dt.date(2024, 6, 1)) == []
    assert backfill.message(dt.date(2024, 6, 1), []).endswith("03_2024")
    put(folder, "03_2024", report([]))
    # a new object, as in a new process, goes on from the saved state
    again = job(spark, tmp_path)
    assert again.run(dt.date(2024, 6, 1)) == [dt.date(2024, 3, 1), dt.date(2024, 4, 1)]
    assert shown(again) == [("2024-01-01", "doi:10.5072/a", 3), ("2024-01-01", "doi:10.5072/b", 1), ("2024-02-01", "doi:10.5072/a", 4), ("2024-04-01", "doi:10.5072/never", 1)]
    assert again.failures().first()["url"].startswith("https://h/dataset.xhtml?persistentId=doi:10.5072/")


@pytest.mark.parametrize("broken", [b"not gzip", report([("a", "")]), report([("a", 1)])[:-60] + "</ol>"])
def test_a_failed_month_is_not_recorded(spark, tmp_path, broken):
    folder = f"{tmp_path}/reports"
    put(folder, "01_2024", report([("a", 3)]))
    good = isinstance(broken, str) and "()" not in broken
    put(folder, "02_2024", broken)
    put(folder, "03_2024", report([("c", 5)]))
    backfill = job(spark, tmp_path)
    backfill.run(dt.date(2024, 2, 1))
    if good:
        assert len(backfill.run(dt.date(2024, 4, 1))) == 2
        return
    with pytest.raises(Exception):
        backfill.run(dt.date(2024, 4, 1))
    assert backfill.last_done() == "01_2024" and shown(backfill) == [("2024-01-01", "doi:10.5072/a", 3)]
    put(folder, "02_2024", report([("b", 2)]))
    assert backfill.run(dt.date(2024, 4, 1)) == [dt.date(2024, 2, 1), dt.date(2024, 3, 1)]
    assert [r[1:] for r in shown(backfill)] == [("doi:10.5072/a", 3), ("doi:10.5072/b", 2), ("doi:10.5072/c", 5)]


def test_sections_of_an_account_named_twice(spark):
    text = report([("a", 1)]) + report([("b", 2)]) + "ACME.REPO\n<ol></ol>\n<ol>\n<a href=\"https://doi.org/10.5072/open\">\nx</a>\n(1)\n"
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(text.split("\n"), 1)], "path string, line_no bigint, line string")
    # the last list is never closed and goes on to the end
    assert sorted((r["pid"], r["hits"]) for r in failure_lines(lines, "path", "ACME.REPO").collect()) == [("doi:10.5072/a", 1), ("doi:10.5072/b", 2), ("doi:10.5072/open", 1)]
    assert failure_lines(lines, "path", "NOBODY").count() == 0


def walked(lines, account):
    """Line by line: numbers of the anchors inside the account's failure lists."""
    step, found = 0, []
    for n, line in lines:
        if step == 3 and line.startswith("<a ") and "</ol>" not in line:
            found.append(n)
        move = (account in line, "</ol>" in line, "</ol>" not in line and "<ol>" in line, "</ol>" in line)[step]
        step = (step + 1) % 4 if move else step
    return found


@pytest.mark.parametrize("stretch", [3, 1024])
def test_lists_across_stretches(spark, monkeypatch, stretch):
    monkeypatch.setattr(B, "STRETCH", stretch)
    rng, pool = random.Random(5), ["ACME", "<ol>", "</ol>", "</ol><ol>", "ACME</ol>"] + ['<a href="https://doi.org/x">(1)'] * 3
    texts = {f: [(i, rng.choice(pool)) for i in range(1, 400)] for f in ("f", "g")}
    # one long list, closed far away
    texts["h"] = [(1, "ACME"), (2, "</ol>"), (3, "<ol>"), *[(i, pool[-1]) for i in range(4, 60)], (60, "</ol>"), (61, pool[-1]), (62, pool[-1])]
    # every anchor has a count two lines below
    lines = [(f, n, line if line.startswith("<a ") else line + "(7)") for f, text in texts.items() for n, line in [*text, (len(text) + 1, ""), (len(text) + 2, "")]]
    df = spark.createDataFrame(lines, "path string, line_no bigint, line string").repartition(5)
    got = sorted((r["path"], r["line_no"]) for r in failure_lines(df, "path", "ACME").collect())
    assert got == sorted((f, n) for f, text in texts.items() for n in walked(text, "ACME"))


def test_no_row_holds_all_lists_of_a_file(spark):
    text = report([("a", 1)], [("b", 2)]).split("\n")
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(text * 1000, 1)], "path string, line_no bigint, line string")
    assert failure_lines(lines, "path", "ACME.REPO").count() == 1000
    most = B.failed_sections(lines, "path", "ACME.REPO").agg(F.max(F.size("sections"))).first()[0]
    assert most < 100
