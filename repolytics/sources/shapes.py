"""Repository shapes derived from plain tables by Spark.

They stand in for the inputs a repository delivers (usage reports, failure logs, catalog
tables, progress samples) and are used by the registered queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import bounded_lists
from ..session import materialize
from .readers import spread

PID_PREFIX = "doi:10.5072/"
BASE_URL = "https://data.example.org"


class Tables:
    """The given parquet tables of one folder, by attribute."""

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """A table about to meet heavy row-wise work: small ones use all cores."""
        return spread(getattr(self, name))


def iso(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def iso_day(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def failure_log(events: DataFrame) -> DataFrame:
    """Failed-identifier log: ``pid, uri, method, ip, time, pos``, ``pos`` being the place of a line
    among those of one moment."""
    return events.select(
        F.concat(F.lit(PID_PREFIX), F.get_json_object("props", "$.k")).alias("pid"),
        F.concat(F.lit("/dataset/"), F.col("event_id")).alias("uri"),
        F.col("event_type").alias("method"),
        F.col("user_id").cast("string").alias("ip"),
        F.col("ts").alias("time"),
        F.col("event_id").alias("pos"),
    )


def usage_report(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Usage records ``uri, dataset-title, performance`` of every order.

    The lines of an order form the instances of one performance entry, in parts of bounded
    size: an order of any size becomes several records (``part`` 0, 1, …) rather than one. An
    order without lines has one record with an empty instance list.
    """
    instance = F.struct(F.col("l_returnflag").alias("metric-type"), F.col("l_quantity").cast("bigint").alias("count"))
    slim_lines = lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", "l_quantity")
    lines = bounded_lists(slim_lines, ["o_orderkey"], [], instance, "instance")
    slim = orders.select("o_orderkey", "o_orderdate")
    without = slim.join(lines.select("o_orderkey").distinct(), "o_orderkey", "left_anti")
    empty = F.array().cast(lines.schema["instance"].dataType)
    rows = slim.join(lines, "o_orderkey").unionByName(without.withColumns({"part": F.lit(0), "instance": empty}))
    period = F.struct(
        F.date_format(F.trunc("o_orderdate", "month"), "yyyy-MM-dd").alias("begin-date"),
        F.date_format(F.last_day("o_orderdate"), "yyyy-MM-dd").alias("end-date"),
    )
    return rows.select(
        F.col("o_orderkey").cast("string").alias("uri"),
        F.concat(F.lit("Dataset "), F.col("o_orderkey")).alias("dataset-title"),
        F.array(F.struct(F.concat(F.lit(PID_PREFIX), F.col("o_orderkey")).alias("value"))).alias("dataset-id"),
        F.array(F.struct(period.alias("period"), F.col("instance"))).alias("performance"),
        "part",
    )


def report_headers(orders: DataFrame) -> DataFrame:
    """Usage report headers: one per order, ``id`` and the nested reporting period."""
    return orders.select(
        F.concat(F.lit("report-"), F.col("o_orderkey")).alias("id"),
        F.struct(
            F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("end-date")).alias("reporting-period")
        ).alias("report-header"),
    )


def shipped_pairs(lineitem: DataFrame, supplier: DataFrame, part: DataFrame) -> DataFrame:
    """First shipping time per (nation, brand). Lines shrink to (supplier, part) pairs before any join."""
    first = lineitem.groupBy("l_suppkey", "l_partkey").agg(F.min("l_shipdate").alias("first_ship"))
    return (
        first.join(part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
        .join(supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
        .groupBy("s_nationkey", "p_brand")
        .agg(F.min("first_ship").alias("first_ship"))
    )


def catalog(t: Tables, before: str) -> dict[str, DataFrame]:
    """Template catalog: templates are regions, parents their nations, blocks the brands shipped
    within the region, enabled pairs those shipped before a date."""
    # used for blocks and for enabled pairs: written once, so the lines are read once
    pairs = materialize(shipped_pairs(t.lineitem, t.supplier, t.part))
    parents = t.nation.select(
        F.col("n_regionkey").alias("template_id"), F.col("n_nationkey").alias("parent_id"), F.col("n_name").alias("parent_name")
    )
    keyed = pairs.withColumnRenamed("s_nationkey", "parent_id").withColumnRenamed("p_brand", "block")
    blocks = keyed.join(parents.select("template_id", "parent_id"), "parent_id").select("template_id", "block").distinct()
    enabled = keyed.where(F.col("first_ship") < F.lit(before).cast("timestamp_ntz")).select("parent_id", "block")
    return {"parents": parents, "blocks": blocks, "enabled": enabled}


def daily_counts(events: DataFrame) -> DataFrame:
    """Progress samples: events per user and day."""
    return events.groupBy(F.col("user_id").alias("series"), F.date_trunc("day", "ts").alias("ts")).agg(F.count("*").alias("doc_count"))


def state_events(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("key"),
        (F.get_json_object("props", "$.k").cast("int") % 5).alias("type"),
        F.col("event_type").alias("action"),
        "ts",
        "event_id",
    )


def folder_edges(region: DataFrame, nation: DataFrame, customer: DataFrame) -> DataFrame:
    """Folder table root → region → nation → customer."""
    def edge(df, parent, child, name):
        return df.select(parent.alias("parent"), child.alias("child"), name.alias("name"))

    r, n, c = (lambda k: F.concat(F.lit("r"), F.col(k))), (lambda k: F.concat(F.lit("n"), F.col(k))), (lambda k: F.concat(F.lit("c"), F.col(k)))
    return (
        edge(region, F.lit("root"), r("r_regionkey"), F.col("r_name"))
        .unionByName(edge(nation, r("n_regionkey"), n("n_nationkey"), F.col("n_name")))
        .unionByName(edge(customer, n("c_nationkey"), c("c_custkey"), F.col("c_name")))
    )


def folder_indexes(region: DataFrame, nation: DataFrame, customer: DataFrame) -> DataFrame:
    """Index lines ``folder, line``: regions and nations are folders, customers files."""
    def folder(df, parent, name):
        line = F.concat(F.lit('<a href="/api/datasets/1/dirindex/?folder='), F.replace(name, F.lit("_"), F.lit("%20")), F.lit('">'), name, F.lit("</a>"))
        return df.select(parent.alias("folder"), line.alias("line"))

    r = region.select("r_regionkey", "r_name")
    n = nation.join(r, nation["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", "n_name", "r_name")
    c = customer.select("c_custkey", "c_name", "c_nationkey").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    file = F.concat(F.lit('<a href="/api/access/datafile/'), F.col("c_custkey"), F.lit('">'), F.col("c_name"), F.lit(".txt</a>"))
    return (
        folder(r, F.lit(""), F.col("r_name"))
        .unionByName(folder(n, F.col("r_name"), F.col("n_name")))
        .unionByName(c.select(F.replace("n_name", F.lit("_"), F.lit(" ")).alias("folder"), file.alias("line")))
    )


def property_lines(part: DataFrame) -> DataFrame:
    """Lines of a server configuration; every fifth holds no property tag."""
    k = F.col("p_partkey")
    name = F.concat(F.when(k % 3 == 0, "storage.S3.").otherwise("site."), F.replace("p_name", F.lit(" "), F.lit(".")))
    tag = F.concat(F.lit('<system-property description="d" name="'), name, F.lit('" value="'), F.when(k % 4 == 0, "").otherwise(F.col("p_brand")), F.lit('"></system-property>'))
    return part.select("p_partkey", F.when(k % 5 == 0, F.concat(F.lit("<jvm-options>"), name)).otherwise(tag).alias("line"))


def dataset_rows(part: DataFrame, description: Column | str = "p_type") -> DataFrame:
    """Spreadsheet rows; only even parts have a link target."""
    return part.select(
        F.col("p_partkey").alias("row_key"),
        F.col("p_name").alias("title"),
        (F.col(description) if isinstance(description, str) else description).alias("description"),
        F.col("p_brand").alias("agency"),
        F.col("p_type").alias("link_name"),
        F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(f"{BASE_URL}/source/"), F.col("p_partkey"))).alias("link_url"),
    )


def launch_options(part: DataFrame) -> DataFrame:
    """Option listing lines: properties with comments, plain flags, blanks and version remarks."""
    k, name = F.col("p_partkey"), F.replace(F.col("p_name"), F.lit(" "), F.lit("."))
    raw = (
        F.when(k % 7 == 0, F.lit(""))
        .when(k % 7 == 1, F.concat(F.lit("JDK versions: "), F.col("p_size")))
        .when(k % 7 == 2, F.concat(F.lit("-XX:"), name, F.lit("  ")))
        .when(k % 7 == 3, F.concat(F.lit("-D"), name, F.lit("."), F.col("p_brand"), F.lit("=https://host/"), F.col("p_size")))
        .otherwise(F.concat(F.lit("-D"), name, F.lit("."), F.col("p_brand"), F.lit("="), F.col("p_size"), F.lit("   --> since "), k))
    )
    return part.select(F.col("p_partkey").alias("pos"), F.col("p_type").alias("listing"), raw.alias("raw"))


def deploy_log(events: DataFrame) -> DataFrame:
    """Deployment log lines of one run per user: ``run, pos, line``."""
    k = F.get_json_object("props", "$.k").cast("int")
    line = (
        F.when((F.col("event_type") == "error") & (k == 0), "FATAL: connection refused")
        .when((F.col("event_type") == "error") & (k < 60), F.concat(F.lit("PER01000: ERROR: relation t"), k, F.lit(" already exists")))
        .when(F.col("event_type") == "error", "ERROR: column displayoncreate does not exist")
        .when((F.col("event_type") == "purchase") & (k < 3), "remote failure: Command deploy failed")
        .when((F.col("event_type") == "signup") & (k < 30), "Exception: application with name app is already registered")
        .when((F.col("event_type") == "click") & (k == 7), "Failed to load default.policy")
        .otherwise(F.concat(F.lit("INFO: step "), k))
    )
    return events.select(F.col("user_id").alias("run"), F.col("event_id").alias("pos"), line.alias("line"))


def index_fields(part: DataFrame) -> DataFrame:
    """Index field table with one field per distinct part name."""
    return part.groupBy(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")).alias("name")).agg(
        F.lit("text_general").alias("type"), (F.min("p_size") % 2 == 0).alias("multi_valued")
    )


def link_lines(pages: DataFrame) -> DataFrame:
    """Anchors of each page as index lines: ``page_id, line_no, line``; every third is a folder."""
    anchors = F.regexp_extract_all("html", F.lit('<a [^>]*href="[^"]*"[^>]*>[^<]*</a>'), 0)
    a = pages.select("page_id", F.posexplode(anchors).alias("i", "tag"))
    label = F.regexp_extract("tag", ">([^<]*)</a>", 1)
    line = F.when(
        F.col("i") % 3 == 2,
        F.concat(F.lit('<a href="/api/datasets/'), F.col("page_id"), F.lit("/dirindex/?folder=dir%20"), F.col("i"), F.lit('">'), label, F.lit("</a>")),
    ).otherwise(F.concat(F.lit('<li><a href="/api/access/datafile/'), F.col("page_id") * 1000 + F.col("i"), F.lit('">'), label, F.lit("</a></li>")))
    return a.select("page_id", (F.col("i") + 1).alias("line_no"), line.alias("line"))


def resolution_reports(pages: DataFrame) -> DataFrame:
    """Resolution report pages ``report_month, html``: each anchor of a page is a failed identifier.

    Built inside the row: a report has a heading with the account, a first list (resolved) and
    a second list (failed) with the count two lines below each anchor.
    """
    anchors = F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), 1)
    item = F.array_join(
        F.transform(
            anchors,
            lambda a, i: F.concat(
                F.lit('<a href="https://doi.org/10.5072/'),
                F.col("page_id") * 1000 + i,
                F.lit('">\nlink</a>\n('),
                i * 3 + F.col("page_id") % 5,
                F.lit(")\n"),
            ),
        ),
        "",
    )
    html = F.concat(
        F.lit("<h2>ACME.REPO</h2>\n<p>resolved</p>\n<ol>\n<a href=\"https://doi.org/10.5072/ok\">\nok</a>\n(9)\n</ol>\n<p>failed</p>\n<ol>\n"),
        item,
        F.lit("</ol>\n<h2>OTHER.REPO</h2>\n<ol>\n</ol>\n<ol>\n<a href=\"https://doi.org/10.5072/other\">\nx</a>\n(1)\n</ol>\n"),
    )
    return pages.select(
        "page_id", F.add_months(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 7).cast("int")).alias("report_month"), html.alias("html")
    )


# what descriptions are made of besides the order's key
DATASET_SOURCE = ["o_custkey", "o_orderpriority"]
FILE_SOURCE = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag"]


def description_columns(key: str = "o_orderkey") -> tuple[dict[str, Column], dict[str, Column]]:
    """Columns of dataset rows and of file rows for dataset descriptions, made of those of orders and lines."""
    pid = F.concat(F.lit("10.5072/"), F.col(key))
    dataset = {
        "name": F.concat(F.lit("Order "), F.col(key)),
        "url": F.concat(F.lit("https://doi.org/"), pid),
        "version": F.lit("1.0"),
        "license": F.lit("http://creativecommons.org/publicdomain/zero/1.0"),
        "keyword": F.col("o_orderpriority"),
        "creator": F.concat(F.lit("Customer, "), F.col("o_custkey")),
    }
    name = F.concat(F.col("l_linenumber"), F.lit("-"), F.col("l_partkey"), F.lit("-"), F.col("l_suppkey"))
    file = {
        "@id": name,
        "contentSize": F.col("l_quantity").cast("bigint").cast("string"),
        "contentUrl": F.concat(F.lit(f"{BASE_URL}/api/access/datafile/"), F.col("l_partkey")),
        "encodingFormat": F.when(F.col("l_returnflag") == "R", "text/plain; charset=US-ASCII").otherwise("application/dbf"),
        "md5": F.md5(name),
        "name": name,
    }
    return dataset, file


def description_ties() -> list[Column]:
    """What sorts an order's files of the same name and size as their texts do: the address, missing ones behind the
    others, and the encoding."""
    plain = F.col("l_returnflag") == "R"
    return [F.col("l_partkey").isNull(), F.col("l_partkey").cast("string"), F.coalesce(plain, F.lit(False))]


def description_tables(orders: DataFrame, lineitem: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dataset rows and file rows for dataset descriptions."""
    dataset, file = description_columns()
    datasets = orders.select("o_orderkey", *[c.alias(n) for n, c in dataset.items()])
    files = lineitem.select(F.col("l_orderkey").alias("o_orderkey"), *[c.alias(n) for n, c in file.items()])
    return datasets, files


def description_sources(orders: DataFrame, lineitem: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The columns that ``description_columns`` is made of, with the key of the order."""
    return orders.select("o_orderkey", *DATASET_SOURCE), lineitem.select(F.col("l_orderkey").alias("o_orderkey"), *FILE_SOURCE)


def upload_files(documents: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Uploaded files (path, content) and the upload responses (path, storage, status) for them."""
    path = F.concat(F.lit("/upload/"), F.col("source"), F.lit("/"), F.col("doc_id"), F.lit(".nc"))
    files = documents.select("doc_id", path.alias("path"), F.col("text").alias("content"))
    responses = labels.select(
        "doc_id",
        F.when(F.col("quality") == 0, "null").otherwise(F.concat(F.lit("s3://bucket:"), F.col("doc_id"))).alias("storage"),
        F.when(F.col("toxic") == 1, "ERROR").otherwise("OK").alias("status"),
    )
    return files, responses
