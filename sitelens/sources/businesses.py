"""Target lists: CSV files, explicit addresses, and their reject reports."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelens import fixed
from sitelens.functions.urls import canonical_domain, normalize_url
from sitelens.session import written

MOST_LINES = 1000  # of one record


def detect_roles(headers: list[str]) -> dict[str, str]:
    """Which column is the domain, name, city and country: an exact header
    first, then one that contains a known word."""
    lowered = {h.strip().lower(): h for h in headers}
    roles = {}
    for role, words in (("domain", fixed.CSV_DOMAIN_HEADERS), ("name", fixed.CSV_NAME_HEADERS),
                        ("city", fixed.CSV_CITY_HEADERS), ("country", fixed.CSV_COUNTRY_HEADERS)):
        exact = [lowered[w] for w in words if w in lowered]
        inside = [h for low, h in lowered.items() if any(w in low for w in words)]
        if exact or inside:
            roles[role] = (exact or inside)[0]
    return roles


def sniff_delimiter(header: str) -> str:
    """The known delimiter that splits the header line most often."""
    return max(fixed.CSV_DELIMITERS, key=lambda d: (header.count(d), -fixed.CSV_DELIMITERS.index(d)))


def numbered_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, record, n_lines) of CSV files: number 0 is the header of each file.

    Files are read in splits, in any number of tasks. What a split has to know of the ones
    before it are two sums: how many quotes they hold (an odd number means that it begins
    inside a cell) and how many records begin in them. Both are added up from one row per
    split. Blank lines between records do not count. A record of more than MOST_LINES lines
    has lost a closing quote; its first line stands for it.
    """
    found = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    lines = written(found.withColumn("quotes", F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))), "lines")
    within = Window.partitionBy("file", "split").orderBy("at")
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))

    def of_earlier_splits(frame: DataFrame, column: str) -> DataFrame:
        totals = frame.groupBy("file", "split").agg(F.sum(column).alias("total"))
        order = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
        return totals.select("file", "split", zero(F.sum("total").over(order)).alias("earlier"))

    inside = (F.col("earlier") + zero(F.sum("quotes").over(before))) % 2 == 1
    quoted = lines.join(of_earlier_splits(lines, "quotes"), ["file", "split"]).withColumn("inside", inside).drop("earlier")
    starts = written(quoted.where(F.col("inside") | (F.trim("line") != "")).withColumn(
        "starts", F.when(F.col("inside"), 0).otherwise(1)), "starts")
    numbered = starts.join(of_earlier_splits(starts, "starts"), ["file", "split"]).select(
        "file", "split", "at", "line", (F.col("earlier") + F.sum("starts").over(within) - 1).alias("number"))
    place = F.struct("split", "at")
    records = numbered.groupBy("file", "number").agg(F.min_by("line", place).alias("first"), F.count(F.lit(1)).alias("n_lines"))
    # nearly all records are a line; only the others are put together
    several = numbered.join(records.where(f"n_lines BETWEEN 2 AND {MOST_LINES}").select("file", "number"), ["file", "number"])
    whole = several.groupBy("file", "number").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("split", "at", "line"))), lambda x: x["line"]), "\n").alias("whole"))
    return records.join(whole, ["file", "number"], "left").select(
        "file", "number", F.regexp_replace(F.coalesce("whole", "first"), "^\ufeff", "").alias("record"), "n_lines")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Text columns of a CSV file, or of a folder of them in the order of their names, plus
    ``row_no``, the 1-based number of the record, and ``broken``, its lines where a quote
    is never closed.

    Every file begins with the same header. The delimiter is the one that splits the header
    most often. A byte-order mark is dropped.
    """
    records = written(numbered_records(spark, path), "records")
    heads = [r["record"] for r in records.where("number = 0").select("record").distinct().limit(2).collect()]
    if not heads:
        raise ValueError("the file has no header")
    if len(heads) > 1:
        raise ValueError(f"files with different headers: {heads}")
    delimiter = sniff_delimiter(heads[0])
    names = next(csv.reader([heads[0]], delimiter=delimiter))
    schema = ", ".join(f"c{n} string" for n in range(len(names)))
    options = {"sep": delimiter, "escape": '"', "multiLine": "true"}
    rows = records.where("number > 0").groupBy("file").agg(F.count(F.lit(1)).alias("rows"))
    order = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    earlier = rows.select("file", F.coalesce(F.sum("rows").over(order), F.lit(0)).alias("earlier"))
    parsed = records.where("number > 0").join(earlier, "file").select(
        F.from_csv("record", schema, options).alias("c"), (F.col("earlier") + F.col("number")).alias("row_no"),
        F.when(F.col("n_lines") > MOST_LINES, F.col("n_lines")).alias("broken"))
    return parsed.select(*[F.when(F.col("broken").isNull(), F.col(f"c.c{n}")).alias(name.strip() or f"column {n + 1}")
                           for n, name in enumerate(names)], "row_no", "broken")


def judge_rows(rows: DataFrame, suffixes) -> DataFrame:
    """Business columns for every row, with ``reason`` where it is rejected."""
    roles = detect_roles([c for c in rows.columns if c not in ("row_no", "broken")])
    if "domain" not in roles:
        raise ValueError("no domain or website column found")
    cell = lambda role: F.trim(F.coalesce(F.col(f"`{roles[role]}`"), F.lit("")))
    optional = lambda role: F.nullif(cell(role), F.lit("")) if role in roles else F.lit(
        None).cast("string")
    raw = cell("domain")
    broken = F.col("broken") if "broken" in rows.columns else F.lit(None).cast("bigint")
    judged = rows.select("row_no", raw.alias("raw"), broken.alias("broken"),
                         (cell("name") if "name" in roles else F.lit(None)).alias("given"),
                         optional("city").alias("city"),
                         optional("country").alias("country"),
                         F.upper(F.substring(optional("country"), 1, 2)).alias("country_code"))
    judged = judged.withColumns({
        "domain": canonical_domain(F.col("raw"), suffixes), "website_url": normalize_url(F.col("raw"))})
    reason = (
        F.when(F.col("broken").isNotNull(), F.format_string("a quote is not closed within %d lines", F.lit(MOST_LINES)))
        .when(F.col("raw") == "", "empty domain")
        .when(F.col("domain").isNull() | F.col("website_url").isNull(),
              F.concat(F.lit("not a valid domain: '"), "raw", F.lit("'")))
    )
    return judged.select(
        "row_no", F.coalesce("given", "domain").alias("name"), "website_url", "domain", "city",
        "country_code", "country", F.lit("csv_import").alias("source"), reason.alias("reason"))


def split_rows(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, error rows)."""
    return (judged.where("reason is null").drop("reason"),
            judged.where("reason is not null").select("row_no", "reason"))


def business_dedupe(valid: DataFrame, limit: int | None = None) -> DataFrame:
    """First row per domain; ``limit`` is the size of a scan, where one is set."""
    kept = [c for c in valid.columns if c not in ("domain", "row_no")]
    first = valid.groupBy("domain").agg(
        F.min_by(F.struct(*kept), "row_no").alias("b"), F.min("row_no").alias("row_no"))
    flat = first.select("row_no", "domain", "b.*")
    return flat if limit is None else flat.orderBy("row_no").limit(limit)


def read_businesses(spark: SparkSession, path: str, suffixes, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(businesses, row errors) of a CSV target list."""
    valid, errors = split_rows(judge_rows(read_csv(spark, path), suffixes))
    return business_dedupe(valid, limit), errors


def detected_columns(spark: SparkSession, headers: list[str]) -> DataFrame:
    """(role, header) of the columns an import would use."""
    roles = detect_roles([h for h in headers if h not in ("row_no", "broken")])
    return spark.createDataFrame(sorted(roles.items()), "role string, header string")


def dry_run(judged: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Preview of an import: (count of valid rows, first 50 errors, first 5 rows)."""
    valid, errors = split_rows(judged)
    unique = business_dedupe(valid)
    return (unique.agg(F.count("*").alias("valid")), errors.orderBy("row_no").limit(50),
            unique.orderBy("row_no").limit(5))


def businesses_from_urls(urls: DataFrame, suffixes, column: str = "url") -> DataFrame:
    """Targets from explicit addresses: invalid ones dropped, named by domain."""
    found = urls.select(canonical_domain(F.col(column), suffixes).alias("domain"),
                        normalize_url(F.col(column)).alias("website_url"))
    return found.where("domain is not null and website_url is not null").select(
        F.col("domain").alias("name"), "website_url", "domain")


def first_status(website_url: Column) -> Column:
    return F.when(F.coalesce(website_url, F.lit("")) != "", "pending").otherwise("no_website")
