"""Plans that hold at scale: sources stay out of shuffles, groups are limited early."""

import time
from pathlib import Path

from conftest import PAGES, SITES, SUFFIXES, page, site
from pyspark.sql import functions as F

from sitelens.functions.columns import top_rows
from sitelens.operators import contacts, facts
from sitelens.plans import catalog
from sitelens.plans.analyze import analyze
from sitelens.session import discard, written
from sitelens.sources import businesses, snapshots
from sitelens.sources.captures import captured_pages, captured_sites

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_page_source_is_read_once_and_never_shuffled(spark):
    firsts = facts.first_facts(facts.page_facts(captured_pages(spark, SMALL), suffixes=SUFFIXES))
    text = plan(firsts)
    assert text.count("FileScan") == 1
    for line in text.splitlines():
        if "Exchange" in line:
            assert "html" not in line and "site" in line and "key" in line
    assert "partial_min_by" in text


def test_pages_of_one_row_group_are_searched_by_all_tasks(spark):
    pages, sites = captured_pages(spark, SMALL), captured_sites(spark, SMALL)
    text = plan(analyze(sites, pages, suffixes=SUFFIXES))
    exchanges = [line for line in text.splitlines() if "Exchange hashpartitioning(site" in line]
    assert any("page_no" in line for line in exchanges)
    # the facts are those of the pages as they were read
    rows = lambda p: sorted(map(str, facts.first_facts(facts.page_facts(p, suffixes=SUFFIXES)).collect()))
    assert rows(facts.spread(pages)) == rows(pages)


def test_site_rows_do_not_read_the_source(spark):
    text = plan(captured_sites(spark, SMALL))
    scan = next(line for line in text.splitlines() if "FileScan" in line)
    assert "html" not in scan.split("ReadSchema")[1]


def test_top_rows_limits_before_the_shuffle(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 3)
    limited = top_rows(df, ["k"], [F.col("id")], 5)
    text = plan(limited)
    assert "WindowGroupLimit" in text and "Partial" in text
    assert limited.count() == 15


def test_no_cartesian_products(spark):
    frame = facts.site_frame(captured_sites(spark, SMALL), captured_pages(spark, SMALL), suffixes=SUFFIXES)
    assert "CartesianProduct" not in plan(frame) and "NestedLoop" not in plan(frame)


def test_written_table_round_trip(spark):
    df = contacts.contacts(facts.first_facts(facts.page_facts(
        captured_pages(spark, SMALL), parts=("contacts",), suffixes=SUFFIXES)))
    again = written(df, "contacts")
    assert again.schema == df.schema and again.exceptAll(df).count() == 0


def test_csv_import(spark, tmp_path):
    path = tmp_path / "targets.csv"
    path.write_text("\ufeffCompany;Website URL;Town;Country\n"
                    "Acme;https://www.acme.com/x;York;gbr\n;;;\nBad;not a domain;;\n"
                    "Twin;ACME.com.;;\nBeta;beta.co.uk;;de\n", encoding="utf-8")
    targets, errors = businesses.read_businesses(spark, str(path), SUFFIXES)
    rows = {r["domain"]: r for r in targets.collect()}
    assert set(rows) == {"acme.com", "beta.co.uk"}
    assert rows["acme.com"]["name"] == "Acme" and rows["acme.com"]["country_code"] == "GB"
    assert rows["acme.com"]["city"] == "York" and rows["beta.co.uk"]["city"] is None
    assert {r["row_no"]: r["reason"] for r in errors.collect()} == {
        2: "empty domain", 3: "not a valid domain: 'not a domain'"}


def test_snapshot_files(spark, tmp_path):
    nested = tmp_path / "in"
    nested.mkdir()
    (nested / "s.json").write_text(
        '{"domain":"acme.com","requested_url":"https://acme.com/","status":"complete",'
        '"captured_at":"2026-07-30T12:00:00Z","tls":{"not_after":"broken"},'
        '"pages":[{"url":"https://acme.com/","headers":{"Server":"x"}},{"url":"https://acme.com/b"}]}')
    sites, pages = snapshots.read_snapshots(spark, str(nested))
    row, first = sites.first(), pages.orderBy("page_no").first()
    assert row["tls"]["not_after"] is None and row["tls"]["chain_complete"] is True
    assert row["dns"] is None and row["cookies"] == [] and row["render_mode"] == "http"
    assert first["headers"] == {"server": "x"} and first["final_url"] == "https://acme.com/"
    snapshots.write_snapshots(sites, pages, str(tmp_path / "out"))
    sites2, pages2 = snapshots.read_tables(spark, str(tmp_path / "out"))
    assert sites2.first().asDict(True) == row.asDict(True)
    ours, theirs = (t.orderBy("page_no").collect() for t in (pages, pages2))
    assert [r.asDict(True) for r in ours] == [r.asDict(True) for r in theirs] and len(ours) == 2


def test_every_query_has_a_check_of_the_same_columns(spark):
    catalog.load()
    assert len(catalog.QUERIES) > 150
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    assert SITES and PAGES and page and site


def test_shuffle_files_go_with_the_write(spark):
    files = lambda: {str(f) for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(
        spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles())}
    before = files()
    copy = written(spark.range(100_000).repartition(7, "id"), "numbers")
    for _ in range(50):  # removal is announced to the executors
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before and copy.count() == 100_000
    discard(copy)
    assert not Path(copy.written_to).exists()
