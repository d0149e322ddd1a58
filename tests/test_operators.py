"""Contacts, technologies, opportunities and scores on small fixtures."""

import re
import time

import pytest
from conftest import PAGES, SITES, SUFFIXES, dns, page, site, tls
from pyspark.sql import functions as F

from sitelens import fixed
from sitelens.operators import contacts, facts, opportunities, scores, technologies
from sitelens.plans.analyze import analyze, choose
from sitelens.rules import Fingerprint, Signal


def contact_rows(spark, pages, **options):
    firsts = facts.first_facts(facts.page_facts(
        spark.createDataFrame(pages, PAGES), parts=("contacts",), suffixes=SUFFIXES, **options))
    return {(r["kind"], r["value"]): r for r in contacts.contacts(firsts).collect()}


def test_contacts(spark):
    source = """
    <a href='mailto:Sales@acme.com?subject=x'>s</a> info@acme.com, jane.doe@acme.com,
    someone@gmail.com sprite@2x.png django@fosstodon.social
    <a href="tel:+44 20 7946 0018">call</a> <p>or +1 (212) 555-0147 now</p> 0207 946 0018
    <script>x = "+49 30 123456"; hidden@acme.com</script>
    <a href="https://www.linkedin.com/company/Acme/">in</a>
    <a href="https://twitter.com/intent/tweet">share</a>
    <form action="../send"><input name="mail" type="email"><textarea name="t"></textarea></form>
    <div itemtype="https://schema.org/PostalAddress"><div>1 High Street</div> <b>York</b></div> no
    <address>2 Low Street, Leeds</address>"""
    got = contact_rows(spark, [page(html=source, final_url="https://acme.com/a/b"),
                               page(page_no=2, html="info@acme.com +442079460018",
                                    final_url="https://acme.com/c")])
    kinds = {k for k in got}
    assert ("email", "info@acme.com") in kinds and ("email", "sales@acme.com") in kinds
    assert not [v for k, v in kinds if k == "email" and ("jane" in v or "gmail" in v or "social" in v)]
    assert {v for k, v in kinds if k == "phone"} == {"+442079460018", "+12125550147"}
    assert {v for k, v in kinds if k == "social"} == {"https://linkedin.com/company/Acme"} | {
        v for k, v in kinds if k == "social" and "Acme" in v}
    assert ("form", "https://acme.com/send") in kinds
    assert ("address", "1 High Street York") in kinds
    assert ("address", "2 Low Street, Leeds") not in kinds
    assert got["email", "info@acme.com"]["source_url"] == "https://acme.com/a/b"
    assert got["email", "info@acme.com"]["rank"] == 10
    assert contact_rows(spark, [page(html="<p>nothing here</p>")]) == {}


def test_technologies_version_and_bad_group(spark):
    pack = (
        Fingerprint("alpha", "Alpha", "cms", (
            Signal("html", None, r"alpha-(\d+)", 1, "likely"),
            Signal("header", "X-Alpha", r"v([\d.]+)", 1, "certain"))),
        Fingerprint("beta", "Beta", "analytics", (Signal("html", None, r"beta", 3, "possible"),)),
        Fingerprint("gamma", "Gamma", "cdn", (Signal("url", None, r"/g/", None, "likely"),)),
    )
    frame = facts.site_frame(
        spark.createDataFrame([site()], SITES),
        spark.createDataFrame([page(html="ALPHA-7 beta", headers={"x-alpha": "v1.2"},
                                    final_url="https://acme.com/g/")], PAGES),
        fingerprints=pack, parts=("page", "signals"))
    table = technologies.with_technologies(frame, pack, {"alpha": "9.0"})
    rows = {r["tech_id"]: r for r in technologies.explode_technologies(table).collect()}
    assert rows["alpha"]["version"] == "7" and rows["alpha"]["confidence"] == "certain"
    assert rows["alpha"]["is_outdated"] and rows["alpha"]["versions_behind"] == 2
    assert rows["alpha"]["evidence"]["header"] == "X-Alpha: v1.2"
    assert rows["beta"]["version"] is None and rows["beta"]["is_outdated"] is None
    assert rows["gamma"]["evidence"]["url"] == "https://acme.com/g/"


def test_opportunities_and_scores(spark):
    sites = [site("gone.com", tls=tls(-5), dns=dns()), site("early.com", tls=tls(
        not_before=tls(30)["not_after"])), site("empty.com", status="failed", final_url=None)]
    frame = analyze(spark.createDataFrame(sites, SITES),
                    spark.createDataFrame([page("gone.com"), page("early.com")], PAGES), suffixes=SUFFIXES)
    rules = {}
    for r in opportunities.explode_opportunities(frame).collect():
        rules.setdefault(r["site"], {})[r["rule_id"]] = r
    assert "ssl_expired" in rules["gone.com"] and "ssl_renewal" not in rules["gone.com"]
    assert "5 days" in rules["gone.com"]["ssl_expired"]["description"]
    # not yet valid: no days_expired, so the text cannot be filled
    assert "ssl_expired" not in rules["early.com"]
    assert "no_analytics" in rules["gone.com"]
    # nothing was captured: a missing artifact satisfies no condition
    assert "no_analytics" not in rules.get("empty.com", {})
    total = {r["site"]: r for r in scores.score_table(frame).collect()}
    assert all(0 <= r[s] <= 100 for r in total.values() for s in scores.SCORES)
    seen = frame.select("site", "scores.security.*").collect()
    by_site = {r["site"]: r for r in seen}
    assert by_site["empty.com"]["confidence"] < by_site["gone.com"]["confidence"]
    assert by_site["gone.com"]["components"]["critical_penalty"] == -20.0


def test_choose_analyzers():
    assert "cms" not in choose(disabled=("technologies",))
    assert "opportunities" not in choose(disabled=("dns",))
    assert set(choose("cms")) == {"technologies", "cms"}
    with pytest.raises(ValueError):
        choose("nothing")


def test_rewrite_guard(spark):
    table = spark.createDataFrame(
        [("a", "r", "Costs 1,200 now"), ("b", "r", "Ends in 3 days")],
        "site string, rule_id string, description string")
    rewrites = spark.createDataFrame(
        [("a", "r", " Only 1200. "), ("b", "r", "Ends in 5 days")],
        "site string, rule_id string, text string")
    got = {r["site"]: r for r in opportunities.rewrite_guard(table, rewrites).collect()}
    assert got["a"]["description_ai"] == "Only 1200."
    assert got["b"]["verdict"] == "invented numbers" and got["b"]["description_ai"] is None


def test_partition_count_does_not_matter(spark):
    pages = [page("acme.com", n, html=f"info@acme.com x{n} sales@acme.com", page_type="other",
                  final_url=f"https://acme.com/{n}") for n in range(1, 40)]
    base = spark.createDataFrame(pages, PAGES)
    results = []
    for n in (1, 3, 16):
        frame = analyze(spark.createDataFrame([site()], SITES), base.repartition(n), suffixes=SUFFIXES)
        row = frame.select("home.final_url", "primary_email", "n_contacts", F.to_json("scores")
                           .alias("s")).first()
        results.append(tuple(row))
    assert len(set(results)) == 1 and results[0][0] == "https://acme.com/1"


def test_long_token_does_not_slow_down_the_mail_pattern(spark):
    from sitelens.functions.columns import all_found

    texts = [("x" * 1_000_000 + " a.b@acme.com ",), ("@" * 5000,), ("a@b.c@d.ef.gh, <me+you@mail.example.org>",)]
    rows = spark.createDataFrame(texts, "t string").select(
        all_found(F.col("t"), fixed.EMAIL_SCAN_PATTERN).alias("quick"), F.length("t").alias("n"))
    started = time.perf_counter()
    quick = {r.n: list(r.quick) for r in rows.collect()}
    assert time.perf_counter() - started < 30
    for (text,) in texts[1:]:
        assert quick[len(text)] == re.findall(fixed.EMAIL_PATTERN, text)
    assert quick[len(texts[0][0])] == ["a.b@acme.com"]


def test_addresses_that_do_not_parse_are_not_public(spark):
    from sitelens.operators.crawlplan import is_public_address

    odd = ["1:2", ":::", "12345::1", "1:2:3:4:5:6:7:8:9", "08.8.8.8", "1::2::3", "::1", "0:0:0:0:0:0:0:1", "fe80::1", "fd00::",
           "ff02::1", "::g", "", None, "1.2.3", "10.0.0.1", "1:2:3:4:5:6:7::8:9"]
    good = ["2606:2800::1", "8.8.8.8", "1:2:3:4:5:6:7:8", "2001:DB8::", "::2"]
    rows = spark.createDataFrame([(a,) for a in odd + good], "a string").select("a", is_public_address(F.col("a")).alias("p"))
    assert {r.a for r in rows.collect() if r.p} == set(good)


def test_import_reads_all_rows_by_default():
    import inspect

    from sitelens.sources.businesses import read_businesses

    assert inspect.signature(read_businesses).parameters["limit"].default is None


def test_work_folder_must_be_shared(monkeypatch):
    from sitelens import session

    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Cluster:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.work_folder(Cluster())
    Cluster.conf["spark.checkpoint.dir"] = "/shared/"
    assert session.work_folder(Cluster()).startswith("/shared/sitelens-")
