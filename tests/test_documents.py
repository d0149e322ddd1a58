"""Nested snapshot documents: defaults, rejects, versions, and sites that come in several parts."""

import json

from conftest import PAGES, SITES, page, site

from sitelens.sources import snapshots


def test_written_documents_come_back(spark, tmp_path):
    sites = spark.createDataFrame([site("a.com"), site("empty.com")], SITES)
    pages = spark.createDataFrame([page("a.com", n, html=f"<p>{n}\n\"é</p>", headers={"Server": "x"}) for n in range(1, 24)], PAGES)
    snapshots.write_documents(sites, pages, str(tmp_path / "d"), per_document=5)
    assert spark.read.text(str(tmp_path / "d")).count() > 3
    found = snapshots.read_documents(spark, str(tmp_path / "d"))
    assert sorted(r.site for r in found.sites.collect()) == ["a.com", "empty.com"] and found.rejects.count() == 0
    got = {r.page_no: (r.html, r.headers) for r in found.pages.collect()}
    assert got == {n: (f"<p>{n}\n\"é</p>", {"server": "x"}) for n in range(1, 24)}
    before, after = sites.orderBy("site").first(), found.sites.orderBy("site").first()
    assert (before.captured_at, before.final_url, before.timings.ttfb_ms) == (after.captured_at, after.final_url, after.timings.ttfb_ms)


def test_defaults_rejects_and_versions(spark, tmp_path):
    good = {"domain": "a.com", "captured_at": "2026-01-01T00:00:00Z", "pages": [{"url": "https://a.com/", "headers": {"X": "1"}}], "tls": {}}
    lines = [json.dumps(good), json.dumps({**good, "captured_at": "2026-02-01T00:00:00Z", "status": "late", "pages": []}),
             json.dumps({"domain": "b.com", "captured_at": "broken", "schema_version": 1}), '{"domain": "c.com"', "[1]", '"text"',
             json.dumps({**good, "domain": " "}), json.dumps({**good, "schema_version": 7}), "", json.dumps({"domain": "d.com", "pages": "x"})]
    (tmp_path / "s.json").write_text("\n".join(lines))
    found = snapshots.read_documents(spark, str(tmp_path))
    sites = {r.site: r for r in found.sites.collect()}
    assert sites["a.com"].status == "late" and sites["a.com"].tls.chain_complete is True and sites["a.com"].cookies == []
    assert sites["b.com"].captured_at.year == 1970 and sites["b.com"].dns is None and sites["b.com"].schema_version == 1
    assert [(r.site, r.page_no, r.status, r.headers, r.page_type) for r in found.pages.collect()] == [("a.com", 1, 0, {"x": "1"}, "other")]
    reasons = {r.document: r.reason for r in found.rejects.collect()}
    assert reasons == {lines[3]: "not a snapshot document", "[1]": reasons["[1]"], '"text"': "not a snapshot document",
                       lines[6]: "no domain", lines[7]: "version 7", lines[9]: "not a snapshot document"}
