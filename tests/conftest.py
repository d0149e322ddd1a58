import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from sitelens.operators.facts import HOME_TYPE  # noqa: E402
from sitelens.session import build_session  # noqa: E402

SUFFIXES = ("com", "net", "org", "social", "uk", "co.uk", "de")
CLOCK = dt.datetime(2026, 7, 30, 12, tzinfo=dt.timezone.utc)
SITES = (
    "site string, requested_url string, final_url string, status string, failure_reason string, "
    "captured_at timestamp, redirect_chain array<string>, tls struct<protocol:string,"
    "cipher:string,issuer:string,subject:string,sans:array<string>,not_before:timestamp,"
    "not_after:timestamp,is_self_signed:boolean,chain_complete:boolean,hostname_matches:boolean>, "
    "dns struct<a:array<string>,aaaa:array<string>,mx:array<string>,ns:array<string>,"
    "txt:array<string>,cname:string,dmarc:string,dkim_selectors:array<string>,dnssec:boolean,"
    "resolved_ip:string,lookup_failed:array<string>>, cookies array<struct<name:string,"
    "secure:boolean,http_only:boolean,same_site:string,source_url:string>>, "
    "timings struct<ttfb_ms:int,total_ms:int>"
)
PAGES = (
    "site string, page_no bigint, url string, final_url string, status int, "
    "headers map<string,string>, html string, bytes bigint, response_time_ms int, page_type string"
)
assert HOME_TYPE


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", **{
        "spark.master": "local[8]", "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session


def tls(days=200, **over):
    base = dict(protocol="TLSv1.3", cipher="AES", issuer="CA", subject="acme.com",
                sans=["acme.com"], not_before=CLOCK - dt.timedelta(days=30),
                not_after=CLOCK + dt.timedelta(days=days), is_self_signed=False,
                chain_complete=True, hostname_matches=True)
    return {**base, **over}


def dns(**over):
    base = dict(a=["1.2.3.4"], aaaa=[], mx=["10 mx"], ns=[], txt=["v=spf1 mx ~all"], cname=None,
                dmarc="v=DMARC1; p=reject", dkim_selectors=[], dnssec=True, resolved_ip="1.2.3.4",
                lookup_failed=[])
    return {**base, **over}


def site(name="acme.com", **over):
    base = dict(site=name, requested_url=f"https://{name}/", final_url=f"https://{name}/",
                status="complete", failure_reason=None, captured_at=CLOCK, redirect_chain=[],
                tls=None, dns=None, cookies=[], timings=dict(ttfb_ms=200, total_ms=300))
    return {**base, **over}


def page(name="acme.com", page_no=1, **over):
    base = dict(site=name, page_no=page_no, url=f"https://{name}/", final_url=f"https://{name}/",
                status=200, headers={}, html="<html><body>Hello</body></html>", bytes=1024,
                response_time_ms=200, page_type="home")
    return {**base, **over}


@pytest.fixture
def analysed(spark):
    """findings of hand-made sites as {site: {check_id: row}}."""
    from sitelens.operators.checks import explode_findings
    from sitelens.plans.analyze import analyze

    def run(sites, pages, **options):
        frame = analyze(spark.createDataFrame(sites, SITES), spark.createDataFrame(pages, PAGES),
                        **{"suffixes": SUFFIXES, **options})
        out: dict = {}
        for row in explode_findings(frame).collect():
            assert row["check_id"] not in out.setdefault(row["site"], {})
            out[row["site"]][row["check_id"]] = row
        return out

    return run
