"""Every family fires, stays silent and says nothing it cannot know."""

from conftest import dns, page, site, tls


def status(rows, check):
    return rows[check]["status"], rows[check]["severity"]


def test_tls_and_dns(analysed):
    cases = {
        "d3.com": site("d3.com", tls=tls(3)), "d25.com": site("d25.com", tls=tls(25)),
        "d200.com": site("d200.com", tls=tls(200)), "gone.com": site("gone.com", tls=tls(-5)),
        "plain.com": site("plain.com", requested_url="http://plain.com/",
                          final_url="http://plain.com/"),
        "blind.com": site("blind.com"),
        "old.com": site("old.com", tls=tls(protocol="TLSv1.1", is_self_signed=True,
                                           hostname_matches=False, chain_complete=False)),
        "plus.com": site("plus.com", dns=dns(txt=["v=spf1 +all"], dmarc=None)),
        "neutral.com": site("neutral.com", dns=dns(txt=["v=spf1 ?all"], dmarc="v=DMARC1; p=none")),
        "noall.com": site("noall.com", dns=dns(txt=["v=spf1 mx"], dmarc="v=DMARC1")),
        "nospf.com": site("nospf.com", dns=dns(txt=["x"], dnssec=False, mx=[])),
        "lost.com": site("lost.com", dns=dns(txt=[], dmarc=None, lookup_failed=["TXT"])),
    }
    got = analysed(list(cases.values()), [page(n) for n in cases],
                   disabled=("technologies", "contacts"))
    assert status(got["d3.com"], "TLS-04") == ("fail", "critical")
    assert got["d3.com"]["TLS-04"]["evidence"]["days_remaining"] == "3"
    assert status(got["d25.com"], "TLS-04") == ("fail", "high")
    assert status(got["d200.com"], "TLS-04") == ("pass", "info")
    assert status(got["gone.com"], "TLS-03") == ("fail", "critical")
    assert got["gone.com"]["TLS-03"]["evidence"]["days_expired"] == "5"
    assert got["gone.com"]["TLS-04"]["status"] == "not_applicable"
    assert status(got["plain.com"], "TLS-01") == ("fail", "critical")
    assert {got["plain.com"][f"TLS-0{n}"]["status"] for n in range(2, 9)} == {"not_applicable"}
    assert {got["blind.com"][f"TLS-0{n}"]["status"] for n in range(3, 9)} == {"not_applicable"}
    assert {got["blind.com"][f"DNS-0{n}"]["status"] for n in range(1, 8)} == {"not_applicable"}
    assert [got["old.com"][f"TLS-0{n}"]["status"] for n in (5, 6, 7, 8)] == ["fail"] * 4
    assert status(got["plus.com"], "DNS-02") == ("fail", "high")
    assert status(got["plus.com"], "DNS-03") == ("fail", "high")
    assert got["plus.com"]["DNS-04"]["status"] == "not_applicable"
    assert status(got["neutral.com"], "DNS-02") == ("warn", "medium")
    assert status(got["neutral.com"], "DNS-04") == ("fail", "medium")
    assert status(got["noall.com"], "DNS-02") == ("warn", "medium")
    assert status(got["noall.com"], "DNS-04") == ("warn", "medium")
    assert status(got["nospf.com"], "DNS-01") == ("fail", "high")
    assert got["nospf.com"]["DNS-02"]["status"] == "not_applicable"
    assert status(got["nospf.com"], "DNS-07") == ("warn", "low")
    assert [got["lost.com"][c]["status"] for c in ("DNS-01", "DNS-02")] == ["not_applicable"] * 2
    assert got["lost.com"]["DNS-03"]["status"] == "fail"
    for rows in got.values():
        for row in rows.values():
            assert row["status"] not in ("fail", "warn") or row["evidence"]


def test_pages_and_headers(analysed):
    every = {"Strict-Transport-Security": "max-age=1", "content-security-policy":
             "frame-ancestors none", "x-content-type-options": "nosniff", "referrer-policy": "a",
             "permissions-policy": "b", "server": "cloudflare", "cf-ray": "1"}
    cookie = dict(name="a", secure=False, http_only=False, same_site=None, source_url="u")
    full = ('<meta name="viewport" content="x"><a href="/privacy">p</a> cookie consent '
            '<img src="http://localhost/x">')
    bad = '<meta name="generator" content="WordPress 5.4.2"><img src="http://cdn.test/x.png">'
    sites = [site("good.com"), site("bad.com", cookies=[cookie]), site("down.com"),
             site("none.com")]
    pages = [
        page("good.com", headers=every, html=full),
        page("bad.com", headers={"server": "nginx/1.18.0"}, html=bad, bytes=4_000_000),
        page("bad.com", 2, html=bad, final_url="http://bad.com/wp-login.php", page_type="other"),
        page("down.com", status=500),
    ]
    got = analysed(sites, pages, lists=True)
    good, broken = got["good.com"], got["bad.com"]
    for check in ("HDR-01", "HDR-02", "HDR-03", "HDR-04", "HDR-05", "HDR-06", "HDR-07", "CNT-01",
                  "CNT-02", "PRV-02", "PERF-01", "PERF-02", "PERF-03", "PERF-04"):
        assert good[check]["status"] == "pass", check
    assert {good[f"CKY-0{n}"]["status"] for n in (1, 2, 3)} == {"not_applicable"}
    assert [broken[f"CKY-0{n}"]["status"] for n in (1, 2, 3)] == ["fail", "warn", "warn"]
    assert status(broken, "HDR-07") == ("fail", "low")
    assert status(broken, "CNT-01") == ("fail", "medium")
    assert broken["CNT-01"]["evidence"]["pages"] == (
        '["https://bad.com/","http://bad.com/wp-login.php"]')
    assert status(broken, "CNT-02") == ("fail", "low")
    assert status(broken, "PERF-02") == ("warn", "medium")
    assert status(broken, "CMS-02") == ("fail", "medium")
    assert status(broken, "CMS-03") == ("fail", "critical")
    assert broken["TECH-OUTDATED-WORDPRESS"]["evidence"]["latest_version"] == "6.7"
    unseen = ["HDR-01", "HDR-04", "HDR-07", "CKY-01", "CNT-01", "CNT-02", "PERF-01", "PERF-04"]
    for name in ("down.com", "none.com"):
        assert {got[name][c]["status"] for c in unseen} == {"not_applicable"}
        assert "PRV-01" not in got[name]
    assert got["none.com"]["TECH-01"]["status"] == "not_applicable"
