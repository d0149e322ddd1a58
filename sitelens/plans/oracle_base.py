"""SQL building blocks of the checking queries.

``chain(scan)`` spells the whole analysis of one derived scan as named CTEs;
``with_ctes`` picks those a query needs. The dialect is the checking engine's.
"""

from __future__ import annotations

import re

from sitelens import fixed, rules
from sitelens.sources import captures as cap

NOW = "2026-07-30T12:00:00Z"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listing(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def inlist(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def ev(**entries) -> str:
    """Evidence text k=v|..., keys in order, NULL values left out."""
    parts = [f"'{k}=' || CAST({v} AS VARCHAR)" for k, v in sorted(entries.items())]
    return f"concat_ws('|', {', '.join(parts)})" if parts else "''"


def lambda_let(value: str, name: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def registrable(host: str) -> str:
    cut = (f"list_filter(range(0, len(l)), lambda i: list_contains({listing(cap.SUFFIXES)}, "
           "array_to_string(l[i+1:], '.')))[1]")
    inner = lambda_let(cut, "c", "CASE WHEN c >= 1 AND l[c] <> '' "
                                 "THEN array_to_string(l[c:], '.') END")
    return lambda_let(f"string_split(rtrim({host}, '.'), '.')", "l", inner)


def unescaped(out: str) -> str:
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
                         ("&#39;", "'"), ("&amp;", "&")):
        out = f"replace({out}, {q(entity)}, {q(char)})"
    return out


def text_of(html: str) -> str:
    """Source to text: tags to blanks, entities decoded, blanks collapsed."""
    out = unescaped(f"regexp_replace({html}, '<[^>]*>', ' ', 'g')")
    return f"trim(regexp_replace({out}, '[\\s\\x{{00A0}}]+', ' ', 'g'))"


def no_hidden(html: str) -> str:
    return (f"regexp_replace({html}, '(?is)<script\\b.*?</script\\s*>|"
            "<style\\b.*?</style\\s*>|<!--.*?-->', ' ', 'g')")


def check(check_id: str, analyzer: str, category: str, *branches) -> str:
    """One SELECT of (site, check_id, analyzer, category, status, severity, evidence).

    A branch is (test, status, severity, evidence[, category]); test None is the default.
    """
    cases = {k: [] for k in ("category", "status", "severity", "evidence")}
    for test, status, severity, proof, *other in branches:
        when = f"WHEN {test} THEN" if test else "ELSE"
        values = {
            "category": q(other[0] if other else category),
            "status": status if status.startswith("CASE") else q(status),
            "severity": severity if severity.startswith("CASE") else q(severity),
            "evidence": proof,
        }
        for key, value in values.items():
            cases[key].append(f"{when} {value}")
    cols = ", ".join(
        f"CASE {' '.join(cases[k])} END AS {k}" if branches[0][0] else
        f"{cases[k][0][5:]} AS {k}" for k in cases)
    return f"SELECT site, {q(check_id)} AS check_id, {q(analyzer)} AS analyzer, {cols} FROM sr§"


NA = ("not_applicable", "info", "''")


def na(test, *category):
    return (test, *NA, *category)


def _findings() -> str:
    now = q(NOW)
    out = []
    url = "coalesce(final_url, requested_url)"
    insecure, unseen = na("NOT is_https"), na("NOT tls_seen")

    def tls(cid, *rest):
        out.append(check(cid, "ssl", "tls", insecure, unseen, *rest))

    out.append(check("TLS-01", "ssl", "tls",
                     ("NOT is_https", "fail", "critical", ev(final_url=url, checked_at=now)),
                     (None, "pass", "info", ev(final_url=url))))
    out.append(check(
        "TLS-02", "ssl", "tls", insecure,
        na("requested_url LIKE 'https://%' AND len(redirect_chain) = 0"),
        ("len(redirect_chain) > 0", "pass", "info", ev(redirect_chain="to_json(redirect_chain)")),
        (None, "fail", "high", ev(redirect_chain="to_json(redirect_chain)", checked_at=now))))
    tls("TLS-03",
        ("days_left < 0", "fail", "critical", ev(
            not_after="until", days_expired="-days_left", issuer="'Test CA'", checked_at=now)),
        ("starts_in_days > 0", "fail", "critical", ev(not_before="since", checked_at=now)),
        (None, "pass", "info", ev(not_after="until", days_remaining="days_left")))
    tls("TLS-04", na("days_left < 0"),
        ("days_left < 30", "fail", "CASE WHEN days_left <= 7 THEN 'critical' ELSE 'high' END",
         ev(not_after="until", days_remaining="days_left", issuer="'Test CA'", checked_at=now)),
        (None, "pass", "info", ev(not_after="until", days_remaining="days_left")))
    sans = "to_json([site, '*.' || site])"
    tls("TLS-05", ("names_match", "pass", "info", ev(subject="site", sans=sans)),
        (None, "fail", "critical", ev(hostname="site", subject="site", sans=sans,
                                      checked_at=now)))
    tls("TLS-06", na("protocol IS NULL"),
        ("protocol = 'TLSv1.1'", "fail", "high", ev(protocol="protocol", checked_at=now)),
        (None, "pass", "info", ev(protocol="protocol")))
    tls("TLS-07", ("chain_complete", "pass", "info", "''"),
        (None, "fail", "medium", ev(issuer="'Test CA'", checked_at=now)))
    tls("TLS-08", ("NOT self_signed", "pass", "info", ev(issuer="'Test CA'")),
        (None, "fail", "high", ev(issuer="'Test CA'", subject="site", checked_at=now)))

    def dns(cid, kind, *rest):
        gates = [na("NOT has_dns")]
        if kind:
            gates.append(na(f"coalesce(lookup_failed = '{kind}', false)"))
        out.append(check(cid, "dns", "email_auth", *gates, *rest))

    dns("DNS-01", "TXT", ("spf IS NOT NULL", "pass", "info", ev(record="spf")),
        (None, "fail", "high", ev(query="site || ' TXT'", result="'no v=spf1 record found'",
                                  checked_at=now)))
    dns("DNS-02", "TXT", na("spf IS NULL"),
        ("qualifier = '+'", "fail", "high", ev(record="spf", qualifier="'+all'", checked_at=now)),
        ("qualifier = '?'", "warn", "medium", ev(record="spf", qualifier="'?all'",
                                                 checked_at=now)),
        ("qualifier IS NULL", "warn", "medium", ev(record="spf", checked_at=now)),
        (None, "pass", "info", ev(record="spf", qualifier="qualifier || 'all'")))
    dns("DNS-03", "DMARC", ("dmarc IS NOT NULL", "pass", "info", ev(record="dmarc")),
        (None, "fail", "high", ev(query="'_dmarc.' || site || ' TXT'", result="'NXDOMAIN'",
                                  checked_at=now)))
    dns("DNS-04", "DMARC", na("dmarc IS NULL"),
        ("policy IS NULL", "warn", "medium", ev(record="dmarc", checked_at=now)),
        ("policy = 'none'", "fail", "medium", ev(record="dmarc", policy="'none'",
                                                 checked_at=now)),
        (None, "pass", "info", ev(record="dmarc", policy="policy")))
    dns("DNS-05", None, ("dkim IS NOT NULL", "pass", "info", ev(selectors="to_json([dkim])")),
        (None, "info", "info", ev(selectors_checked=f"to_json({listing(fixed.DKIM_SELECTORS)})")))
    dns("DNS-06", "MX", ("mx IS NOT NULL", "info", "info", ev(mx="to_json([mx])")),
        (None, "info", "info", ev(mx="'[]'")))
    dns("DNS-07", "DNSKEY", ("dnssec", "pass", "info", ev(dnssec="true")),
        (None, "warn", "low", ev(dnssec="false", checked_at=now)))

    closed = na("NOT home_ok")
    for cid, name, severity in fixed.HEADER_CHECKS:
        h = col(name)
        out.append(check(cid, "headers", "headers", closed,
                         (f"{h} IS NOT NULL", "pass", "info", ev(header=q(name), value=h)),
                         (None, "fail", severity, ev(header=q(name), present="false",
                                                     url="home_url", checked_at=now))))
    out.append(check(
        "HDR-04", "headers", "headers", closed,
        (f"{col('x-frame-options')} IS NOT NULL OR framed", "pass", "info",
         ev(x_frame_options=col("x-frame-options"), csp_frame_ancestors="framed")),
        (None, "fail", "medium", ev(url="home_url", present="false", checked_at=now))))
    out.append(check(
        "HDR-07", "headers", "headers", closed,
        ("len(banners) = 0", "pass", "info", "''"),
        (None, "fail", "low", ev(headers="to_json(banners)", checked_at=now))))
    crumbs = na("n_cookies = 0", "cookies")
    names = "to_json(cookie_names)"
    for cid, fine, status, severity in (
        ("CKY-01", "cookie_secure OR NOT is_https", "fail", "medium"),
        ("CKY-02", "cookie_http_only", "warn", "medium"),
        ("CKY-03", "cookie_same_site IS NOT NULL", "warn", "low"),
    ):
        good = ev(cookie_count="n_cookies") if cid == "CKY-01" else "''"
        out.append(check(cid, "headers", "cookies", na("NOT home_ok", "headers"), crumbs,
                         (fine, "pass", "info", good),
                         (None, status, severity, ev(cookies=names, checked_at=now))))
    shut = na("NOT home_ok", "headers")
    out.append(check("CNT-01", "headers", "content", shut, na("NOT is_https"),
                     ("n_mixed = 0", "pass", "info", "''"),
                     (None, "fail", "medium", ev(page_count="n_mixed", checked_at=now))))
    out.append(check(
        "CNT-02", "headers", "content", shut,
        ("home_gen IS NULL", "pass", "info", "''"),
        ("NOT regexp_matches(home_gen, '\\d+\\.\\d+')", "pass", "info", ev(generator="home_gen")),
        (None, "fail", "low", ev(generator="home_gen", url="home_url", checked_at=now))))
    out.append(check("PRV-01", "headers", "content",
                     ("n_privacy > 0", "info", "info", ev(found="true")),
                     (None, "info", "info", ev(found="false"))) + " WHERE home_ok")
    out.append(check("PRV-02", "headers", "content",
                     ("n_consent > 0", "pass", "info", ev(found="true")),
                     (None, "warn", "low", ev(found="false", checked_at=now)))
               + " WHERE home_ok")

    def perf(cid, *rest):
        out.append(check(cid, "performance", "performance", closed, *rest))

    perf("PERF-01", na("first_byte <= 0"),
         ("first_byte > 1500", "fail", "CASE WHEN first_byte < 3000 THEN 'medium' ELSE 'high' END",
          ev(ttfb_ms="first_byte", threshold_ms="1500", url="home_url", checked_at=now)),
         (None, "pass", "info", ev(ttfb_ms="first_byte")))
    perf("PERF-02", na("home_bytes <= 0"),
         ("home_bytes > 3145728", "warn", "medium", ev(bytes="home_bytes", url="home_url",
                                                       checked_at=now)),
         (None, "pass", "info", ev(bytes="home_bytes")))
    perf("PERF-03", ("cdn IS NOT NULL", "pass", "info", ev(cdn="cdn")),
         (None, "warn", "low", ev(headers_checked="to_json(['server', 'via', 'cf-ray', "
                                                  "'x-cache'])", checked_at=now)))
    perf("PERF-04", ("home_viewport", "pass", "info", "''"),
         (None, "fail", "high", ev(url="home_url", checked_at=now)))

    names25 = "to_json(coalesce(tech_names, []::VARCHAR[]))"
    out.append(check("TECH-01", "technologies", "technology", na("page_count = 0"),
                     (None, "info", "info", ev(count="n_tech", technologies=names25)))
               .replace("FROM sr§", "FROM st§"))
    out.append(
        "SELECT site, 'TECH-OUTDATED-' || upper(tech_id) AS check_id, 'technologies' AS analyzer, "
        "'technology' AS category, 'fail' AS status, CASE WHEN versions_behind < 2 THEN 'medium' "
        "ELSE 'high' END AS severity, " + ev(
            technology="name", detected_version="version", latest_version="latest",
            versions_behind="versions_behind", detection="detection", checked_at=now)
        + " AS evidence FROM tech§ WHERE is_outdated")
    cms = []
    cms.append(check("CMS-01", "cms", "cms",
                     ("cms_id IS NULL", "info", "info", ev(technologies_checked="n_tech")),
                     (None, "info", "info", ev(cms="cms_name", version="cms_version",
                                               confidence="cms_confidence",
                                               detection="cms_detection"))))
    cms.append(check("CMS-02", "cms", "cms", na("cms_version IS NULL"), na("cms_outdated IS NULL"),
                     ("NOT cms_outdated", "pass", "info", ev(cms="cms_name",
                                                             version="cms_version")),
                     (None, "fail", "CASE WHEN cms_behind >= 2 THEN 'high' ELSE 'medium' END",
                      ev(cms="cms_name", detected_version="cms_version",
                         versions_behind="cms_behind", detection="cms_detection",
                         checked_at=now))) + " WHERE cms_id IS NOT NULL")
    admin = " ".join(f"WHEN '{k}' THEN admin_{k}" for k in fixed.ADMIN_PATHS)
    cms.append(check("CMS-03", "cms", "cms",
                     (f"(CASE cms_id {admin} END) IS NOT NULL", "fail", "critical",
                      ev(url=f"(CASE cms_id {admin} END)", cms="cms_name", checked_at=now)),
                     (None, *NA)) + " WHERE cms_id IS NOT NULL")
    out += [c.replace("FROM sr§", "FROM st§") for c in cms]
    out.append(check("CONTACT-01", "contacts", "contacts",
                     ("page_count = 0", "info", "info", "''"),
                     ("n_contacts = 0", "info", "info", ev(contacts_found="0")),
                     (None, "info", "info", ev(emails="n_emails", phones="n_phones",
                                               socials="n_socials", has_form="n_forms > 0",
                                               primary_email="primary_email")))
               .replace("FROM sr§", "FROM sc§"))
    return "\nUNION ALL ".join(out)


def col(header: str) -> str:
    return "h_" + header.replace("-", "_")


def _rules_values() -> str:
    rows = []
    for tech_id, name, category, n, kind, signal_name, pattern, group, confidence in (
            rules.signal_rows()):
        weight = fixed.CONFIDENCE_WEIGHT[confidence]
        rows.append(f"({q(tech_id)}, {q(name)}, {q(category)}, {n}, {q(kind)}, "
                    f"{q(signal_name) if signal_name else 'NULL'}, {q('(?i)' + pattern)}, "
                    f"{group if group else 'NULL'}, {q(confidence)}, {weight})")
    return ("SELECT * FROM (VALUES " + ", ".join(rows) + ") AS t(tech_id, name, category, "
            "signal_no, type, signal_name, pattern, version_group, confidence, weight)")


def _latest_values() -> str:
    rows = ", ".join(f"({q(k)}, {q(v)})" for k, v in rules.LATEST_VERSIONS.items())
    return f"SELECT * FROM (VALUES {rows}) AS t(tech_id, latest)"


def version_key(version: str) -> str:
    """Parts of a dotted version, zero-filled to six places, for comparing."""
    return (f"list_transform(range(1, 7), lambda i: coalesce(TRY_CAST(string_split({version}, '.')"
            "[i] AS BIGINT), 0))")


def _contacts() -> str:
    mails_cat = "CASE " + " ".join(
        f"WHEN head = {q(word)} THEN {q(cat)}"
        for word, cat in fixed.ROLE_CATEGORIES.items()) + " ELSE 'other' END"
    rank = "CASE cat " + " ".join(
        f"WHEN {q(c)} THEN {r}" for c, r in fixed.CATEGORY_RANK.items()) + " END"
    emails = (
        f"SELECT site, page_no, final_url, 'email' AS kind, cat AS category, a AS value, "
        f"a AS norm, {rank} AS rank, 0 AS pos FROM (SELECT *, {mails_cat} AS cat FROM mailok§)")
    phones = ("SELECT site, page_no, final_url, 'phone', 'general', num, num, 10, pos "
              "FROM phonerow§ WHERE num IS NOT NULL")
    socials = ("SELECT site, page_no, final_url, 'social', category, 'https://' || u, "
               "regexp_replace(lower(u), '/+$', ''), 40, pos FROM socialrow§")
    forms = ("SELECT site, page_no, final_url, 'form', 'general', t, lower(t), 60, 0 FROM ("
             "SELECT site, page_no, final_url, regexp_extract(final_url, "
             "'^(https?://[^/?#]*)', 1) || '/send' AS t FROM pg§ "
             "WHERE html LIKE '%<form action=\"/send\">%')")
    addresses = (
        "SELECT site, page_no, final_url, 'address', 'general', v, lower(v), rank, 0 FROM ("
        "SELECT site, page_no, final_url, CASE WHEN html LIKE '%PostalAddress%' THEN 30 ELSE 35 "
        "END AS rank, " + text_of(
            "CASE WHEN html LIKE '%PostalAddress%' THEN regexp_extract(html, "
            "'(?s)PostalAddress\">(.*?)</div>', 1) ELSE regexp_extract(html, "
            "'(?s)<address>(.*?)</address>', 1) END") + " AS v FROM pg§) "
        "WHERE length(v) >= 10")
    return "\nUNION ALL ".join((emails, phones, socials, forms, addresses))


def _opportunities() -> str:
    """Per rule: triggers as joins on the pivoted statuses, text from evidence."""
    def e(check_id, key):
        return f"(SELECT regexp_extract(evidence, '(?:^|\\|){key}=([^|]*)', 1) FROM f§ " \
               f"WHERE f§.site = s.site AND check_id = '{check_id}')"

    def failed(*ids):
        return " AND ".join(
            f"EXISTS (SELECT 1 FROM f§ WHERE f§.site = s.site AND check_id = '{i}' "
            "AND status IN ('fail', 'warn'))" for i in ids)

    out = []
    for r in sorted(rules.OPPORTUNITY_RULES, key=lambda r: (fixed.URGENCY_RANK[r.urgency], r.id)):
        tests = []
        for c in r.requires:
            if c.kind == "finding_failed":
                tests.append(failed(c.check_id))
            else:
                tests.append("has_analytics" if c.kind == "artifact_truthy"
                             else "NOT has_analytics")
        names = [m.group(1) for m in re.finditer(r"\$\{(\w+)\}", r.template + r.title)]

        def fill(template, r=r):
            text = q(template)
            for m in re.finditer(r"\$\{(\w+)\}", template):
                name = m.group(1)
                if name == "domain":
                    value = "site"
                else:
                    value = f"v_{name}"
                text = text.replace("${" + name + "}", f"' || {value} || '")
            return text

        values = "".join(
            f", coalesce({', '.join('nullif(' + e(c, n) + ', %s)' % q('') for c in r.evidence_from)}"
            f") AS v_{n}" for n in dict.fromkeys(names) if n != "domain")
        triggers = sorted(r.evidence_from) or [r.id]
        out.append(
            f"SELECT site, {q(r.id)} AS rule_id, {fill(r.title)} AS title, "
            f"{q(r.category)} AS category, {q(r.urgency)} AS urgency, "
            f"{fixed.URGENCY_WEIGHT[r.urgency]} AS weight, {fixed.URGENCY_RANK[r.urgency]} AS urank, "
            f"{fill(r.template)} AS description, {q(', '.join(triggers))} AS triggered_by, "
            f"{q(', '.join(r.supersedes))} AS supersedes "
            f"FROM (SELECT site{values} FROM st§ s WHERE {' AND '.join(tests)}) "
            f"WHERE {fill(r.template)} IS NOT NULL")
    return "\nUNION ALL ".join(out)


def _scores() -> str:
    def stat(c):
        return f"max(status) FILTER (check_id = '{c}')"

    checks = sorted({c for _, _, m in fixed.SECURITY_GROUPS for c in m} | set(fixed.WEBSITE_CHECKS))
    alias = {c: "s_" + c.replace("-", "_").lower() for c in checks}
    pivot = ("SELECT site, " + ", ".join(f"{stat(c)} AS {alias[c]}" for c in checks)
             + ", count(*) FILTER (status = 'fail' AND severity = 'critical') AS crit "
             "FROM f§ GROUP BY site")
    bad = lambda c: f"(CASE WHEN {alias[c]} IN ('fail', 'warn') THEN 1 ELSE 0 END)"
    known = lambda c: f"(CASE WHEN {alias[c]} <> 'not_applicable' THEN 1 ELSE 0 END)"
    groups = []
    for g, w, members in fixed.SECURITY_GROUPS:
        k, b = "+".join(map(known, members)), "+".join(map(bad, members))
        groups.append(f"CASE WHEN ({k}) = 0 THEN {w}::DOUBLE ELSE {w}::DOUBLE * (1.0::DOUBLE - "
                      f"({b})::DOUBLE / ({k})) END AS sec_{g}")
    every = [c for _, _, m in fixed.SECURITY_GROUPS for c in m]
    sconf = f"({'+'.join(map(known, every))})::DOUBLE / {len(every)}"
    wconf = f"({'+'.join(map(known, fixed.WEBSITE_CHECKS))})::DOUBLE / {len(fixed.WEBSITE_CHECKS)}"
    w = lambda c, b, g: f"CASE WHEN {bad(c)} = 1 THEN {b}::DOUBLE ELSE {g}::DOUBLE END"
    return f"""
SELECT site, {', '.join(groups)},
  CASE WHEN crit > 0 THEN -least(40.0::DOUBLE, crit * 20.0::DOUBLE) END AS sec_penalty,
  {sconf} AS security_confidence, {wconf} AS website_confidence,
  {w('PERF-01', 8, 30)} AS web_performance, {w('PERF-04', 0, 20)} AS web_mobile,
  {w('PERF-03', 6, 15)} AS web_delivery, {w('TLS-01', 0, 15)} AS web_transport,
  CASE WHEN cms_outdated THEN 4.0::DOUBLE WHEN NOT cms_outdated THEN 20.0::DOUBLE
       ELSE 14.0::DOUBLE END AS web_modernity,
  least(40.0::DOUBLE, (CASE WHEN primary_email IS NOT NULL THEN 22 ELSE 0 END
     + CASE WHEN primary_phone IS NOT NULL THEN 10 ELSE 0 END
     + CASE WHEN n_forms > 0 THEN 5 ELSE 0 END + CASE WHEN n_addresses > 0 THEN 3 ELSE 0 END
     )::DOUBLE) AS lead_contact,
  least(12.0::DOUBLE, n_socials * 4.0::DOUBLE) + least(13.0::DOUBLE, n_tech * 1.5::DOUBLE)
     AS lead_signals,
  CASE WHEN {bad('TLS-01')} = 1 THEN 15.0::DOUBLE ELSE 20.0::DOUBLE END AS lead_reachable,
  least(15.0::DOUBLE, n_opp * 3.0::DOUBLE) AS lead_engagement,
  CASE WHEN n_contacts > 0 THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END AS lead_confidence,
  least(70.0::DOUBLE, opp_weight) AS opp_value,
  least(15.0::DOUBLE, n_critical * 7.5::DOUBLE) AS opp_urgency,
  CASE WHEN primary_email IS NOT NULL THEN 15.0::DOUBLE WHEN primary_phone IS NOT NULL
       THEN 9.0::DOUBLE ELSE 0.0::DOUBLE END AS opp_reach
FROM ({pivot}) JOIN st§ USING (site) JOIN sc§ USING (site)
JOIN (SELECT site, count(rule_id) AS n_opp, coalesce(sum(weight), 0)::DOUBLE AS opp_weight,
        count(*) FILTER (urgency = 'critical') AS n_critical
      FROM sr§ LEFT JOIN opp§ USING (site) GROUP BY site) USING (site)"""


def clamp(value: str) -> str:
    return f"CAST(greatest(0, least(100, round_even({value}, 0))) AS INT)"


def chain(scan: str) -> dict[str, str]:
    shift, kept = cap.SCANS[scan]
    kept = kept.replace("seed", "raw_seed")
    headers = ", ".join(f"{f} AS {col(h)}" for h, f in cap.HEADERS.items())
    mixed = "replace(replace(low, 'src=\"http://localhost', ''), 'href=\"http://localhost', '')"
    pages_mixed = f"regexp_matches({mixed}, '(?:src|href)\\s*=\\s*[\"'']http://')"
    gen = q(fixed.GENERATOR_PATTERN.replace("(?i)", ""))
    admin = ", ".join(
        f"arg_min(final_url, page_no) FILTER (contains(final_url, {q(path)}) AND final_url LIKE "
        f"'http://%') AS admin_{cms}" for cms, path in fixed.ADMIN_PATHS.items())
    fields = ", ".join(f"{f} AS {n}" for n, f in cap.SITE_FIELDS.items())
    header_signal = " ".join(f"WHEN {q(h)} THEN {col(h)}" for h in cap.HEADERS)
    low_banner = ", ".join(
        f"CASE WHEN regexp_matches({col(h)}, '\\d+\\.\\d+') THEN '{h}: ' || {col(h)} END"
        for h in ("server", "x-powered-by"))
    plan = "[" + ", ".join(
        f"{{'code': {q(c)}, 'lo': {lo}, 'hi': {hi}, 'trunk': {q(t)}}}"
        for c, (lo, hi, t) in fixed.DIAL_PLAN.items()) + "]"
    social = " UNION ALL ".join(
        f"SELECT site, page_no, final_url, {q(cat)} AS category, unnest(regexp_extract_all(html, "
        f"{q(p)})) AS u, {n} AS pos FROM pg§" for n, (cat, p) in enumerate(fixed.SOCIAL_PATTERNS))
    mailpat = q(fixed.EMAIL_PATTERN)
    ctes = {
        "num": "SELECT page_id, url, html, regexp_extract(url, " + q(cap.HOST) + ", 1) AS host, "
               "regexp_extract(regexp_extract(url, " + q(cap.HOST) + ", 1), " + q(cap.SITE)
               + ", 1) AS site FROM pages",
        "nx§": "SELECT site, host, url, html, raw_seed + %d AS seed, page_id + %d AS p FROM "
               "(SELECT *, ('0x' || substr(md5(site), 1, 7))::BIGINT AS raw_seed FROM num) "
               "WHERE %s" % (shift, shift, kept),
        "pg§": f"SELECT *, lower(html) AS low FROM (SELECT site, p AS page_no, url, host, "
               f"{cap.PAGE['final_url']} AS final_url, {cap.PAGE['status']} AS status, {headers}, "
               f"{cap.PAGE['bytes']} AS bytes, {cap.PAGE['response_time_ms']} AS response_time_ms, "
               f"{cap.ENRICHED} AS html FROM nx§ WHERE NOT ({cap.SITE_FIELDS['failed']}))",
        "sx§": f"SELECT *, coalesce(final_url, requested_url) LIKE 'https://%' AS is_https, "
               f"NOT failed AND home_url LIKE 'https://%' AND has_tls AS tls_seen, "
               f"nullif(regexp_extract(spf, '([+\\-~?])all\\b', 1), '') AS qualifier, "
               f"lower(nullif(regexp_extract(dmarc, '\\bp\\s*=\\s*(none|quarantine|reject)\\b', 1, "
               f"'i'), '')) AS policy, "
               f"strftime(TIMESTAMP '{cap.CLOCK}' + to_days(days_left::INT), "
               f"'%Y-%m-%dT%H:%M:%SZ') AS until, "
               f"strftime(TIMESTAMP '{cap.CLOCK}' + to_days(starts_in_days::INT), "
               f"'%Y-%m-%dT%H:%M:%SZ') AS since, "
               f"{listing(cap.COOKIE_NAMES)}[1:n_cookies] AS cookie_names "
               f"FROM (SELECT site, seed, home_url, "
               f"{fields.replace('seed % 4 AS n_cookies', 'CASE WHEN seed % 13 = 0 THEN 0 ELSE seed % 4 END AS n_cookies')}, "
               "CASE WHEN seed % 13 = 0 OR seed % 2 = 0 THEN 'http://' || site || '/' ELSE home_url "
               "END AS requested_url, CASE WHEN seed % 13 <> 0 THEN home_url END AS final_url, "
               "CASE WHEN seed % 4 = 0 THEN ['http://' || site || '/'] ELSE []::VARCHAR[] END "
               "AS redirect_chain "
               f"FROM (SELECT site, seed, arg_min({cap.PAGE['final_url']}, p) AS home_url FROM nx§ "
               "GROUP BY ALL))",
        "ho§": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY page_no) "
               "AS rn FROM pg§) WHERE rn = 1",
        "ag§": "SELECT site, count(*) AS page_count, sum(bytes)::BIGINT AS total_bytes, "
               f"count(*) FILTER ({pages_mixed}) AS n_mixed, "
               f"count(*) FILTER (regexp_matches(low, {q(fixed.PRIVACY_PATTERN)})) AS n_privacy, "
               f"count(*) FILTER (regexp_matches(low, {q(fixed.CONSENT_PATTERN)})) AS n_consent, "
               f"arg_min(g, page_no) FILTER (g <> '') AS generator, {admin} "
               f"FROM (SELECT *, regexp_extract(html, {gen}, 1, 'i') AS g FROM pg§) GROUP BY site",
        "sr§": "SELECT sx§.*, ag§.* EXCLUDE (site, page_count, total_bytes), "
               "coalesce(page_count, 0) AS page_count, coalesce(total_bytes, 0) AS total_bytes, "
               "h.final_url AS home_page_url, h.final_url AS home_url_ok, h.status AS home_status, "
               "coalesce(h.status BETWEEN 200 AND 299, false) AS home_ok, h.bytes AS home_bytes, "
               "h.response_time_ms AS home_ms, "
               "CASE WHEN ttfb_ms <> 0 THEN ttfb_ms ELSE h.response_time_ms END AS first_byte, "
               f"nullif(trim(regexp_extract(h.html, {gen}, 1, 'i')), '') AS home_gen, "
               "regexp_matches(h.html, '(?i)<meta[^>]+name\\s*=\\s*[\"'']viewport[\"'']') "
               "AS home_viewport, "
               + ", ".join(f"h.{col(h)}" for h in cap.HEADERS) + ", "
               f"coalesce(contains(lower(h.{col('content-security-policy')}), 'frame-ancestors'), "
               "false) AS framed, "
               f"list_filter([{low_banner.replace('h_', 'h.h_')}], lambda x: x IS NOT NULL) "
               "AS banners, "
               f"CASE WHEN h.{col('cf-ray')} IS NOT NULL OR h.{col('server')} = 'cloudflare' THEN "
               f"'Cloudflare' WHEN contains(lower(h.{col('via')}), 'cloudfront') THEN 'CloudFront' "
               "END AS cdn FROM sx§ LEFT JOIN ho§ h USING (site) LEFT JOIN ag§ USING (site)",
        "rules": _rules_values(),
        "latest_known": _latest_values(),
        "hit§": "SELECT site, tech_id, name, category, signal_no, type, confidence, weight, "
                "arg_min(txt, page_no) AS text, arg_min(ver, page_no) AS version "
                "FROM (SELECT site, page_no, r.*, regexp_extract(html, pattern, 0) AS txt, "
                "CASE WHEN version_group = 1 THEN nullif(regexp_extract(html, pattern, 1), '') END "
                "AS ver FROM pg§ JOIN rules r ON r.type = 'html' AND "
                "regexp_matches(html, r.pattern)) GROUP BY ALL HAVING true",
        "hits§": "SELECT site, tech_id, name, category, signal_no, type, confidence, weight, text, "
                 "version FROM hit§ UNION ALL "
                 "SELECT site, tech_id, name, category, signal_no, type, confidence, weight, "
                 "signal_name || ': ' || v, CASE WHEN version_group = 1 THEN "
                 "nullif(regexp_extract(v, pattern, 1), '') END FROM (SELECT site, r.*, "
                 f"CASE signal_name {header_signal} END AS v FROM ho§ JOIN rules r "
                 "ON r.type = 'header') WHERE regexp_matches(v, pattern) UNION ALL "
                 "SELECT site, tech_id, name, category, signal_no, type, confidence, weight, "
                 "'cookie ' || list_filter(cookie_names, lambda n: regexp_matches(n, pattern))[1], "
                 "NULL FROM sr§ JOIN rules r ON r.type = 'cookie' WHERE page_count > 0 AND "
                 "len(list_filter(cookie_names, lambda n: regexp_matches(n, pattern))) > 0 "
                 "UNION ALL SELECT site, tech_id, name, category, signal_no, type, confidence, "
                 "weight, 'generator: ' || generator, CASE WHEN version_group = 1 THEN "
                 "nullif(regexp_extract(generator, pattern, 1), '') END FROM sr§ JOIN rules r ON "
                 "r.type = 'meta_generator' WHERE regexp_matches(generator, pattern)",
        "tx§": "SELECT site, tech_id, type, min(signal_no) AS first_no, arg_max(text, signal_no) "
               "AS text FROM hits§ GROUP BY ALL",
        "tech§": "SELECT t.*, latest, detection, "
                 f"CASE WHEN version IS NOT NULL AND latest IS NOT NULL THEN {version_key('version')}"
                 f" < {version_key('latest')} END AS is_outdated, "
                 f"CASE WHEN version IS NOT NULL AND latest IS NOT NULL THEN greatest(0, "
                 f"{version_key('latest')}[1] - {version_key('version')}[1]) END AS versions_behind "
                 "FROM (SELECT site, tech_id, name, category, arg_min(version, signal_no) FILTER "
                 "(version IS NOT NULL) AS version, arg_max(confidence, weight) AS confidence, "
                 "max(weight) AS weight FROM hits§ GROUP BY ALL) t JOIN (SELECT site, tech_id, "
                 "'{' || string_agg('\"' || type || '\":\"' || text || '\"', ',' ORDER BY first_no) "
                 "|| '}' AS detection FROM tx§ GROUP BY ALL) d USING (site, tech_id) "
                 "LEFT JOIN latest_known USING (tech_id)",
        "st§": "SELECT sr§.*, coalesce(n_tech, 0) AS n_tech, tech_names, c.tech_id AS cms_id, "
               "c.name AS cms_name, c.version AS cms_version, c.confidence AS cms_confidence, "
               "c.detection AS cms_detection, c.is_outdated AS cms_outdated, "
               "coalesce(c.versions_behind, 0) AS cms_behind, "
               "CASE WHEN page_count > 0 THEN coalesce(has_analytics, false) END AS has_analytics, "
               "CASE WHEN page_count > 0 THEN coalesce(has_cdn, false) END AS has_cdn, "
               "CASE WHEN page_count > 0 THEN coalesce(has_waf, false) END AS has_waf "
               "FROM sr§ LEFT JOIN (SELECT site, count(*) AS n_tech, "
               "list(name ORDER BY category, tech_id) AS tech_names, "
               "bool_or(category = 'analytics') AS has_analytics, bool_or(category = 'cdn') "
               "AS has_cdn, bool_or(category = 'waf') AS has_waf FROM tech§ GROUP BY site) "
               "USING (site) LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "
               "site ORDER BY weight DESC, tech_id) AS rn FROM tech§ WHERE category IN "
               "('cms', 'ecommerce')) WHERE rn = 1) c USING (site)",
        "mails§": "SELECT site, page_no, final_url, unnest(list_concat(list_transform("
                  "regexp_extract_all(html, '<a\\s[^>]*?href\\s*=\\s*[\"'']?\\s*mailto:([^\"''\\s>]*)', "
                  "1, 'i'), lambda a: trim(split_part(a, '?', 1))), "
                  f"regexp_extract_all(html, {mailpat}))) AS raw FROM pg§",
        "mail1§": "SELECT site, page_no, final_url, a, substr(a, strpos(a, '@') + 1) AS dom, "
                  "split_part(a, '@', 1) AS loc, regexp_extract(split_part(a, '@', 1), "
                  "'^([^._\\-+]*)', 1) AS head FROM (SELECT site, page_no, final_url, "
                  "lower(trim(trim(raw), '.,;:')) AS a FROM mails§) "
                  f"WHERE regexp_full_match(a, {mailpat})",
        "mail2§": f"SELECT *, {registrable('dom')} AS owner FROM mail1§",
        "mailok§": "SELECT *, CASE WHEN owner IS NOT NULL "
                   f"AND owner NOT IN {inlist(fixed.PLACEHOLDER_DOMAINS)} "
                   f"AND dom NOT IN {inlist(fixed.PLACEHOLDER_DOMAINS)} "
                   f"AND owner NOT IN {inlist(fixed.FREEMAIL_DOMAINS)} "
                   f"AND NOT regexp_matches(a, {q(fixed.ASSET_NAME_PATTERN)}) AND NOT "
                   f"(regexp_matches(loc, {q(fixed.PERSONAL_LOCAL_PATTERN)}) AND head NOT IN "
                   f"{inlist(fixed.ROLE_CATEGORIES)}) "
                   "THEN true ELSE false END AS business, coalesce(owner = site OR "
                   "split_part(owner, '.', 1) = split_part(site, '.', 1), false) AS own FROM mail2§",
        "phone1§": "SELECT site, page_no, final_url, unnest(list_concat(regexp_extract_all(html, "
                   "'<a\\s[^>]*?href\\s*=\\s*[\"'']\\s*tel:([^\"'']*)', 1, 'i'), regexp_extract_all("
                   + text_of(no_hidden("html")) + ", '\\+\\d[\\d ().\\x{00A0}/-]{5,24}\\d'))) AS raw "
                   "FROM pg§",
        "phonerow§": "SELECT site, page_no, final_url, 0 AS pos, CASE WHEN length(nat) BETWEEN "
                     "plan.lo AND plan.hi THEN '+' || plan.code || nat END AS num FROM (SELECT *, "
                     "CASE WHEN plan.trunk <> '' AND starts_with(rest, plan.trunk) THEN "
                     "substr(rest, length(plan.trunk) + 1) ELSE rest END AS nat FROM (SELECT *, "
                     "substr(d, length(plan.code) + 1) AS rest FROM (SELECT *, list_filter("
                     f"{plan}, lambda c: starts_with(d, c.code))[1] AS plan FROM (SELECT *, "
                     "regexp_replace(raw, '\\D', '', 'g') AS d FROM phone1§ WHERE "
                     "starts_with(regexp_replace(raw, '[^\\d+]', '', 'g'), '+')))))",
        "socialrow§": "SELECT * FROM (" + social + ") WHERE NOT regexp_matches(u, "
                      + q(fixed.SOCIAL_NOISE_PATTERN) + ")",
        "craw§": _contacts().replace("FROM mailok§)", "FROM mailok§ WHERE business AND own)"),
        "ct§": "SELECT site, kind, norm, arg_min({'category': category, 'value': value, 'source_url': "
               "final_url, 'rank': rank}, rank::BIGINT * 1000000000 + page_no * 100 + pos) AS b FROM craw§ "
               "GROUP BY ALL",
        "con§": "SELECT site, kind, b.category AS category, b.value AS value, norm AS "
                "normalized_value, b.source_url AS source_url, b.rank AS rank FROM ct§",
        "sc§": "SELECT site, coalesce(n_contacts, 0) AS n_contacts, coalesce(n_emails, 0) AS "
               "n_emails, coalesce(n_phones, 0) AS n_phones, coalesce(n_socials, 0) AS n_socials, "
               "coalesce(n_forms, 0) AS n_forms, coalesce(n_addresses, 0) AS n_addresses, "
               "primary_email, primary_phone, page_count FROM sr§ LEFT JOIN (SELECT site, count(*) "
               "AS n_contacts, " + ", ".join(
                   f"count(*) FILTER (kind = '{k}') AS n_{k}{'es' if k == 'address' else 's'}"
                   for k in fixed.CONTACT_KINDS) +
               ", first(value ORDER BY rank, normalized_value) FILTER (kind = 'email') AS "
               "primary_email, first(value ORDER BY rank, normalized_value) FILTER "
               "(kind = 'phone') AS primary_phone FROM con§ GROUP BY site) USING (site)",
        "f§": _findings().replace("home_url,", "home_url_ok,").replace(
            "CAST(home_url AS", "CAST(home_url_ok AS"),
        "opp0§": _opportunities(),
        "opp§": "SELECT a.* FROM opp0§ a WHERE NOT EXISTS (SELECT 1 FROM opp0§ b WHERE b.site = "
                "a.site AND b.supersedes = a.rule_id)",
        "sco§": _scores(),
        "scores§": "SELECT site, "
                   + clamp("lead_contact + lead_signals + lead_reachable + lead_engagement")
                   + " AS lead, "
                   + clamp("web_performance + web_mobile + web_delivery + web_transport + "
                           "web_modernity") + " AS website, "
                   + clamp("sec_tls + sec_headers + sec_email_auth + sec_disclosure + "
                           "coalesce(sec_penalty, 0)") + " AS security, "
                   + clamp("(opp_value + opp_urgency + opp_reach) * CASE WHEN opp_reach = 0 THEN "
                           "0.5::DOUBLE ELSE 1.0::DOUBLE END") + " AS opportunity FROM sco§",
    }
    return {name.replace("§", f"_{scan}"): sql.replace("§", f"_{scan}")
            for name, sql in ctes.items()}


def all_ctes() -> dict[str, str]:
    ctes: dict[str, str] = {}
    for scan in cap.SCANS:
        ctes.update(chain(scan))
    return ctes


CTES = all_ctes()


def with_ctes(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the CTEs it refers to, in dependency order."""
    pool = {**CTES, **(extra or {})}
    order: list[str] = []

    def visit(text: str):
        for name in dict.fromkeys(re.findall(r"[A-Za-z_][A-Za-z0-9_]*", text)):
            if name in pool and name not in order:
                visit(pool[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    # every chain CTE is read more than once, so keep it computed
    body = ",\n".join(f"{n} AS MATERIALIZED ({pool[n]})" for n in order)
    return f"WITH {body}\n{sql}" if order else sql
