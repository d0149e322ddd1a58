"""Robots rules by prefix, and addresses inside addresses."""

import random

from pyspark.sql import functions as F

from sitelens.operators.crawlplan import is_public_address, robots_allowed


def verdict(path, rules):
    best = {"allow": -1, "disallow": -1}
    for kind, rule in rules:
        if rule.endswith("$"):
            hit = path == rule[:-1]
        elif "*" in rule:
            at, hit = 0, True
            for n, part in enumerate(rule.split("*")):
                found = path.find(part, at)
                hit = hit and found >= 0 and (n > 0 or found == 0)
                at = found + len(part)
        else:
            hit = path.startswith(rule)
        if hit and rule:
            best[kind] = max(best[kind], len(rule))
    return best["disallow"] < 0 or best["allow"] >= best["disallow"]


def test_longest_rule_decides(spark):
    random.seed(2)
    part = lambda: random.choice(["/a", "/b", "/é", "/a.b", "/?", "x", "*", "$", "/"])
    rules = {(s, random.choice(["allow", "disallow"]), "/" + "".join(part() for _ in range(random.randint(0, 3)))) for s in ("s", "t") for _ in range(40)}
    rules |= {("s", "disallow", ""), ("u", "disallow", "/")}
    paths = ["/" + "".join(random.choice(["a", "b", "é", "/", "a.b", "x"]) for _ in range(random.randint(0, 8))) for _ in range(80)]
    rows = [(s, f"https://h.com{p}", n) for n, p in enumerate(paths) for s in ("s", "t", "u", "none", None)] + [("s", None, 999)]
    urls = spark.createDataFrame([*rows, rows[0]], "site string, url string, allowed_before int")
    got = robots_allowed(urls, spark.createDataFrame(sorted(rules), "site string, verdict string, rule string"))
    assert got.columns == ["site", "url", "allowed_before", "allowed"]
    found = got.collect()
    assert len(found) == len(rows) + 1
    for r in found:
        own = [(v, rule) for s, v, rule in rules if s == r.site]
        want = True if r.url is None else verdict(r.url[len("https://h.com"):].split("?")[0], own)
        assert r.allowed == want, r
    assert 20 < sum(not r.allowed for r in found) < len(found) - 20


def test_addresses_inside_addresses(spark):
    public = ["8.8.8.8", "::ffff:8.8.8.8", "::ffff:0808:0808", "64:ff9b::808:808", "2606:4700::1111"]
    private = ["127.0.0.1", "::ffff:127.0.0.1", "::ffff:7f00:1", "::FFFF:0a00:1", "64:ff9b::7f00:1", "64:ff9b::10.0.0.1", "::", "::1",
               "::ffff:300.1.1.1", "1.2.3", "", None]
    frame = spark.createDataFrame([(a,) for a in [*public, *private]], "ip string")
    got = {r.ip: r.ok for r in frame.select("ip", is_public_address(F.col("ip")).alias("ok")).collect()}
    assert got == {**dict.fromkeys(public, True), **dict.fromkeys(private, False)}
