"""Rule tables: the same technologies as packs, at any length; bad rows stop them."""

import numpy as np
import pytest
from conftest import PAGES, SITES, page, site
from pyspark.sql import functions as F
from test_rule_packs import ROWS, signals, small

from sitelens.operators import facts, rule_packs, technologies
from sitelens.operators.rule_packs import PackError, load_pack, needles_of
from sitelens.operators.rule_table import load_rule_table, substrings


def rows_of(frame):
    return sorted((r.site, r.tech_id, r.name, r.category, r.version, r.confidence, tuple(sorted(r.evidence.items())), r.is_outdated,
                   r.versions_behind, r.latest) for r in frame.collect())


def by_pack(sites, pages, pack):
    firsts = facts.first_facts(facts.page_facts(pages, pack, ("page", "signals")))
    return rows_of(technologies.explode_technologies(technologies.with_technologies(facts.site_frame(sites, firsts=firsts), pack)))


def by_table(sites, pages, table):
    firsts = facts.first_facts(facts.page_facts(pages, table, ("page", "signals")))
    return rows_of(technologies.technology_table(technologies.hits_table(sites, firsts, table)))


def test_equal_substrings_have_equal_hashes():
    text = "<!-- AD 123 --> \U0001d11e ad 123"
    for k in (3, 7, len(text)):
        hashed = substrings(text, [k])
        parts = [text[i:i + k] for i in range(len(text) - k + 1)]
        assert len(set(zip(parts, hashed.tolist(), strict=True))) == len(set(parts)) == len(set(hashed.tolist()))
        assert all(substrings(p, [k])[0] == h for p, h in zip(parts, hashed, strict=True))
    assert len(substrings("", [3])) == len(substrings("ab", [3])) == 0 and substrings("abc", [3, 2]).dtype == np.uint64


def test_needles_reach_into_groups():
    assert needles_of(r"<!--\s*AD (12345 -->)") == ("ad 12345 -->",)
    assert needles_of(r"a(?:bc(?<v>d[^)]e)fg)hi") == ("efghi",)
    for pattern in (r"ab(cde)?fg", r"ab(cd|ef)g", r"ab(?!cd)e", r"ab(?i)c", r"(ab\)c)*d"):
        assert needles_of(pattern) == (), pattern


def test_same_as_a_pack(spark):
    sites, pages = small(spark)
    # twice a needle, a page twice, and pages of a site that is not listed
    more = [page("a.com", 2, page_type="contact", final_url="https://a.com/contact", html="Tail-5 and TAIL-77"),
            page("a.com", 7, html="tail-77 tail-9"), page("gone.com", 1, html="tail-5")]
    pages = pages.unionByName(spark.createDataFrame(more, PAGES))
    others = [(f"t{i}", f"T{i}", "analytics", 1, "html", None, f"tail-({i})", 1, "likely") for i in range(300)]
    others += [("two", "Two", "cms", 1, "html", None, "tail-77", None, "likely"), ("two", "Two", "cms", 2, "script_src", None, "x|tail-9", None, "possible")]
    latest = spark.createDataFrame([("wp", "6.7"), ("ng", "1.27.3")], "tech_id string, latest string")
    rules = signals(spark, ROWS + others)
    pack, table = load_pack(rules, latest), load_rule_table(rules, latest)
    expected = by_pack(sites, pages, pack)
    assert by_table(sites, pages, table) == expected
    assert {r[1] for r in expected} >= {"t5", "t7", "t77", "t9", "two", "wp", "ng", "odd"}
    assert {r["tech_id"] for r in table.core.rows} == {"wp", "ng", "odd", "two"}  # what has no literal to find on pages


def test_more_rules_than_a_pack_holds(spark, monkeypatch):
    monkeypatch.setattr(rule_packs, "MOST_RULES", 50)
    rules = signals(spark, [(f"t{i}", f"T{i}", "analytics", 1, "html", None, f"<!-- ad ({i}) -->", 1, "likely") for i in range(200)])
    with pytest.raises(PackError, match="more than 50"):
        load_pack(rules)
    sites = spark.createDataFrame([site("a.com")], SITES)
    pages = spark.createDataFrame([page("a.com", 1, html="<!-- AD 7 --><!-- ad 199 -->")], PAGES)
    assert [(r[1], r[4]) for r in by_table(sites, pages, load_rule_table(rules))] == [("t199", "199"), ("t7", "7")]


@pytest.mark.parametrize(("change", "said"), [
    ({4: "header"}, "requires a name"), ({2: "gadget"}, "unknown category"), ({6: "a(b"}, "broken pattern"), ({6: "[z-a]", 7: None}, "broken pattern"),
    ({6: "ab\\", 7: None}, "broken pattern"), ({6: "(?=abc)", 7: 1}, "no such group|broken pattern"), ({6: r"[(]abc", 7: 1}, "no such group|broken pattern"),
    ({0: "ng", 1: "Other", 3: 9}, "several names"), ({0: "ng"}, "duplicate id"),
])
def test_a_bad_row_stops_the_table(spark, change, said):
    bad = ["new", "New", *ROWS[0][2:]]
    for at, value in change.items():
        bad[at] = value
    with pytest.raises(PackError, match=said):
        load_rule_table(signals(spark, [*ROWS, tuple(bad)]))


def test_few_strangers_pass_the_bitmap(spark):
    table = load_rule_table(signals(spark, [(f"t{i}", f"T{i}", "analytics", 1, "html", None, f"<!-- ad ({i}) -->", 1, "likely") for i in range(2000)]))
    text = " ".join(f"{i * 7919:x}" for i in range(8000)) + "<!-- ad 1234 --><!-- AD 77 -->"
    pages = spark.createDataFrame([(text,)], "html string")
    found = set(pages.select(table.candidates(pages.html, F.lit(""))).first()[0])
    own = {int(substrings(n, [len(n)]).view(np.int64)[0]) for n in ("<!-- ad 1234 -->", "<!-- ad 77 -->")}
    tried = len(substrings(text, table.lengths))
    # one in 32 by one bit of each needle, whose candidates fill the memory of tasks
    assert tried > 100_000 and len(found & own) == 2 and len(found) < tried / 500
