"""Rule packs from tables: the same hits as literal packs, whatever their length; bad rows stop them."""

import re

import pytest
from conftest import PAGES, SITES, SUFFIXES, page, site
from pyspark.sql import functions as F

from sitelens import rules
from sitelens.functions.columns import lookup
from sitelens.operators import facts, technologies
from sitelens.operators.rule_packs import PackError, Words, folded, load_opportunity_rules, load_pack, needles_of
from sitelens.plans import catalog_packs
from sitelens.plans.analyze import analyze
from sitelens.rules import Fingerprint, Signal

MATCHES = {
    r"wp-content|wp-includes": ["a WP-Content b", "wp-includes"],
    r"/js/jquery-(\d+\.\d+)": ["/js/jquery-3.4"],
    r"ab+cde?fgh": ["abbbcdfgh", "abcdefgh"],
    r"colou?r:\s*red": ["color: RED", "colour:red"],
    r"(?:foo|bar)baz": ["foobaz", "BARBAZ"],
    r"\bkla\.ro\b": ["kla.ro"],
    r"[a-z]{3}script": ["abcscript"],
    r"a{2,3}bcd": ["aabcd"],
    r"^server$|^nginx": ["server", "nginx/1"],
    r"x\x41yz": ["xAyz"],
    r"\p{L}+\.example": ["ä.example"],
    r"skiiers": ["S\u212a\u0130\u0131er\u017f".replace("\u0130", "i")],
    r"[]a]bcd": ["]bcd"],
    r"a.c": ["abc"],
    r"(optional)?": [""],
    r"ab|cdefg": ["ab"],
    r"\Qa.b\Ecd": ["a.bcd"],
    r"one(two|three)four": ["onetwofour", "onethreefour"],
}


def test_every_match_holds_a_needle():
    for pattern, texts in MATCHES.items():
        needles = needles_of(pattern)
        for text in texts:
            if r"\Q" not in pattern and r"\p" not in pattern:
                assert re.search(pattern, folded(text), re.IGNORECASE), (pattern, text)
            assert not needles or any(n in folded(text) for n in needles), (pattern, text, needles)
    assert needles_of("wp-content|wp-includes") == ("wp-content", "wp-includes")
    assert needles_of(r"/js/jquery-(\d+)") == ("/js/jquery-",)
    for pattern in (r"a.c", r"ab|cdefg", r"(optional)?", r"\Qa.b\Ecd", r"(?x) a b c d"):
        assert needles_of(pattern) == ()
    # every shipped pattern that declares needles is found by its own as well
    shipped = [s for f in rules.FINGERPRINTS for s in f.signals if s.type == "html"]
    assert sum(bool(needles_of(s.pattern)) for s in shipped) > 0.6 * len(shipped)


def test_words_name_the_rules_worth_running():
    words = Words()
    for number, pattern in enumerate(["wp-content", "wp-cont", r"\d+", "drupal|wp-content"]):
        words.add(number, pattern)
    find = words.finder()
    assert find("X WP-CONTENT") == {0, 1, 2, 3} and find("Drupal") == {2, 3} and find(None) == {2} and find("") == {2}


def signals(spark, rows):
    return spark.createDataFrame(rows, rules.SIGNAL_SCHEMA)


ROWS = [
    ("wp", "WordPress", "cms", 1, "html", None, r"/wp-content/themes/x-(\d+)", 1, "certain"),
    ("wp", "WordPress", "cms", 2, "cookie", "wp", r"^wp[-_]", None, "likely"),
    ("wp", "WordPress", "cms", 3, "meta_generator", None, r"WordPress ([\d.]+)", 1, "certain"),
    ("ng", "nginx", "server", 1, "header", "Server", r"nginx(?:/([\d.]+))?", 1, "certain"),
    ("odd", "Odd", "framework", 1, "html", None, r"a.c", None, "possible"),
    ("url", "Url", "framework", 1, "url", None, r"/Contact", None, "possible"),
    ("old", "Old", "framework", 1, "script_src", None, r"s\u0131lly", None, "likely"),
]


def small(spark):
    cookie = dict(name="WP_session", secure=True, http_only=True, same_site=None, source_url="u")
    sites = [site("a.com", cookies=[cookie]), site("b.com"), site("none.com"), site("c.com", cookies=[cookie])]
    pages = [
        page("a.com", 1, headers={"Server": "NGINX/1.18"}, html='<meta name="generator" content="WordPress 5.4"><p>axc</p>'),
        page("a.com", 2, page_type="contact", final_url="https://a.com/contact", html="/WP-content/themes/X-12 S\u0131lly"),
        page("b.com", 1, headers={"server": "nginx"}, html=None),
        page("c.com", 1, html=""),
    ]
    return spark.createDataFrame(sites, SITES), spark.createDataFrame(pages, PAGES)


def listed(spark, pack, latest=None):
    sites, pages = small(spark)
    firsts = facts.first_facts(facts.page_facts(pages, pack, ("page", "signals")))
    options = {} if latest is None else {"latest": latest}
    frame = technologies.with_technologies(facts.site_frame(sites, firsts=firsts), pack, **options)
    return sorted((r.site, r.tech_id, r.name, r.category, r.version, r.confidence, tuple(sorted(r.evidence.items())), r.is_outdated,
                   r.versions_behind, r.latest) for r in technologies.explode_technologies(frame).collect())


def test_same_as_a_literal_pack_at_any_length(spark):
    latest = {"wp": "6.7", "ng": "1.27.3"}
    frame = spark.createDataFrame(sorted(latest.items()), "tech_id string, latest string")
    literal = listed(spark, rules.fingerprints_from_rows(signals(spark, ROWS).collect()), latest)
    assert {(r[0], r[1]) for r in literal} == {
        ("a.com", "wp"), ("a.com", "ng"), ("a.com", "odd"), ("a.com", "url"), ("a.com", "old"), ("b.com", "ng"), ("c.com", "wp")}
    assert listed(spark, load_pack(signals(spark, ROWS), frame)) == literal
    others = [(f"t{i}", f"T{i}", "analytics", 1, ("html", "header", "cookie", "meta_generator")[i % 4], "x-h" if i % 4 in (1, 2) else None,
               f"nothing-like-{i}", None, "likely") for i in range(5000)]
    assert listed(spark, load_pack(signals(spark, ROWS + others), frame)) == literal


def test_plan_does_not_grow_with_the_pack(spark):
    sites, pages = small(spark)

    def nodes(n):
        rows = [(f"t{i}", f"T{i}", "analytics", 1, "html", None, f"needle-{i}", None, "likely") for i in range(n)]
        pack = load_pack(signals(spark, rows))
        firsts = facts.first_facts(facts.page_facts(pages, pack, ("page", "signals")))
        frame = technologies.with_technologies(facts.site_frame(sites, firsts=firsts), pack)
        plan = frame.select("site", "technologies")._jdf.queryExecution().optimizedPlan()
        return plan.numberedTreeString().count("\n")

    assert nodes(100) == nodes(4000)


def test_whole_analysis_takes_a_pack(spark):
    sites, pages = small(spark)
    frame = analyze(sites, pages, fingerprints=load_pack(signals(spark, ROWS)), suffixes=SUFFIXES)
    got = {r.site: sorted(t["tech_id"] for t in r.technologies) for r in frame.select("site", "technologies", "scores").collect()}
    assert got["a.com"] == ["ng", "odd", "old", "url", "wp"] and got["none.com"] == []


@pytest.mark.parametrize(("change", "said"), [
    ({4: "header"}, "requires a name"), ({2: "gadget"}, "unknown category"), ({4: "smell"}, "unknown signal type"),
    ({6: "a(b"}, "broken pattern"), ({6: "[z-a]", 7: None}, "broken pattern"), ({6: " "}, "missing pattern"), ({7: 4}, "no such group"),
    ({8: "sure"}, "unknown confidence"), ({0: ""}, "missing id"), ({0: "ng", 1: "Other", 3: 9}, "several names"), ({0: "ng"}, "duplicate id"),
])
def test_a_bad_row_stops_the_pack(spark, change, said):
    bad = ["new", "New", *ROWS[0][2:]]
    for at, value in change.items():
        bad[at] = value
    with pytest.raises(PackError, match=said):
        load_pack(signals(spark, [*ROWS, tuple(bad)]))


def opportunity_tables(spark, head, conditions):
    return spark.createDataFrame(head, rules.OPPORTUNITY_SCHEMA), spark.createDataFrame(conditions, rules.CONDITION_SCHEMA)


def test_shipped_opportunity_rules_survive_the_tables(spark):
    evidence = spark.createDataFrame([(r.id, n, c) for r in rules.OPPORTUNITY_RULES for n, c in enumerate(r.evidence_from)],
                                     "rule_id string, position int, check_id string")
    beaten = spark.createDataFrame([(r.id, s) for r in rules.OPPORTUNITY_RULES for s in r.supersedes], "rule_id string, superseded string")
    loaded = load_opportunity_rules(rules.opportunity_table(spark), rules.conditions_table(spark), evidence, beaten)
    assert sorted(loaded, key=lambda r: r.id) == sorted(rules.OPPORTUNITY_RULES, key=lambda r: r.id)


@pytest.mark.parametrize(("head", "condition", "said"), [
    (("r", "t", "magic", "low", "x", "p"), ("r", 1, "finding_failed", "HDR-01", None, None, None), "bad category"),
    (("r", "t", "security", "low", "x", "p"), ("r", 1, "guess", "HDR-01", None, None, None), "unknown condition kind"),
    (("r", "t", "security", "low", "x", "p"), ("r", 1, "finding_failed", None, None, None, None), "missing check_id"),
    (("r", "t", "security", "low", "x", "p"), ("r", 1, "artifact_equals", None, "cms", "cms", None), "missing value"),
    (("r", "t", "security", "low", "x", "p"), ("s", 1, "finding_failed", "HDR-01", None, None, None), "without a rule"),
])
def test_a_bad_opportunity_rule_stops_the_pack(spark, head, condition, said):
    with pytest.raises(PackError, match=said):
        load_opportunity_rules(*opportunity_tables(spark, [head], [condition]))


def test_long_lookup(spark):
    entries = {f"k{i}": str(i) for i in range(3000)}
    find = lookup(entries)
    rows = spark.range(3100).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"), "id")
    assert {r[0]: r[1] for r in rows.select("id", find(F.col("k"))).collect()} == {i: str(i) if i < 3000 else None for i in range(3100)}


def test_pack_of_the_query_is_long(spark):
    assert len(catalog_packs.long_pack(spark, "/root/testdata/sf0.001")) > 250


def test_fingerprint_types_stay_usable(spark):
    pack = (Fingerprint("x", "X", "cms", (Signal("html", None, "axc", None, "likely"),)),)
    assert [r[1] for r in listed(spark, pack)] == ["x"]
