"""Rule packs of any length from tables: validated, then matched through a word index.

A pack arrives as DataFrames (signals, current versions, opportunity rules and their
conditions). ``load_pack`` checks every row and stops with ``PackError`` if one is bad,
also if a pattern does not compile.

Few patterns of a long pack can match a given page. Each pattern has literals of which
every match holds one (its *needles*). They form an Aho-Corasick automaton, which reads
a text once and names the rules whose patterns are worth running; patterns without a
needle always are. The patterns themselves run in the JVM, against the text in place,
so sources never leave their stage, and the plan is as large for five rules as for
five thousand: the pack is a literal and a list of numbers is all that passes.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens import fixed
from sitelens.functions.columns import lookup
from sitelens.rules import Condition, OpportunityRule

MOST_RULES = 100_000  # a pack goes to every task, so its length is checked; ``rule_table`` takes any number
LEAST_NEEDLE = 3
PAGE_TYPES = ("html", "script_src", "url")
RULE = ("struct<tech_id:string,signal_no:int,key:string,type:string,name:string,pattern:string,"
        "grp:int,confidence:string,weight:double>")
#: letters beyond ASCII that patterns ignoring case take for ASCII ones (fixed values)
CASE_TWINS = {"\u0130": "i", "\u0131": "i", "\u017f": "s", "\u212a": "k"}


class PackError(ValueError):
    """A pack that must not be used; the message lists the first errors."""


# --- needles -----------------------------------------------------------------------------
def class_end(pattern: str, i: int) -> int:
    """The place behind the class that begins at ``i``."""
    nested, j = 1, i + 1
    while j < len(pattern) and nested:
        if pattern[j] == "\\":
            j += 1
        elif pattern[j] == "[":
            nested += 1
        elif pattern[j] == "]" and not (j == i + 1 or pattern[i + 1:j] == "^"):
            nested -= 1
        j += 1
    return j


def plain_group(pattern: str, i: int) -> tuple[int, int] | None:
    """Where the inside of the group at ``i`` begins and ends, if it stands in every match just once and has one alternative."""
    opening = re.compile(r"\((?:\?:|\?<[A-Za-z]\w*>|(?!\?))").match(pattern, i)
    if opening is None:
        return None
    nested, j = 1, opening.end()
    while j < len(pattern):
        sign = pattern[j]
        if sign == "[":
            j = class_end(pattern, j)
            continue
        if sign == "\\":
            j += 1
        elif sign == "(":
            nested += 1
        elif sign == ")":
            nested -= 1
            if nested == 0:
                return None if pattern[j + 1:j + 2] in ("?", "*", "+", "{") else (opening.end(), j)
        elif sign == "|" and nested == 1:
            return None
        j += 1
    return None


def folded(text: str) -> str:
    for letter, plain in CASE_TWINS.items():
        if letter in text:
            text = text.replace(letter, plain)
    return text.lower()


def needles_of(pattern: str) -> tuple[str, ...]:
    """Literals of which every match of the pattern holds at least one, in lower case.

    Empty where none of LEAST_NEEDLE characters can be told for some alternative.
    Classes, whatever is optional, and groups with several alternatives count as unknown.
    """
    if re.search(r"\\Q|\(\?[a-zA-Z]*x", pattern):  # quoting and comments are left alone
        return ()
    alternatives, runs, run, depth, i = [], [], "", 0, 0
    closing: set[int] = set()

    def end_run(drop: int = 0) -> None:
        nonlocal run
        runs.append(run[:len(run) - drop])
        run = ""

    while i < len(pattern):
        sign = pattern[i]
        step = 1
        if sign == "\\":
            following = pattern[i + 1:i + 2]
            step = 2
            if depth == 0 and following and not following.isalnum():
                run += following
            elif depth == 0:
                end_run()
                # the digits or name of \x41, \u0041, \p{L} are no literal either
                more = re.match(r"\\(?:x[0-9A-Fa-f]{2}|x\{[^}]*\}|u[0-9A-Fa-f]{4}|[pPkN]\{[^}]*\}|k<[^>]*>|0[0-7]+|c.|\d+)", pattern[i:])
                step = len(more.group(0)) if more else 2
        elif sign == "[":
            step = class_end(pattern, i) - i
            if depth == 0:
                end_run()
        elif sign == "(" and depth == 0 and (inside := plain_group(pattern, i)):
            step = inside[0] - i
            closing.add(inside[1])
        elif sign == "(":
            if depth == 0:
                end_run()
            depth += 1
        elif sign == ")":
            depth -= i not in closing
        elif depth:
            pass
        elif sign == "|":
            end_run()
            alternatives.append(runs)
            runs = []
        elif sign in "?*{":
            end_run(drop=1)
            if sign == "{" and "}" in pattern[i:]:
                step = pattern.index("}", i) - i + 1
        elif sign == "+":
            end_run()
        elif sign in ".^$":
            end_run()
        else:
            run += sign
        i += step
    end_run()
    alternatives.append(runs)
    best = [folded(max(r, key=len)) for r in alternatives]
    return tuple(best) if min(map(len, best)) >= LEAST_NEEDLE else ()


# --- the compiled pack ----------------------------------------------------------------------
class Words:
    """Rules by needle; built into an automaton in the task that uses it."""

    def __init__(self) -> None:
        self.by_needle: dict[str, list[int]] = {}
        self.always: list[int] = []

    def add(self, number: int, pattern: str) -> None:
        needles = needles_of(pattern)
        for needle in needles:
            self.by_needle.setdefault(needle, []).append(number)
        if not needles:
            self.always.append(number)

    def finder(self):
        if not self.by_needle:
            return lambda text: set(self.always)
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for needle, numbers in self.by_needle.items():
            automaton.add_word(needle, numbers)
        automaton.make_automaton()

        def find(text: str | None) -> set[int]:
            met = set(self.always)
            for _, numbers in automaton.iter(folded(text or "")):
                met.update(numbers)
            return met

        return find


class RulePack:
    """A checked technology pack; pass it as ``fingerprints`` wherever a tuple of them goes."""

    def __init__(self, rows: list, latest: dict[str, str]) -> None:
        self.rows = sorted(rows, key=lambda r: (r["tech_id"], r["signal_no"]))
        self.latest = latest
        self.names = {r["tech_id"]: r["name"] for r in self.rows}
        self.categories = {r["tech_id"]: r["category"] for r in self.rows}

    def __len__(self) -> int:
        return len(self.rows)

    def entry(self, r) -> dict:
        return {"tech_id": r["tech_id"], "signal_no": r["signal_no"], "key": f"{r['tech_id']}#{r['signal_no']}", "type": r["type"],
                "name": r["signal_name"], "pattern": f"(?iu){r['pattern']}", "grp": r["version_group"], "confidence": r["confidence"],
                "weight": fixed.CONFIDENCE_WEIGHT[r["confidence"]]}

    def table(self) -> Column:
        """All rules by number, as one literal."""
        return F.from_json(F.lit(json.dumps([self.entry(r) for r in self.rows])), f"array<{RULE}>")

    def rules_for(self, numbers: Column) -> Column:
        table = self.table()
        return F.transform(numbers, lambda i: F.get(table, i))

    def by_key(self):
        """key -> rule, for keys that came out of the page facts."""
        return lookup({e["key"]: e for e in map(self.entry, self.rows) if e["type"] in PAGE_TYPES}, RULE)

    def words(self, *types: str, name: str | None = None) -> Words:
        words = Words()
        for number, r in enumerate(self.rows):
            if r["type"] in types and (name is None or (r["signal_name"] or "").lower() == name):
                words.add(number, r["pattern"])
        return words

    # numbers of the rules whose patterns are worth running
    def page_candidates(self, html: Column, url: Column) -> Column:
        in_html, in_url = self.words("html", "script_src"), self.words("url")

        @F.pandas_udf("array<int>")
        def candidates(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            html_finder, url_finder = in_html.finder(), in_url.finder()
            for pages, urls in parts:
                yield pd.Series([sorted(html_finder(h) | url_finder(u)) for h, u in zip(pages, urls, strict=True)])

        return candidates(html, url)

    def site_candidates(self, headers: Column, cookie_names: Column, generator: Column) -> Column:
        named = sorted({r["signal_name"].lower() for r in self.rows if r["type"] == "header"})
        by_header = {name: self.words("header", name=name) for name in named}
        in_cookies, in_generator = self.words("cookie"), self.words("meta_generator")

        @F.pandas_udf("array<int>")
        def candidates(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            finders = {name: words.finder() for name, words in by_header.items()}
            cookie_finder, generator_finder = in_cookies.finder(), in_generator.finder()
            for names, values, cookies, generators in parts:
                out = []
                for keys, texts, jar, said in zip(names, values, cookies, generators, strict=True):
                    met = set()
                    for key, text in zip(keys if keys is not None else (), texts if texts is not None else (), strict=True):
                        if key in finders:
                            met |= finders[key](text)
                    if jar:
                        met |= cookie_finder(jar)
                    if said:
                        met |= generator_finder(said)
                    out.append(sorted(met))
                yield pd.Series(out)

        return candidates(F.map_keys(headers), F.map_values(headers), F.array_join(cookie_names, "\n"), generator)


def matched(text: Column, rule: Column) -> Column:
    return F.coalesce(F.rlike(text, rule["pattern"]), F.lit(False))


def version_in(text: Column, rule: Column) -> Column:
    """Text of the rule's capture group, NULL where it names none."""
    return F.when(rule["grp"].isNotNull(), F.nullif(F.trim(F.call_function("regexp_extract", text, rule["pattern"], rule["grp"])), F.lit("")))


def site_hits(pack: RulePack, hit: str) -> Column:
    """Hits of header, cookie and generator rules on a site row."""
    names = F.transform("cookies", lambda c: c["name"])
    numbers = pack.site_candidates(F.col("home.headers"), names, F.col("generator"))
    is_ = lambda rule, kind: rule["type"] == kind

    def value(rule: Column) -> Column:
        return F.when(is_(rule, "header"), F.element_at(F.col("home.headers"), F.lower(rule["name"]))).when(
            is_(rule, "cookie"), F.get(F.filter(names, lambda n: matched(n, rule)), F.lit(0))).otherwise(F.col("generator"))

    def as_hit(found: Column) -> Column:
        rule, text = found["rule"], found["text"]
        shown = F.when(is_(rule, "header"), F.concat(rule["name"], F.lit(": "), text)).when(
            is_(rule, "cookie"), F.concat(F.lit("cookie "), text)).otherwise(F.concat(F.lit("generator: "), text))
        return F.struct(rule["tech_id"].alias("tech_id"), rule["signal_no"].alias("signal_no"), rule["type"].alias("type"),
                        rule["confidence"].alias("confidence"), rule["weight"].alias("weight"), shown.alias("text"),
                        F.when(~is_(rule, "cookie"), version_in(text, rule)).alias("version")).cast(hit)

    valued = F.transform(pack.rules_for(numbers), lambda r: F.struct(r.alias("rule"), value(r).alias("text")))
    return F.transform(F.filter(valued, lambda v: matched(v["text"], v["rule"])), as_hit)


def page_hits(pack: RulePack, hit: str) -> Column:
    """Hits of page rules, from the first facts of the site."""
    rule_of = pack.by_key()

    def as_hit(found: Column) -> Column:
        rule = rule_of(found["key"])
        return F.struct(rule["tech_id"].alias("tech_id"), rule["signal_no"].alias("signal_no"), rule["type"].alias("type"),
                        rule["confidence"].alias("confidence"), rule["weight"].alias("weight"), found["text"].alias("text"),
                        found["version"].alias("version")).cast(hit)

    none = F.array().cast("array<struct<key:string,text:string,version:string>>")
    # facts that were stored under another pack have keys this one lacks
    return F.filter(F.transform(F.coalesce(F.col("signals"), none), as_hit), lambda h: h["tech_id"].isNotNull())


def page_facts(pack: RulePack, make_fact) -> Column:
    """Signal facts of a page whose candidates are in ``candidates``."""
    return facts_of(pack.rules_for(F.col("candidates")), functools.partial(make_fact, "signal"))


def facts_of(rules: Column, make_fact) -> Column:
    """Facts of the ``rules`` that match a page."""
    text_of = lambda rule: F.when(rule["type"] == "url", F.col("final_url")).otherwise(F.col("html"))

    def as_fact(rule: Column) -> Column:
        text = text_of(rule)
        shown = F.when(rule["type"] == "url", text).otherwise(F.call_function("regexp_extract", text, rule["pattern"], F.lit(0)))
        return make_fact(rule["key"], 0, 0, text=shown, extra=version_in(text, rule))

    found = F.filter(rules, lambda rule: matched(text_of(rule), rule))
    return F.transform(found, as_fact)


# --- loading ------------------------------------------------------------------------------------
def bounded(rows: DataFrame, what: str) -> list:
    found = rows.limit(MOST_RULES + 1).collect()
    if len(found) > MOST_RULES:
        raise PackError(f"more than {MOST_RULES} {what}")
    return found


def broken_patterns(spark: SparkSession, rows: list) -> list[str]:
    """Patterns that the engine which will run them cannot compile, or whose group does not exist."""
    pattern, errors = spark._jvm.java.util.regex.Pattern, []
    for r in rows:
        name = f"{r['tech_id']}#{r['signal_no']}"
        try:
            groups = pattern.compile(f"(?iu){r['pattern']}").matcher("").groupCount()
        except Exception as error:  # the JVM's PatternSyntaxException
            errors.append(f"{name}: broken pattern: {str(getattr(error, 'java_exception', error)).splitlines()[0]}")
            continue
        if r["version_group"] is not None and not 0 <= r["version_group"] <= groups:
            errors.append(f"{name}: no such group")
    return errors


def stop_on(errors: list[str], what: str) -> None:
    if errors:
        more = f" and {len(errors) - 10} more" if len(errors) > 10 else ""
        raise PackError(f"{what}: " + "; ".join(sorted(errors)[:10]) + more)


def load_pack(signals: DataFrame, latest: DataFrame | None = None) -> RulePack:
    """The pack of a signals table (``rules.SIGNAL_SCHEMA``) and a table (tech_id, latest).

    One bad row stops it: nothing is analysed with half a pack.
    """
    from sitelens.operators.technologies import rules_validate

    rows = bounded(signals, "signals")
    rejected = rules_validate(signals)[1]
    stop_on([f"{r['tech_id']}#{r['signal_no']}: {r['reason']}" for r in rejected.limit(MOST_RULES).collect()], "technology rules")
    stop_on(broken_patterns(signals.sparkSession, rows), "technology rules")
    described: dict = {}
    for r in rows:
        described.setdefault(r["tech_id"], set()).add((r["name"], r["category"]))
    stop_on([f"{i}: several names or categories" for i, d in described.items() if len(d) > 1], "technology rules")
    versions = {} if latest is None else {r["tech_id"]: r["latest"] for r in bounded(latest, "versions")}
    return RulePack(rows, versions)


def load_opportunity_rules(rules: DataFrame, conditions: DataFrame, evidence_from: DataFrame | None = None,
                           supersedes: DataFrame | None = None) -> tuple[OpportunityRule, ...]:
    """Opportunity rules from tables: rules and conditions (``rules.OPPORTUNITY_SCHEMA``,
    ``CONDITION_SCHEMA``), the checks whose evidence fills a text (rule_id, position,
    check_id), and what a rule replaces (rule_id, superseded). One bad row stops it.
    """
    from sitelens.operators.opportunities import opportunity_rules_validate

    errors = [f"{r['rule_id']}: {r['reason']}" for r in opportunity_rules_validate(rules, conditions).collect()]
    head, parts = bounded(rules, "rules"), sorted(bounded(conditions, "conditions"), key=lambda r: (r["rule_id"], r["cond_no"]))
    known = {r["rule_id"] for r in head}
    for r in parts:
        wanted = ("check_id",) if (r["kind"] or "").startswith("finding_") else ("analyzer", "key")
        wanted += ("value",) if r["kind"] == "artifact_equals" else ()
        errors += [f"{r['rule_id']}#{r['cond_no']}: missing {c}" for c in wanted if not r[c]]
    errors += [f"{i}: conditions without a rule" for i in {r["rule_id"] for r in parts} - known]
    errors += [f"{i}: no condition" for i in known - {r["rule_id"] for r in parts}]
    proofs = [] if evidence_from is None else sorted(bounded(evidence_from, "evidence rows"), key=lambda r: (r["rule_id"], r["position"]))
    beaten = [] if supersedes is None else sorted(bounded(supersedes, "supersedes rows"), key=lambda r: (r["rule_id"], r["superseded"]))
    errors += [f"{r['rule_id']}: supersedes unknown {r['superseded']}" for r in beaten if r["superseded"] not in known]
    stop_on(errors, "opportunity rules")
    of = lambda rows, rule: [r for r in rows if r["rule_id"] == rule["rule_id"]]
    return tuple(OpportunityRule(
        r["rule_id"], r["title"], r["category"], r["urgency"],
        tuple(Condition(c["kind"], c["check_id"], c["analyzer"], c["key"], c["value"]) for c in of(parts, r)),
        r["template"], r["pitch"], tuple(e["check_id"] for e in of(proofs, r)), tuple(b["superseded"] for b in of(beaten, r)))
        for r in head)
