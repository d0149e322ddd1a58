"""Technology fingerprints matched against a site's signals.

Page-source signals arrive as first facts (see ``facts``); header, cookie and
generator signals are tested on the site row. A header rule looks its header up
in the map, so only signals of the right kind and name ever meet a pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens import fixed
from sitelens.functions.columns import built_once, first_where, literal_map, lookup
from sitelens.functions.versions import is_outdated, major_versions_behind
from sitelens.operators import rule_packs, rule_table
from sitelens.operators.facts import has_group, signal_key, site_frame
from sitelens.operators.rule_packs import RulePack
from sitelens.operators.rule_table import RuleTable
from sitelens.rules import FINGERPRINTS, LATEST_VERSIONS

HIT = (
    "struct<tech_id:string,signal_no:int,type:string,confidence:string,weight:double,"
    "text:string,version:string>"
)
CONFIDENCE_ORDER = ("certain", "likely", "possible")


def _hit(tech_id, number, signal, text: Column, version: Column) -> Column:
    return F.struct(
        F.lit(tech_id).alias("tech_id"),
        F.lit(number).alias("signal_no"),
        F.lit(signal.type).alias("type"),
        F.lit(signal.confidence).alias("confidence"),
        F.lit(fixed.CONFIDENCE_WEIGHT[signal.confidence]).alias("weight"),
        text.alias("text"),
        version.cast("string").alias("version"),
    ).cast(HIT)


def _captured(value: Column, signal) -> Column:
    """Version text of the rule's capture group; NULL without a usable group."""
    if not has_group(signal):
        return F.lit(None)
    text = F.regexp_extract(value, f"(?iu){signal.pattern}", signal.version_group)
    return F.nullif(F.trim(text), F.lit(""))


@built_once
def _site_hits(fingerprints) -> Column:
    """Hits of header, cookie and generator signals on the site row."""
    hits = []
    names = F.transform("cookies", lambda c: c["name"])
    for f in fingerprints:
        for number, s in enumerate(f.signals, start=1):
            pattern = f"(?iu){s.pattern}"
            if s.type == "header":
                value = F.element_at(F.col("home.headers"), s.name.lower())
                text = F.concat(F.lit(f"{s.name}: "), value)
                hits.append(F.when(value.rlike(pattern),
                                   _hit(f.id, number, s, text, _captured(value, s))))
            elif s.type == "cookie":
                name = first_where(names, _matches(pattern))
                text = F.concat(F.lit("cookie "), name)
                hits.append(F.when(name.isNotNull(), _hit(f.id, number, s, text, F.lit(None))))
            elif s.type == "meta_generator":
                value = F.col("generator")
                text = F.concat(F.lit("generator: "), value)
                hits.append(F.when(value.rlike(pattern),
                                   _hit(f.id, number, s, text, _captured(value, s))))
    return F.array_compact(F.array(*hits)) if hits else F.array().cast(f"array<{HIT}>")


def _matches(pattern: str):
    return lambda name: name.rlike(pattern)


@built_once
def _page_hits(fingerprints) -> Column:
    """Hits of page signals, re-keyed from the first facts by the rule pack."""
    table: dict[str, tuple] = {}
    for f in fingerprints:
        for number, s in enumerate(f.signals, start=1):
            if s.type in ("html", "script_src", "url"):
                table[signal_key(f.id, number)] = (f.id, number, s)
    if not table:
        return F.array().cast(f"array<{HIT}>")
    rules = literal_map({
        key: {"tech_id": tech_id, "signal_no": number, "type": s.type,
              "confidence": s.confidence, "weight": fixed.CONFIDENCE_WEIGHT[s.confidence]}
        for key, (tech_id, number, s) in table.items()},
        "struct<tech_id:string,signal_no:int,type:string,confidence:string,weight:double>")

    def rejoin(found: Column) -> Column:
        rule = F.element_at(rules, found["key"])
        return F.struct(
            rule["tech_id"].alias("tech_id"), rule["signal_no"].alias("signal_no"),
            rule["type"].alias("type"), rule["confidence"].alias("confidence"),
            rule["weight"].alias("weight"), found["text"].alias("text"),
            found["version"].alias("version")).cast(HIT)

    return F.transform(
        F.coalesce(F.col("signals"), F.array().cast(
            "array<struct<key:string,text:string,version:string>>")), rejoin)


def with_hits(frame: DataFrame, fingerprints=FINGERPRINTS) -> DataFrame:
    """Adds ``hits``: every fired signal, in rule order. Bounded by the pack."""
    if isinstance(fingerprints, RuleTable):
        raise TypeError("the hits of a rule table are rows: see hits_table and technology_table")
    if isinstance(fingerprints, RulePack):
        found = F.concat(rule_packs.site_hits(fingerprints, HIT),
                         rule_packs.page_hits(fingerprints, HIT))
    else:
        ordered = tuple(sorted(fingerprints))
        found = F.concat(_site_hits(ordered), _page_hits(ordered))
    hits = F.when(F.col("page_count") > 0, found).otherwise(F.array().cast(f"array<{HIT}>"))
    return frame.withColumn("hits", F.array_sort(hits))


def _technology(tech_id: Column, name, category, latest) -> Column:
    own = F.filter("hits", lambda h: h["tech_id"] == tech_id)
    versions = F.filter(own, lambda h: h["version"].isNotNull())
    version = F.get(F.transform(versions, lambda h: h["version"]), F.lit(0))
    best = F.array_max(F.transform(own, lambda h: F.struct(h["weight"], h["confidence"])))
    types = F.array_distinct(F.transform(own, lambda h: h["type"]))
    # the last signal of a type supplies its evidence
    proof = F.map_from_arrays(types, F.transform(types, lambda t: F.element_at(
        F.transform(F.filter(own, lambda h: h["type"] == t), lambda h: h["text"]), -1)))
    known = latest(tech_id)
    return F.struct(
        category(tech_id).alias("category"),
        tech_id.alias("tech_id"),
        name(tech_id).alias("name"),
        version.alias("version"),
        best["confidence"].alias("confidence"),
        proof.alias("evidence"),
        is_outdated(version, known).alias("is_outdated"),
        major_versions_behind(version, known).alias("versions_behind"),
        known.alias("latest"),
    )


def with_technologies(frame: DataFrame, fingerprints=FINGERPRINTS,
                      latest=LATEST_VERSIONS) -> DataFrame:
    """Adds ``technologies`` (sorted by category, id), ``cms`` and the flags.

    The flags are NULL where the site has no pages: nothing was looked at, so
    nothing is published.
    """
    if isinstance(fingerprints, RulePack):
        ids, listed = _pack_listing(fingerprints)
    else:
        ids, listed = _listing(tuple(fingerprints), tuple(latest.items()))
    techs = with_hits(frame, fingerprints).withColumn("tech_ids", ids).withColumn(
        "technologies", listed)
    primary, flags, cms = _summary()
    return techs.withColumns({"primary_cms": primary, **flags}).withColumn("cms", cms)


@built_once
def _listing(fingerprints: tuple, latest: tuple) -> tuple[Column, Column]:
    return _listed({f.id: f.name for f in fingerprints},
                   {f.id: f.category for f in fingerprints}, dict(latest))


@built_once
def _pack_listing(pack: RulePack) -> tuple[Column, Column]:
    return _listed(pack.names, pack.categories, pack.latest)


def _listed(names: dict, categories: dict, latest: dict) -> tuple[Column, Column]:
    name, category, current = lookup(names), lookup(categories), lookup(latest)
    ids = F.array_sort(F.transform(
        F.array_distinct(F.transform("hits", lambda h: h["tech_id"])),
        lambda t: F.struct(category(t).alias("category"), t.alias("tech_id"))))
    listed = F.transform("tech_ids", lambda t: _technology(t["tech_id"], name, category, current))
    return ids, listed


@built_once
def _summary() -> tuple[Column, dict[str, Column], Column]:
    seen = F.col("page_count") > 0
    flag = lambda category: F.when(seen, F.exists(
        "technologies", lambda t: t["category"] == category))
    rank = literal_map({c: n for n, c in enumerate(CONFIDENCE_ORDER)}, "int")
    suites = F.filter("technologies", lambda t: t["category"].isin("cms", "ecommerce"))
    first = F.array_min(F.transform(suites, lambda t: F.struct(
        F.element_at(rank, t["confidence"]).alias("rank"), t["tech_id"].alias("tech_id"))))
    flags = {f"has_{c}": flag(c) for c in ("analytics", "cdn", "waf")}
    cms = first_where(F.col("technologies"), lambda t: t["tech_id"] == F.col("primary_cms"))
    return first["tech_id"], flags, cms


def explode_technologies(frame: DataFrame) -> DataFrame:
    return frame.select("site", F.explode_outer("technologies").alias("t")).select(
        "site", "t.tech_id", "t.name", "t.category", "t.version", "t.confidence", "t.evidence",
        "t.is_outdated", "t.versions_behind", "t.latest").where("tech_id is not null")


def hits_table(sites: DataFrame, firsts: DataFrame, rules: RuleTable) -> DataFrame:
    """A row for every rule of a table that fired on a site: (site, hit, name, category, latest)."""
    core = with_hits(site_frame(sites, firsts=firsts.where(F.col("fact") != rule_table.FACT)), rules.core)
    hit = F.struct("tech_id", "signal_no", "type", "confidence", "weight", F.col("body.text").alias("text"),
                   F.col("body.extra").alias("version")).cast(HIT)
    found = firsts.where(F.col("fact") == rule_table.FACT).join(sites.select("site").distinct(), "site", "left_semi").join(
        rules.rules, "key").select("site", hit.alias("hit"))
    every = found.unionByName(core.select("site", F.explode("hits").alias("hit")))
    return every.withColumn("tech_id", F.col("hit.tech_id")).join(rules.about, "tech_id").drop("tech_id")


def technology_table(hits: DataFrame) -> DataFrame:
    """The rows of ``explode_technologies`` from those of ``hits_table``. A list holds the signals of one technology."""
    own = hits.groupBy("site", F.col("hit.tech_id").alias("tech_id")).agg(
        F.array_sort(F.collect_list("hit")).alias("hits"), *[F.first(c).alias(c) for c in ("name", "category", "latest")])
    of = lambda c: lambda _: F.col(c)
    return own.select("site", _technology(F.col("tech_id"), of("name"), of("category"), of("latest")).alias("t")).select(
        "site", "t.tech_id", "t.name", "t.category", "t.version", "t.confidence", "t.evidence", "t.is_outdated", "t.versions_behind", "t.latest")


def technologies_by_category(technologies: DataFrame) -> DataFrame:
    """Names per (site, category). At most one entry per fingerprint."""
    return technologies.groupBy("site", "category").agg(
        F.array_sort(F.collect_set(F.struct("tech_id", "name"))).alias("entries")
    ).select("site", "category", F.transform("entries", lambda e: e["name"]).alias("names"))


def rules_validate(signals: DataFrame, latest: DataFrame | None = None):
    """(accepted rules, rejected rules with a reason) for a signals table.

    A fingerprint with any bad signal is rejected as a whole; an empty second
    table is the condition for using the first.
    """
    # Regex validity is decided by the engine that runs it: an invalid pattern
    # fails the plan when the pack is compiled. Group numbers are checked here.
    groups = F.regexp_count(
        F.regexp_replace("pattern", r"\\\\.|\\.|\[[^\]]*\]|\(\?[:=!<]", ""), F.lit(r"\("))
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    reason = (
        F.when(blank("tech_id"), "missing id")
        .when(~F.coalesce(F.col("category").isin(*fixed.TECH_CATEGORIES), F.lit(False)),
              "unknown category")
        .when(~F.coalesce(F.col("type").isin(*fixed.SIGNAL_TYPES), F.lit(False)),
              "unknown signal type")
        .when(blank("pattern"), "missing pattern")
        .when(F.col("type").isin("header", "cookie") & blank("signal_name"),
              "signal requires a name")
        .when(~F.coalesce(F.col("confidence").isin(*fixed.CONFIDENCE_WEIGHT), F.lit(False)),
              "unknown confidence")
        .when(F.col("version_group") > groups, "no such group")
    )
    judged = signals.withColumn("reason", reason)
    doubled = signals.groupBy("tech_id", "signal_no").count().where("count > 1").select(
        "tech_id", "signal_no", F.lit("duplicate id").alias("reason"))
    errors = judged.where("reason is not null").select("tech_id", "signal_no", "reason")
    rejected = errors.unionByName(doubled)
    accepted = signals.join(rejected.select("tech_id").distinct(), "tech_id", "left_anti")
    if latest is not None:
        accepted = accepted.join(latest, "tech_id", "left")
    return accepted, rejected
