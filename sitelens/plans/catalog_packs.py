"""Queries whose rules come from tables: long technology packs, opportunity rules of all kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens import rules
from sitelens.operators import facts, opportunities, technologies
from sitelens.operators.rule_packs import RulePack, load_opportunity_rules, load_pack
from sitelens.operators.rule_table import load_rule_table
from sitelens.plans.catalog import register
from sitelens.plans.catalog_analysis import _analysed
from sitelens.session import written
from sitelens.sources.captures import SUFFIXES, captured_pages, captured_sites


def long_rules(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The shipped rules and one for every part, which looks for the comment ``<!-- ad N -->``; current versions."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    key = F.col("p_partkey").cast("string")
    more = parts.select(
        F.concat(F.lit("part"), key).alias("tech_id"), F.col("p_name").alias("name"), F.lit("framework").alias("category"),
        F.lit(1).alias("signal_no"), F.lit("html").alias("type"), F.lit(None).cast("string").alias("signal_name"),
        F.concat(F.lit("<!--\\s*AD ("), key, F.lit(") -->")).alias("pattern"), F.lit(1).alias("version_group"),
        F.lit("possible").alias("confidence"))
    latest = spark.createDataFrame(sorted(rules.LATEST_VERSIONS.items()), "tech_id string, latest string")
    return rules.signals_table(spark).unionByName(more), latest


def long_pack(spark, sf_dir) -> RulePack:
    return load_pack(*long_rules(spark, sf_dir))


def pack_hits(spark, sf_dir) -> DataFrame:
    table = load_rule_table(*long_rules(spark, sf_dir))
    firsts = facts.first_facts(facts.page_facts(captured_pages(spark, sf_dir), table, ("page", "signals"), suffixes=SUFFIXES))
    return technologies.hits_table(captured_sites(spark, sf_dir), written(firsts, "facts"), table)


_ADS = "FROM pg_all JOIN part ON contains(html, '<!-- ad ' || p_partkey || ' -->')"


@register("tech_match_tables", f"""
SELECT site, tech_id, signal_no, type, text FROM hits_all
UNION ALL SELECT DISTINCT site, 'part' || p_partkey, 1, 'html', '<!-- ad ' || p_partkey || ' -->' {_ADS}""")
def tech_match_tables(spark, sf_dir):
    return pack_hits(spark, sf_dir).select("site", "hit.tech_id", "hit.signal_no", "hit.type", "hit.text")


@register("tech_list_tables", f"""
SELECT site, tech_id, name, category, version, confidence, latest, is_outdated FROM tech_all
UNION ALL SELECT DISTINCT site, 'part' || p_partkey, p_name, 'framework', p_partkey::VARCHAR, 'possible', NULL, NULL {_ADS}""")
def tech_list_tables(spark, sf_dir):
    return technologies.technology_table(pack_hits(spark, sf_dir)).select(
        "site", "tech_id", "name", "category", "version", "confidence", "latest", "is_outdated")


_CHECKS = ("HDR-01", "TLS-01", "DNS-01", "CMS-02", "PERF-01", "TLS-03", "DNS-06")
_KIND = "CASE n_nationkey % 3 WHEN 0 THEN 'finding_passed' WHEN 1 THEN 'finding_absent' ELSE 'finding_failed' END"
_CHECK = "CASE n_nationkey % 7 " + " ".join(f"WHEN {n} THEN '{c}'" for n, c in enumerate(_CHECKS)) + " END"
_ARTIFACT = "CASE n_nationkey % 4 WHEN 0 THEN 'artifact_truthy' WHEN 1 THEN 'artifact_falsy' ELSE 'artifact_equals' END"
_WANTED = "CASE WHEN n_nationkey % 4 > 1 THEN CASE WHEN n_nationkey % 2 = 0 THEN 'true' ELSE 'false' END END"


def nation_rules(spark, sf_dir):
    """An opportunity rule for every nation: two conditions, all six kinds among them."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").withColumn("rule_id", F.concat(
        F.lit("nation"), F.col("n_nationkey").cast("string")))
    head = nations.select("rule_id", F.col("n_name").alias("title"), F.lit("security").alias("category"), F.lit("low").alias("urgency"),
                          F.lit("On ${domain}").alias("template"), F.lit("pitch").alias("pitch"))
    none = F.lit(None).cast("string")
    checks = nations.select("rule_id", F.lit(1).alias("cond_no"), F.expr(_KIND).alias("kind"), F.expr(_CHECK).alias("check_id"),
                            none.alias("analyzer"), none.alias("key"), none.alias("value"))
    artifacts = nations.select("rule_id", F.lit(2).alias("cond_no"), F.expr(_ARTIFACT).alias("kind"), none.alias("check_id"),
                               F.lit("technologies").alias("analyzer"), F.lit("has_analytics").alias("key"), F.expr(_WANTED).alias("value"))
    return load_opportunity_rules(head, checks.unionByName(artifacts))


_HOLDS = f"""
SELECT site, 'nation' || n_nationkey AS rule_id, 1 AS cond_no, {_KIND} AS kind, {_CHECK} AS target,
  CASE n_nationkey % 3 WHEN 0 THEN coalesce(status = 'pass', false) WHEN 1 THEN coalesce(status, 'not_applicable') = 'not_applicable'
  ELSE coalesce(status IN ('fail', 'warn'), false) END AS holds
FROM st_all CROSS JOIN nation LEFT JOIN (SELECT site AS of, check_id, status FROM f_all) AS f ON of = site AND check_id = {_CHECK}
UNION ALL SELECT site, 'nation' || n_nationkey, 2, {_ARTIFACT}, 'technologies.has_analytics', coalesce(CASE n_nationkey % 4
  WHEN 0 THEN has_analytics WHEN 1 THEN NOT has_analytics ELSE has_analytics::VARCHAR = {_WANTED} END, false)
FROM st_all CROSS JOIN nation"""


@register("cond_kinds_tables", _HOLDS)
def cond_kinds_tables(spark, sf_dir):
    return opportunities.explode_conditions(_analysed(spark, sf_dir), nation_rules(spark, sf_dir))


@register("opp_match_tables", f"SELECT site, rule_id FROM ({_HOLDS}) GROUP BY ALL HAVING bool_and(holds)")
def opp_match_tables(spark, sf_dir):
    frame = opportunities.with_opportunities(_analysed(spark, sf_dir), nation_rules(spark, sf_dir))
    return opportunities.explode_opportunities(frame).select("site", "rule_id")
