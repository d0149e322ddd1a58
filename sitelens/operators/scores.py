"""Four independent 0-100 scores, each with its components and a confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens import fixed
from sitelens.functions.columns import built_once

SCORES = ("lead", "website", "security", "opportunity")


def clamp(value: Column) -> Column:
    """Round half to even, then into 0..100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(value, 0).cast("int")))


def _failed(check_id: str) -> Column:
    """True when the check failed or warned; an unevaluated check did not."""
    return F.coalesce(F.element_at("score_status", check_id).isin(*fixed.PROBLEM_STATUSES),
                      F.lit(False))


def _evaluated(check_id: str) -> Column:
    status = F.element_at("score_status", check_id)
    return F.coalesce(status != "not_applicable", F.lit(False))


def _count(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(t, 1).otherwise(0) for t in tests])


def score_confidence(checks) -> Column:
    return _count([_evaluated(c) for c in checks]) / F.lit(float(len(checks)))


def _breakdown(total: Column, parts: dict[str, Column], confidence: Column) -> Column:
    components = F.struct(*[F.bround(v.cast("double"), 1).alias(k) for k, v in parts.items()])
    return F.struct(clamp(total).alias("total"), components.alias("components"),
                    F.bround(confidence.cast("double"), 2).alias("confidence"))


@built_once
def score_security() -> Column:
    parts: dict[str, Column] = {}
    checks: list[str] = []
    for group, weight, members in fixed.SECURITY_GROUPS:
        checks += members
        known = _count([_evaluated(c) for c in members])
        bad = _count([_failed(c) for c in members])
        # nothing to judge: full weight, and the confidence shows it
        parts[group] = F.when(known == 0, F.lit(weight)).otherwise(
            F.lit(weight) * (F.lit(1.0) - bad / F.greatest(known, F.lit(1))))
    critical = F.size(F.filter("findings", lambda f: (
        (f["status"] == "fail") & (f["severity"] == "critical"))))
    penalty = -F.least(F.lit(40.0), critical * F.lit(20.0))
    total = reduce(lambda a, b: a + b, parts.values()) + penalty
    parts["critical_penalty"] = F.when(critical > 0, penalty)
    return _breakdown(total, parts, score_confidence(checks))


@built_once
def score_website() -> Column:
    outdated = F.col("cms.is_outdated")
    choose = lambda check, bad, fine: F.when(_failed(check), bad).otherwise(fine)
    parts = {
        "performance": choose("PERF-01", 8.0, 30.0),
        "mobile": choose("PERF-04", 0.0, 20.0),
        "delivery": choose("PERF-03", 6.0, 15.0),
        "secure_transport": choose("TLS-01", 0.0, 15.0),
        "modernity": F.when(outdated, 4.0).when(~outdated, 20.0).otherwise(14.0),
    }
    total = reduce(lambda a, b: a + b, parts.values())
    return _breakdown(total, parts, score_confidence(fixed.WEBSITE_CHECKS))


@built_once
def score_lead() -> Column:
    points = lambda test, n: F.when(test, float(n)).otherwise(0.0)
    reach = (
        points(F.col("primary_email").isNotNull(), 22) + points(F.col("primary_phone").isNotNull(), 10)
        + points(F.col("n_forms") > 0, 5) + points(F.col("n_addresses") > 0, 3)
    )
    parts = {
        "contactability": F.least(F.lit(40.0), reach),
        "business_signals":
            F.least(F.lit(12.0), F.col("n_socials") * 4.0)
            + F.least(F.lit(13.0), F.size("technologies") * 1.5),
        "site_reachable": F.when(_failed("TLS-01"), 15.0).otherwise(20.0),
        "engagement_surface": F.least(F.lit(15.0), F.size("opportunities") * 3.0),
    }
    total = reduce(lambda a, b: a + b, parts.values())
    return _breakdown(total, parts, F.when(F.col("n_contacts") > 0, 1.0).otherwise(0.7))


@built_once
def score_opportunity() -> Column:
    value = F.aggregate("opportunities", F.lit(0.0), lambda a, o: a + o["weight"])
    critical = F.size(F.filter("opportunities", lambda o: o["urgency"] == "critical"))
    reach = (
        F.when(F.col("primary_email").isNotNull(), 15.0)
        .when(F.col("primary_phone").isNotNull(), 9.0).otherwise(0.0)
    )
    parts = {
        "opportunity_value": F.least(F.lit(70.0), value),
        "urgency_bonus": F.least(F.lit(15.0), critical * 7.5),
        "reachable": reach,
    }
    total = reduce(lambda a, b: a + b, parts.values())
    return _breakdown(F.when(reach == 0.0, total * 0.5).otherwise(total), parts, F.lit(1.0))


BUILDERS = {
    "lead": score_lead,
    "website": score_website,
    "security": score_security,
    "opportunity": score_opportunity,
}


def with_scores(frame: DataFrame, which=SCORES) -> DataFrame:
    """Adds ``scores``: one struct per score, from the site row alone."""
    status = F.map_from_entries(
        F.transform("findings", lambda f: F.struct(f["check_id"], f["status"])))
    staged = frame.withColumn("score_status", status)
    return staged.withColumn(
        "scores", F.struct(*[BUILDERS[s]().alias(s) for s in which])).drop("score_status")


def score_table(frame: DataFrame) -> DataFrame:
    return frame.select("site", *[F.col(f"scores.{s}.total").alias(s) for s in SCORES])


def health_band(score: Column) -> Column:
    """Bands of a score where high is good."""
    return (
        F.when(score.isNull(), "none").when(score >= 75, "good").when(score >= 50, "medium")
        .when(score >= 25, "high").otherwise("critical")
    )


def opportunity_band(score: Column) -> Column:
    """Bands of the opportunity score, where high means worth a call."""
    return (
        F.when(score.isNull(), "none").when(score >= 70, "critical").when(score >= 45, "high")
        .when(score >= 20, "medium").otherwise("good")
    )
