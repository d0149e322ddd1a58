"""Results of one scan, analysed once and stored; read-side queries use these."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitelens.plans.analyze import analyze_once
from sitelens.sources.captures import SUFFIXES, captured_pages, captured_sites

_SCANS: dict[tuple, dict[str, DataFrame]] = {}


def stored(spark: SparkSession, sf_dir: str, scan: str = "all") -> dict[str, DataFrame]:
    """The result tables of a scan, written to the shared folder on first use.

    The listing, export, report and comparison queries all read the stored
    tables, as they do in production: pages are read once per scan.
    """
    key = (spark.sparkContext.applicationId, sf_dir, scan)
    if key not in _SCANS:
        _SCANS[key] = analyze_once(
            captured_sites(spark, sf_dir, scan), captured_pages(spark, sf_dir, scan),
            suffixes=SUFFIXES)
    return _SCANS[key]


def stored_sites(spark: SparkSession, sf_dir: str, scan: str = "all") -> DataFrame:
    return stored(spark, sf_dir, scan)["sites"]


def stored_contacts(spark: SparkSession, sf_dir: str, scan: str = "all") -> DataFrame:
    return stored(spark, sf_dir, scan)["contacts"]
