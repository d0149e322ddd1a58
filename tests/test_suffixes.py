"""Public suffix rules: the longest one counts, wildcards and exceptions, no rule means no domain."""

import pytest
from pyspark.sql import functions as F

from sitelens.functions.urls import canonical_domain, same_site
from sitelens.sources.suffixes import read_suffix_list, suffixes_from_table

LIST = "// remark\n\ncom\nru\nuk\nco.uk\n*.ck\n!www.ck\n*.compute.example.com\n公司.cn\ncn  ignored words\n"
HOSTS = {
    "example.ru": "example.ru", "https://a.b.example.co.uk/x": "example.co.uk", "co.uk": None, "com": None,
    "shop.foo.ck": "shop.foo.ck", "foo.ck": None, "www.ck": "www.ck", "a.www.ck": "www.ck", "ck": None,
    "x.y.compute.example.com": "x.y.compute.example.com", "y.compute.example.com": None, "example.com.": "example.com",
    "shop.公司.cn": "shop.公司.cn", "shop.xn--55qx5d.cn": "shop.xn--55qx5d.cn", "a.unknown": None, "localhost": None, "": None,
    "..com": None, "10.0.0.1": None,
}


@pytest.fixture(scope="module")
def suffixes(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("list") / "suffixes.dat"
    path.write_text(LIST, encoding="utf-8")
    return read_suffix_list(spark, str(path))


def domains(spark, suffixes):
    frame = spark.createDataFrame([(h,) for h in [*HOSTS, None]], "h string")
    return {r.h: r.d for r in frame.select("h", canonical_domain(F.col("h"), suffixes).alias("d")).collect()}


def test_rules(spark, suffixes):
    assert domains(spark, suffixes) == {**HOSTS, None: None}


def test_a_long_list_gives_the_same(spark, suffixes):
    assert domains(spark, (*suffixes, *(f"region{i}.example" for i in range(9000)))) == {**HOSTS, None: None}


def test_same_site(spark, suffixes):
    frame = spark.createDataFrame([("a.foo.ck", "b.foo.ck"), ("x.a.ru", "a.ru"), ("a.unknown", "a.unknown")], "a string, b string")
    assert [r[0] for r in frame.select(same_site(F.col("a"), F.col("b"), suffixes)).collect()] == [False, True, False]


def test_a_list_is_required_and_checked(spark):
    with pytest.raises(ValueError, match="public suffix list"):
        canonical_domain(F.col("h"), None)
    for bad in ("a b.c/d/", "a..b", "a.*.b", "!*.x"):
        with pytest.raises(ValueError, match="suffix rule"):
            suffixes_from_table(spark.createDataFrame([("com",), (bad.replace(" ", ""),)], "suffix string"))
    with pytest.raises(ValueError, match="empty"):
        suffixes_from_table(spark.createDataFrame([("// no rule",), (None,)], "suffix string"))
