"""CSV target lists: records are numbered alike however the files are split."""

import csv
import random

import pytest

from sitelens.sources import businesses


def write(path, rows, delimiter=";", end="\r\n"):
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f, delimiter=delimiter, lineterminator=end)
        out.writerow(["Company", "Website URL", "Town", "Country"])
        for n, row in enumerate(rows):
            out.writerow(row)
            if n % 7 == 0:
                f.write(end)  # blank lines do not count


def listed(n, seed=1):
    random.seed(seed)
    cell = lambda: random.choice(["plain", 'with "quotes"', "two\nlines", "semi;colon", "", "x\n\n\ny", "Ünï 漢", '"'])
    return [[f"{i} {cell()}", f"site{i}.com" if i % 5 else cell(), cell(), "Germany" if i % 2 else ""] for i in range(1, n + 1)]


def read(spark, path):
    return [tuple(v or "" for v in r[:4]) for r in businesses.read_csv(spark, str(path)).orderBy("row_no").collect()]


@pytest.fixture
def split_at(spark):
    def set_size(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield set_size
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("size", ["128m", "3000", "97"])
def test_records_are_the_same_in_any_number_of_splits(spark, tmp_path, split_at, size):
    rows = listed(150)
    write(tmp_path / "t.csv", rows)
    split_at(size)
    if size != "128m":
        assert spark.read.text(str(tmp_path / "t.csv")).rdd.getNumPartitions() > 3
    table = businesses.read_csv(spark, str(tmp_path / "t.csv"))
    got = {r.row_no: tuple(v or "" for v in r[:4]) for r in table.collect()}
    assert got == {n: tuple(r) for n, r in enumerate(rows, 1)}
    assert table.columns[:4] == ["Company", "Website URL", "Town", "Country"]


def test_several_files_are_one_list(spark, tmp_path):
    rows = listed(40)
    write(tmp_path / "a.csv", rows[:25], delimiter="\t", end="\n")
    write(tmp_path / "b.csv", rows[25:], delimiter="\t", end="\n")
    assert read(spark, tmp_path) == [tuple(r) for r in rows]
    (tmp_path / "c.csv").write_text("Other\theader\nx\ty\n")
    with pytest.raises(ValueError, match="different headers"):
        businesses.read_csv(spark, str(tmp_path))


def test_rejects_carry_their_number_and_a_lost_quote_is_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(businesses, "MOST_LINES", 3)
    (tmp_path / "t.csv").write_text('Name,Website\nA,a.com\nB,\nC,not a domain\nD,d.com\n"E,e.com\nF,f.com\nG,g.com\nH,h.com\n')
    found, errors = businesses.read_businesses(spark, str(tmp_path / "t.csv"), ("com",))
    assert {r.row_no: r.domain for r in found.collect()} == {1: "a.com", 4: "d.com"}
    assert {r.row_no: r.reason for r in errors.collect()} == {
        2: "empty domain", 3: "not a valid domain: 'not a domain'", 5: "a quote is not closed within 3 lines"}


def test_empty_and_header_only(spark, tmp_path):
    (tmp_path / "t.csv").write_text("")
    with pytest.raises(ValueError, match="no header"):
        businesses.read_csv(spark, str(tmp_path / "t.csv"))
    (tmp_path / "u.csv").write_text("Name,Website,Country\n\n\n")
    assert businesses.read_csv(spark, str(tmp_path / "u.csv")).count() == 0


def test_country_is_kept_whole(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Name,Website,Country\nA,a.com,Germany\n")
    row = businesses.read_businesses(spark, str(tmp_path / "t.csv"), ("com",))[0].first()
    assert (row.country, row.country_code) == ("Germany", "GE")
