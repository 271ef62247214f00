import pytest

from sparkfeat.llm import bitmaps, jaccard_join


def possible(rows, values):
    got = bitmaps.with_possible(rows, values, "a", "b")
    assert got.columns == [*rows.columns, "possible"]
    return {(r.a, r.b): r.possible for r in got.collect()}


@pytest.mark.parametrize("bits", [bitmaps.BITS, 40_000, 64])
def test_no_row_with_a_partner_is_spared(spark, monkeypatch, bits):
    monkeypatch.setattr(bitmaps, "BITS", bits)
    rows = spark.range(20_000).selectExpr("id AS a", "CAST(id % 7 AS STRING) AS b")
    values = rows.where("a % 10 = 3").union(rows.where("a = 3").crossJoin(spark.range(500)).select("a", "b"))
    got = possible(rows, values)
    assert len(got) == 20_000 and all(v for (a, _), v in got.items() if a % 10 == 3)
    others = [v for (a, _), v in got.items() if a % 10 != 3]
    share = 1 - (1 - 1 / bits) ** 2000
    assert abs(sum(others) / len(others) - share) < 0.02


def test_missing_values_and_empty_tables(spark):
    schema = "a long, b string"
    rows = spark.createDataFrame([(None, None), (1, None), (1, "x")], schema)
    none = spark.createDataFrame([], schema)
    assert set(possible(rows, none).values()) == {False}
    assert possible(none, rows) == {}
    assert possible(rows, rows.where("a IS NULL"))[None, None] is True


def test_kept_rows_do_not_depend_on_the_bits(docs, monkeypatch):
    want = sorted(map(str, jaccard_join.keep_one(docs).collect()))
    monkeypatch.setattr(bitmaps, "BITS", 8)
    assert sorted(map(str, jaccard_join.keep_one(docs).collect())) == want
    links = sorted(map(str, jaccard_join.near_duplicates(docs).collect()))
    monkeypatch.undo()
    assert sorted(map(str, jaccard_join.near_duplicates(docs).collect())) == links
