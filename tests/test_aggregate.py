import pandas as pd
import pytest

from sparkfeat.operators import aggregate as A
from sparkfeat.operators.encode import levels, one_hot


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


@pytest.fixture(scope="module")
def orders(spark, small):
    from sparkfeat.registry.base import orders_with_gaps

    return orders_with_gaps(spark.read.parquet(f"{small}/orders.parquet")).cache()


def test_one_pass_subsets_equal_filtered_copies(orders):
    spec = {"price": "min max mean sum", "day": "mean size"}
    one = A.aggregate(
        orders, "client", spec, prefix="ALL", subsets=[A.Subset("F", "status = 'F'")]
    )
    part = A.aggregate(orders.where("status = 'F'"), "client", spec, prefix="F")
    two = A.aggregate(orders, "client", spec, prefix="ALL").join(part, "client", "left")
    assert rows(one) == rows(two)


def test_clients_without_subset_rows_have_no_sum(spark):
    df = spark.createDataFrame(
        [(1, "a", None), (2, "b", 5.0)], "k int, s string, x double"
    )
    out = A.aggregate(
        df, "k", {"x": "sum size nunique"}, subsets=[A.Subset("A", "s = 'a'")]
    )
    got = {r.k: (r.A_x_SUM, r.A_x_SIZE, r.A_x_NUNIQUE) for r in out.collect()}
    assert got == {1: (0.0, 1, 0), 2: (None, None, None)}


def test_rates_equal_the_mean_of_one_hot_columns(orders):
    found = levels(orders, ["status", "priority"])
    direct = A.aggregate(orders, "client", {}, rates=A.with_missing_level(found))
    dummies, names = one_hot(orders, found)
    averaged = A.aggregate(dummies, "client", {n: "mean" for n in names})
    assert rows(direct) == rows(averaged)


@pytest.mark.parametrize("kind", ["rates", "statistics"])
def test_long_form_equals_direct_counts(orders, monkeypatch, kind):
    found = A.with_missing_level(levels(orders, ["status", "priority"]))
    direct = rows(A.aggregate(orders, "client", {"price": "sum"}, **{kind: found}))
    monkeypatch.setattr(A, "LONG_FORM_LEVELS", 3)
    assert rows(A.aggregate(orders, "client", {"price": "sum"}, **{kind: found})) == direct
    monkeypatch.setattr(A, "LONG_FORM_LEVELS", 1)
    assert rows(A.aggregate(orders, "client", {"price": "sum"}, **{kind: found})) == direct


def test_level_statistics_equal_pandas(orders):
    found = A.with_missing_level(levels(orders, ["status"]))
    out = A.aggregate(orders, "client", {}, statistics=found).toPandas().set_index("client").sort_index()
    table = orders.select("client", "status").toPandas().dropna(subset=["client"])
    table["client"] = table["client"].astype("int64")
    table = pd.get_dummies(table, columns=["status"], dummy_na=True, dtype=int)
    want = table.groupby("client").agg(["min", "max", "mean", "sum", "var"])
    want.columns = [f"{a}_{b.upper()}" for a, b in want.columns]
    for c in want.columns:
        pd.testing.assert_series_equal(
            out[c].astype(float), want[c].astype(float), check_names=False, check_index_type=False
        )


def test_aggregate_all_takes_every_column(spark):
    df = spark.createDataFrame([(1, 7, 1.0, "a"), (1, 8, 3.0, None)], "k int, p int, x double, s string")
    out = A.aggregate_all(df, "k", prefix="CC", levels={"s": ["a", None]}, drop=["p"], count_as="CC_COUNT")
    row = out.first().asDict()
    assert len(row) == 1 + 5 + 10 + 1
    assert (row["CC_x_VAR"], row["CC_s_nan_SUM"], row["CC_s_a_VAR"], row["CC_COUNT"]) == (2.0, 1, 0.5, 2)


def test_parents_without_children_are_skipped_above(spark):
    parents = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "client int, p int")
    children = spark.createDataFrame([(10, 1), (10, 3)], "p int, m int")
    joined, added = A.two_level(children, parents, "p", {"m": "min max size"})
    assert added == ["m_MIN", "m_MAX", "m_SIZE"]
    out = A.aggregate(joined, "client", {"m_SIZE": "mean sum", "m_MAX": "max"}).collect()
    assert {r.client: (r.m_SIZE_MEAN, r.m_SIZE_SUM, r.m_MAX_MAX) for r in out} == {
        1: (2.0, 2, 3), 2: (None, 0, None),
    }


def test_awkward_level_names(spark):
    df = spark.createDataFrame([(1, "a.b (c)"), (1, "x/y'\\ z")], "k int, s string")
    out = A.aggregate(df, "k", {}, prefix="P", rates={"s": ["a.b (c)", "x/y'\\ z", None]})
    assert out.columns == ["k", "P_s_a.b (c)_MEAN", "P_s_x/y'\\ z_MEAN", "P_s_nan_MEAN"]
    assert tuple(out.first()) == (1, 0.5, 0.5, 0.0)


def test_colliding_names_raise(spark):
    df = spark.createDataFrame([(1, "a"), (1, "A")], "k int, s string")
    with pytest.raises(ValueError, match="collide"):
        A.aggregate(df, "k", {}, rates={"s": ["a", "A"]})


def test_unknown_aggregate_raises(spark):
    with pytest.raises(ValueError, match="unknown aggregate"):
        A.aggregate(spark.range(1), "id", {"id": "mode"})


def test_parents_without_a_key_stay(spark):
    from sparkfeat.operators.aggregate import two_level

    children = spark.createDataFrame([(1, 2.0), (1, 4.0), (None, 9.0)], "k int, v double")
    parents = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (None, "d")], "k int, name string")
    out, added = two_level(children, parents, "k", {"v": "mean size"})
    assert added == ["v_MEAN", "v_SIZE"]
    got = {r.name: (r.k, r.v_MEAN, r.v_SIZE) for r in out.collect()}
    assert got == {
        "a": (1, 3.0, 2), "b": (2, None, None), "c": (None, None, None), "d": (None, None, None),
    }


def test_rates_as_rows(spark):
    from sparkfeat.operators.aggregate import rates_long

    rows = [(1, "a"), (1, "a"), (1, None), (2, "b"), (None, "a")]
    got = rates_long(spark.createDataFrame(rows, "k int, c string"), "k", ["c"]).collect()
    assert {(r.k, r.level): r.rate for r in got} == {
        (1, "a"): 2 / 3, (1, None): 1 / 3, (2, "b"): 1.0,
    }
    empty = spark.createDataFrame([], "k int, c string")
    assert rates_long(empty, "k", ["c"]).collect() == []
