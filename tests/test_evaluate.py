import math
import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from sparkfeat.operators.evaluate import grouped_auc
from sparkfeat.operators.ranking import running_counts


def plain_auc(rows):
    yes = [s for s, y in rows if y == 1]
    no = [s for s, y in rows if y != 1]
    if not yes or not no:
        return None
    return sum((a > b) + 0.5 * (a == b) for a, b in product(yes, no)) / (len(yes) * len(no))


def collected(df, by=("g",)):
    return {tuple(r[c] for c in by): (r.positives, r.negatives, r.auc) for r in df.collect()}


def test_areas_of_many_groups_equal_all_pairs(spark):
    rng = random.Random(3)
    rows = [
        (g, None if rng.random() < 0.1 else round(rng.gauss(0, 1), rng.choice((0, 1, 9))),
         rng.choice((0, 1, 1, None)) if g else 1)
        for g in range(7) for _ in range(rng.choice((1, 40, 300)))
    ]
    df = spark.createDataFrame(rows, "g int, s double, y int").repartition(5)
    want = {}
    for g in range(7):
        mine = [(s, y) for h, s, y in rows if h == g and s is not None and y is not None]
        if mine:
            want[(g,)] = (
                sum(y for _, y in mine), sum(1 - y for _, y in mine),
                None if plain_auc(mine) is None else pytest.approx(plain_auc(mine)),
            )
    assert collected(grouped_auc(df, ["g"], "s", "y")) == want


def test_a_hot_group_spans_many_parts(spark):
    n = 30_000
    df = spark.range(n).select(
        F.lit("hot").alias("g"), (F.col("id") % 9973).cast("double").alias("s"), (F.col("id") % 2).alias("y")
    ).unionAll(spark.sql("SELECT 'cold', 1.0D, 1L UNION ALL SELECT 'cold', 2.0D, 0L"))
    counts = running_counts(df, ["g"], "s", {"n": F.lit(True), "yes": F.col("y") == 1})
    import pandas as pd

    frame = df.toPandas()
    hot = frame[frame.g == "hot"]
    want = hot.groupby("s").agg(n=("y", "size"), yes=("y", "sum")).sort_index()
    got = counts.where("g = 'hot'").toPandas().set_index("value").sort_index()
    pd.testing.assert_frame_equal(
        got[["n", "yes", "n_below", "yes_below"]].astype("int64"),
        want.assign(n_below=want.n.cumsum() - want.n, yes_below=want.yes.cumsum() - want.yes),
        check_names=False,
    )
    areas = collected(grouped_auc(df, ["g"], "s", "y"))
    ranks = hot.s.rank()
    p, q = (hot.y == 1).sum(), (hot.y == 0).sum()
    area = (ranks[hot.y == 1].sum() - p * (p + 1) / 2) / (p * q)
    assert areas[("hot",)] == (p, q, pytest.approx(area)) and areas[("cold",)] == (1, 1, 0.0)


def test_odd_scores_and_names(spark):
    rows = [(math.inf, 1), (-math.inf, 0), (0.0, 1), (-0.0, 0), (None, 1), (5.0, None)]
    df = spark.createDataFrame(rows, "value double, part int")
    found = grouped_auc(df, [], "value", "part").collect()
    assert [tuple(r) for r in found] == [(2, 2, pytest.approx(3.5 / 4))]
    named = df.select(F.lit(1).alias("weight"), F.lit(2).alias("__yes0"), "value", "part")
    assert collected(grouped_auc(named, ["weight", "__yes0"], "value", "part"), ("weight", "__yes0")) == {
        (1, 2): (2, 2, pytest.approx(3.5 / 4))
    }
    with pytest.raises(ValueError, match="auc"):
        grouped_auc(df.withColumn("auc", F.lit(1)), ["auc"], "value", "part")
    with pytest.raises(ValueError, match="value"):
        grouped_auc(df, ["value"], "value", "part")
    assert grouped_auc(named.limit(0), ["weight"], "value", "part").collect() == []
