"""The composite plans on small CSV files with the real table layouts, against pandas."""

import dataclasses

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkfeat.plans import history, scoring
from sparkfeat.sources.tables import load_loan_table

CLIENTS, TESTED = 160, 40


def pick(rng, values, n, missing=0.0):
    out = rng.choice(np.array(values, dtype=object), n)
    out[rng.random(n) < missing] = None
    return out


def numbers(rng, low, high, n, missing=0.0):
    out = rng.integers(low, high, n).astype(float)
    out[rng.random(n) < missing] = np.nan
    return out


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    rng = np.random.default_rng(7)
    folder = tmp_path_factory.mktemp("loans")
    n = CLIENTS + TESTED
    app = pd.DataFrame(
        {
            "SK_ID_CURR": np.arange(100, 100 + n),
            "TARGET": rng.integers(0, 2, n),
            "AMT_INCOME_TOTAL": numbers(rng, 20_000, 200_000, n),
            "AMT_CREDIT": numbers(rng, 50_000, 900_000, n),
            "AMT_ANNUITY": numbers(rng, 1_000, 50_000, n, 0.1),
            "AMT_GOODS_PRICE": numbers(rng, 50_000, 900_000, n, 0.1),
            "AMT_REQ_CREDIT_BUREAU_QRT": pick(rng, [0.0, 1.0, 261.0], n, 0.2),
            "OBS_30_CNT_SOCIAL_CIRCLE": numbers(rng, 0, 4, n, 0.05),
            "DAYS_EMPLOYED": pick(rng, [-100, -2000, 365243], n),
            "DAYS_BIRTH": -rng.integers(7_500, 25_000, n),
            "DAYS_LAST_PHONE_CHANGE": -numbers(rng, 0, 2_000, n),
            "OWN_CAR_AGE": numbers(rng, 0, 30, n, 0.5),
            "CNT_FAM_MEMBERS": numbers(rng, 1, 5, n),
            "CNT_CHILDREN": rng.integers(0, 4, n),
            "EXT_SOURCE_1": np.where(rng.random(n) < 0.4, np.nan, rng.random(n)),
            "EXT_SOURCE_2": rng.random(n),
            "EXT_SOURCE_3": np.where(rng.random(n) < 0.2, np.nan, rng.random(n)),
            **{f"FLAG_DOCUMENT_{i}": rng.integers(0, 2, n) for i in (2, 4, 5, 6, 7)},
            "FLAG_MOBIL": 1,
            "FLAG_OWN_CAR": pick(rng, ["Y", "N"], n),
            "CODE_GENDER": pick(rng, ["F", "M", "XNA"], n),
            "ORGANIZATION_TYPE": pick(rng, ["School", "Trade: type 1", "Bank"], n),
        }
    )
    owner = lambda k: rng.integers(100, 100 + n - 5, k)  # noqa: E731  (five clients have no history)
    bureau = pd.DataFrame(
        {
            "SK_ID_CURR": owner(600),
            "SK_ID_BUREAU": np.arange(5_000, 5_600),
            "CREDIT_ACTIVE": pick(rng, ["Active", "Closed", "Bad debt"], 600),
            "CREDIT_TYPE": pick(rng, ["Car loan", "Mortgage"], 600, 0.1),
            "DAYS_CREDIT": -rng.integers(1, 3_000, 600),
            "DAYS_CREDIT_ENDDATE": numbers(rng, -500, 500, 600, 0.1),
            "DAYS_CREDIT_UPDATE": -rng.integers(1, 300, 600),
            "CREDIT_DAY_OVERDUE": rng.integers(0, 3, 600),
            "AMT_CREDIT_MAX_OVERDUE": numbers(rng, 0, 500, 600, 0.3),
            "AMT_CREDIT_SUM": np.append(numbers(rng, 0, 60_000, 598), [9e7, 8e7]),
            "AMT_CREDIT_SUM_DEBT": numbers(rng, 0, 50_000, 600, 0.2),
            "AMT_CREDIT_SUM_OVERDUE": numbers(rng, 0, 3, 600),
            "AMT_CREDIT_SUM_LIMIT": numbers(rng, 0, 3, 600, 0.5),
            "AMT_ANNUITY": numbers(rng, 0, 9_000, 600, 0.6),
            "CNT_CREDIT_PROLONG": rng.integers(0, 3, 600),
        }
    )
    months = pd.DataFrame(
        {
            "SK_ID_BUREAU": rng.integers(5_000, 5_400, 3_000),
            "MONTHS_BALANCE": -rng.integers(0, 60, 3_000),
            "STATUS": pick(rng, ["C", "X", "0", "1"], 3_000),
        }
    )
    previous = pd.DataFrame(
        {
            "SK_ID_PREV": np.arange(500),
            "SK_ID_CURR": owner(500),
            "NAME_CONTRACT_STATUS": pick(rng, ["Approved", "Refused", "Unused offer"], 500),
            "NAME_CLIENT_TYPE": pick(rng, ["New", "Repeater", "XNA"], 500),
            "AMT_ANNUITY": numbers(rng, 0, 9_000, 500, 0.2),
            "AMT_APPLICATION": numbers(rng, 0, 3, 500) * 10_000,
            "AMT_CREDIT": numbers(rng, 0, 3, 500) * 12_000,
            "AMT_DOWN_PAYMENT": numbers(rng, 0, 9_000, 500, 0.5),
            "AMT_GOODS_PRICE": numbers(rng, 0, 9_000, 500, 0.2),
            "HOUR_APPR_PROCESS_START": rng.integers(0, 24, 500),
            "RATE_DOWN_PAYMENT": np.where(rng.random(500) < 0.5, np.nan, rng.random(500)),
            "DAYS_DECISION": -rng.integers(1, 3_000, 500),
            "CNT_PAYMENT": numbers(rng, 6, 60, 500, 0.2),
            **{c: pick(rng, [-500.0, 365243.0, None], 500) for c in history.PREVIOUS_SENTINEL_DAYS},
        }
    )
    pos = pd.DataFrame(
        {
            "SK_ID_PREV": rng.integers(0, 500, 900),
            "SK_ID_CURR": owner(900),
            "MONTHS_BALANCE": -rng.integers(1, 90, 900),
            "SK_DPD": rng.integers(0, 5, 900),
            "SK_DPD_DEF": rng.integers(0, 2, 900),
            "NAME_CONTRACT_STATUS": pick(rng, ["Active", "Completed"], 900),
        }
    )
    payments = pd.DataFrame(
        {
            "SK_ID_PREV": rng.integers(0, 500, 1_500),
            "SK_ID_CURR": owner(1_500),
            "NUM_INSTALMENT_VERSION": numbers(rng, 0, 4, 1_500),
            "DAYS_INSTALMENT": -numbers(rng, 1, 3_000, 1_500),
            "DAYS_ENTRY_PAYMENT": -numbers(rng, 1, 3_000, 1_500, 0.05),
            "AMT_INSTALMENT": numbers(rng, 1, 9_000, 1_500),
            "AMT_PAYMENT": numbers(rng, 0, 9_000, 1_500, 0.05),
        }
    )
    cards = pd.DataFrame(
        {
            "SK_ID_PREV": rng.integers(0, 500, 700),
            "SK_ID_CURR": owner(700),
            "MONTHS_BALANCE": -rng.integers(1, 90, 700),
            "AMT_BALANCE": numbers(rng, 0, 90_000, 700, 0.1),
            "NAME_CONTRACT_STATUS": pick(rng, ["Active", "Signed"], 700),
        }
    )
    tables = {
        "application_train": app.iloc[:CLIENTS],
        "application_test": app.iloc[CLIENTS:].drop(columns="TARGET"),
        "bureau": bureau,
        "bureau_balance": months,
        "previous_application": previous,
        "pos_cash_balance": pos,
        "installments_payments": payments,
        "credit_card_balance": cards,
    }
    from sparkfeat.sources.schemas import TABLE_FILES

    for name, frame in tables.items():
        frame.to_csv(folder / TABLE_FILES[name], index=False)
    return str(folder), tables


def same(got, want, columns):
    got = got.toPandas().set_index("SK_ID_CURR").sort_index()
    want = want.sort_index()
    assert list(got.index) == list(want.index)
    for c in columns:
        np.testing.assert_allclose(
            got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-9, err_msg=c
        )


def flat(grouped, spec, prefix):
    out = grouped.agg({c: f.split() for c, f in spec.items()})
    out.columns = [f"{prefix}_{c}_{f.upper()}" for c, f in out.columns]
    return out


def test_instalments_equal_pandas(spark, data):
    folder, tables = data
    p = tables["installments_payments"].copy()
    p["PAYMENT_PERC"] = p.AMT_PAYMENT / p.AMT_INSTALMENT
    p["PAYMENT_DIFF"] = p.AMT_INSTALMENT - p.AMT_PAYMENT
    late = p.DAYS_ENTRY_PAYMENT - p.DAYS_INSTALMENT
    p["DPD"], p["DBD"] = late.clip(lower=0).fillna(0), (-late).clip(lower=0).fillna(0)
    want = flat(p.groupby("SK_ID_CURR"), history.INSTALMENT_SPEC, "INSTAL")
    got = history.instalment_features(load_loan_table(spark, folder, "installments_payments"))
    same(got, want, want.columns)


def test_bureau_equals_pandas(spark, data):
    folder, tables = data
    b = tables["bureau"].copy()
    x = b.AMT_CREDIT_SUM
    b["AMT_CREDIT_SUM"] = x.clip(x.mean() - 3 * x.std(), x.mean() + 3 * x.std())
    assert (b.AMT_CREDIT_SUM != x).sum() > 0
    months = pd.get_dummies(tables["bureau_balance"], columns=["STATUS"], dummy_na=True, dtype=int)
    rolled = months.groupby("SK_ID_BUREAU").agg(
        {"MONTHS_BALANCE": ["min", "max", "size"],
         **{c: ["mean"] for c in months.columns if c.startswith("STATUS_")}}
    )
    rolled.columns = [f"{c}_{f.upper()}" for c, f in rolled.columns]
    b = pd.get_dummies(b, columns=["CREDIT_ACTIVE", "CREDIT_TYPE"], dummy_na=True, dtype=int)
    b = b.join(rolled, on="SK_ID_BUREAU")
    shares = {c: "mean" for c in b.columns if c.startswith(("CREDIT_ACTIVE_", "CREDIT_TYPE_", "STATUS_"))}
    want = flat(b.groupby("SK_ID_CURR"), {**history.BUREAU_SPEC, **shares}, "BURO")
    for prefix, level in history.BUREAU_SUBSETS.items():
        part = b[b[f"CREDIT_ACTIVE_{level}"] == 1]
        want = want.join(flat(part.groupby("SK_ID_CURR"), history.BUREAU_SPEC, prefix))
    got = history.bureau_features(
        load_loan_table(spark, folder, "bureau"), load_loan_table(spark, folder, "bureau_balance")
    )
    assert sorted(got.columns) == sorted(["SK_ID_CURR", *want.columns])
    same(got, want, want.columns)


def test_previous_equals_pandas(spark, data):
    folder, tables = data
    p = tables["previous_application"].copy()
    p["APP_CREDIT_PERC"] = p.AMT_APPLICATION / p.AMT_CREDIT
    p = pd.get_dummies(
        p, columns=["NAME_CONTRACT_STATUS", "NAME_CLIENT_TYPE"], dummy_na=True, dtype=int
    )
    shares = {c: "mean" for c in p.columns if c.startswith("NAME_")}
    with np.errstate(all="ignore"):
        want = flat(p.groupby("SK_ID_CURR"), {**history.PREVIOUS_SPEC, **shares}, "PREV")
        for prefix, level in history.PREVIOUS_SUBSETS.items():
            part = p[p[f"NAME_CONTRACT_STATUS_{level}"] == 1]
            want = want.join(flat(part.groupby("SK_ID_CURR"), history.PREVIOUS_SPEC, prefix))
    table = load_loan_table(spark, folder, "previous_application")
    got = history.previous_features(table)
    assert sorted(got.columns) == sorted(["SK_ID_CURR", *want.columns])
    same(got, want, want.columns)
    counted = history.previous_features(table, approval_rate=True, clip_first=True).toPandas()
    sizes = p.groupby("SK_ID_CURR").size()
    approved = p.groupby("SK_ID_CURR")["NAME_CONTRACT_STATUS_Approved"].sum()
    counted = counted.set_index("SK_ID_CURR").sort_index()
    assert (counted.TOTAL_PREV_COUNT == sizes).all()
    np.testing.assert_allclose(
        counted.APPROVAL_PERCENT.astype(float), (approved / sizes).where(approved > 0).astype(float)
    )


def test_cards_and_pos_equal_pandas(spark, data):
    folder, tables = data
    c = pd.get_dummies(
        tables["credit_card_balance"].drop(columns="SK_ID_PREV"), dummy_na=True, dtype=int,
        columns=["NAME_CONTRACT_STATUS"],
    )
    grouped = c.groupby("SK_ID_CURR")
    spec = {n: "min max mean sum var" for n in c.columns if n != "SK_ID_CURR"}
    want = flat(grouped, spec, "CC")
    want["CC_COUNT"] = grouped.size()
    got = history.card_features(load_loan_table(spark, folder, "credit_card_balance"))
    assert sorted(got.columns) == sorted(["SK_ID_CURR", *want.columns])
    same(got, want, want.columns)
    p = tables["pos_cash_balance"]
    got = history.pos_features(load_loan_table(spark, folder, "pos_cash_balance"))
    want = flat(p.groupby("SK_ID_CURR"), history.POS_SPEC, "POS")
    same(got, want, want.columns)


SMALL_TREES = {"maxDepth": 2, "minInstancesPerNode": 2}


@pytest.fixture(scope="module")
def matrices(spark, data):
    folder, _ = data
    options = scoring.Options(
        clip_trigger=3.5, age_polynomials=True, approval_rate=True, narrow_integers=True,
        unwanted=["FLAG_MOBIL", "POS_COUNT", "never_created"], trees=3, search_trees=3, parameters=SMALL_TREES,
    )
    return scoring.build_matrices(spark, folder, options), options


def test_matrices_have_the_same_columns_and_no_gaps(data, matrices):
    (train, test), _ = matrices
    _, tables = data
    assert [c for c in train.columns if c != "TARGET"] == test.columns
    assert "FLAG_MOBIL" not in train.columns and "POS_COUNT" not in train.columns
    known = tables["application_test"]
    assert test.count() == (known.CODE_GENDER != "XNA").sum()
    app = tables["application_train"]
    kept = app[
        (app.AMT_REQ_CREDIT_BUREAU_QRT != 261)
        & (app.OBS_30_CNT_SOCIAL_CIRCLE < 300)
        & (app.CODE_GENDER != "XNA")
    ]
    frame = train.toPandas()
    assert sorted(frame.SK_ID_CURR) == sorted(kept.SK_ID_CURR)
    assert not frame.isna().any().any() and np.isfinite(frame.to_numpy(dtype=float)).all()
    assert len([c for c in train.columns if c.startswith("BIRTH_YEARS_BINNED_")]) == 10


def test_reports(matrices):
    (train, _), options = matrices
    report = scoring.tune_class_weight(train, options, weights=(1.0, 12.0)).collect()
    assert len(report) == 2 and report[0].mean_test <= report[1].mean_test
    assert all(0 <= r.mean_train <= 1 for r in report)
    assert {r.parameters for r in report} == {"classWeight=1.0", "classWeight=12.0"}


def test_report_of_points_drawn_at_random(matrices):
    (train, _), options = matrices
    report = scoring.tune_at_random(train, options).collect()
    assert {r.parameters for r in report} == {"subsamplingRate=0.8", "subsamplingRate=0.85"}
    assert all(0 <= r.mean_test <= 1 for r in report)


def test_reported_auc_is_that_of_ranks(matrices):
    from sparkfeat.operators import model as trees

    (train, _), options = matrices
    folds = scoring._search_folds(train, options)
    names = [c for c in train.columns if c not in ("SK_ID_CURR", "TARGET")]
    pipeline = trees.boosted_trees(names, "TARGET", trees=3, validation="is_validation", **SMALL_TREES)
    points = [{}, {"classWeight": 12.0, "maxDepth": 1}]
    scores = trees.cross_scores(folds, pipeline, points, key="SK_ID_CURR", label="TARGET")
    rows = scores.toPandas()
    assert len(rows) == 2 * 3 * folds.count() and rows.held_out.mean() == pytest.approx(1 / 3)
    held = rows[rows.held_out].merge(folds.select("SK_ID_CURR", "fold").toPandas(), left_on="key", right_on="SK_ID_CURR")
    assert (held.fold_x == held.fold_y).all() and held.groupby("point").SK_ID_CURR.nunique().eq(folds.count()).all()
    model = trees.train(folds.where("fold <> 1"), pipeline)
    again = trees.score(model, folds, "SK_ID_CURR", "s").toPandas().set_index("SK_ID_CURR").s
    mine = rows[(rows.point == 0) & (rows.fold == 1)].set_index("key").score
    assert again.sort_index().to_list() == pytest.approx(mine.sort_index().to_list())

    def area(part):
        ranks, yes = part.score.rank(), part.label == 1
        p, q = yes.sum(), (~yes).sum()
        return (ranks[yes].sum() - p * (p + 1) / 2) / (p * q)

    areas = rows.groupby(["point", "held_out", "fold"]).apply(area, include_groups=False)
    for r in trees.search_report(scores, points).collect():
        assert r.mean_test == pytest.approx(areas[r.point, True].mean())
        assert r.mean_train == pytest.approx(areas[r.point, False].mean())
        assert r.std_test == pytest.approx(areas[r.point, True].std(ddof=0))
    assert r.parameters == "classWeight=12.0, maxDepth=1"


def test_report_equals_sql_over_the_stored_scores(spark, matrices):
    import duckdb

    from sparkfeat.operators import model as trees

    (train, _), options = matrices
    points = [{"subsamplingRate": 0.8}, {"subsamplingRate": 1.0}]
    scores = scoring.search_scores(train, options, points)
    stored = scores.toPandas()  # noqa: F841  (read by the SQL below)
    want = duckdb.sql(
        """WITH ranked AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY point, fold, held_out, score) - 1) / 2.0 AS r
                           FROM stored WINDOW w AS (PARTITION BY point, fold, held_out ORDER BY score)),
                areas AS (SELECT point, fold, held_out,
                                 (sum(r) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2)
                                 / (sum(label) * (count(*) - sum(label))) AS auc FROM ranked GROUP BY ALL)
           SELECT point, avg(auc) FILTER (WHERE held_out), avg(auc) FILTER (WHERE NOT held_out),
                  stddev_pop(auc) FILTER (WHERE held_out) FROM areas GROUP BY point ORDER BY point"""
    ).fetchall()
    got = trees.search_report(scores, points).orderBy("point").collect()
    for row, (point, *figures) in zip(got, want, strict=True):
        assert (row.point, row.mean_test, row.mean_train, row.std_test) == (
            point, *(pytest.approx(f) for f in figures)
        )
    pipeline = trees.boosted_trees(
        [c for c in train.columns if c not in ("SK_ID_CURR", "TARGET")], "TARGET", trees=2, **SMALL_TREES
    )
    best, model = trees.refit_best(train, pipeline, points, trees.search_report(scores, points), "TARGET")
    top = max(got, key=lambda r: (r.mean_test, -r.point))
    assert best == points[top.point]
    assert model.stages[-1].getOrDefault("subsamplingRate") == best["subsamplingRate"]


def test_training_reads_vectors_that_were_assembled_once(matrices, monkeypatch):
    """What the trainer reads several times is one scan, without the marks' joins and the assembler."""
    from pyspark.ml.classification import GBTClassifier

    (train, _), options = matrices
    read, fit = [], GBTClassifier.fit
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, df, params=None: read.append(df) or fit(self, df, params))
    fitted = scoring.train_model(train, options)
    (rows,) = read
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "UDF" not in plan and "Join" not in plan
    assert set(rows.columns) == {"TARGET", "SK_ID_CURR", "is_validation", "features"}
    names = fitted.stages[0].getInputCols()
    assert names == [c for c in train.columns if c not in ("TARGET", "SK_ID_CURR")]
    want = {r.SK_ID_CURR: [float(r[c]) for c in names] for r in train.collect()}
    assert {r.SK_ID_CURR: r.features.toArray().tolist() for r in rows.collect()} == want


def test_wide_tables_are_stored_without_dictionaries(matrices, monkeypatch):
    """No number of a matrix, of its folds or of its vectors is looked up while they are written."""
    from urllib.parse import urlparse

    import pyarrow.parquet as pq
    from pyspark.ml.classification import GBTClassifier

    (train, test), options = matrices
    read, fit = [], GBTClassifier.fit
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, df, params=None: read.append(df) or fit(self, df, params))
    scoring.train_model(train, options)
    for table in [train, test, *read, scoring._search_folds(train, options)]:
        files = [pq.ParquetFile(urlparse(f).path).metadata for f in table.inputFiles()]
        groups = [m.row_group(g) for m in files for g in range(m.num_row_groups)]
        used = {e for g in groups for c in range(g.num_columns) for e in g.column(c).encodings}
        assert used and not {e for e in used if "DICTIONARY" in e}


def test_nodes_are_those_of_the_trees(spark, matrices):
    """The stored nodes against the text that MLlib prints of the same trees."""
    import re

    from sparkfeat.operators import model as trees

    (train, _), options = matrices
    fitted = scoring.train_model(train, options)
    nodes = trees.tree_nodes(spark, fitted)
    printed = re.findall(r"If \(feature (\d+) <=", fitted.stages[-1].toDebugString)
    names = fitted.stages[0].getInputCols()
    counts = {}
    for number in printed:
        counts[names[int(number)]] = counts.get(names[int(number)], 0) + 1
    found = {r.feature: r for r in trees.split_importances(spark, fitted, nodes).collect()}
    assert set(found) == set(names)
    assert {n: r.splits for n, r in found.items() if r.splits} == counts and counts
    assert all((r.gain > 0) == (r.splits > 0) == (r.rows > 0) for r in found.values())
    pairs = nodes.alias("a").join(nodes.alias("b"), "tree").where("a.left_child = b.node OR a.right_child = b.node")
    sums = pairs.groupBy("tree", "a.node", "a.rows").agg(F.sum("b.rows").alias("below")).collect()
    assert sums and all(r["rows"] == r["below"] for r in sums)
    leaves = nodes.where("feature IS NULL")
    assert leaves.where("gain IS NOT NULL OR threshold IS NOT NULL").count() == 0


def test_scores_are_written_for_every_client(spark, data, matrices, tmp_path):
    folder, tables = data
    (train, _), _ = matrices
    out = str(tmp_path / "run")
    run = scoring.score_clients(
        spark, folder, out, scoring.Options(trees=3, search_trees=3, parameters=SMALL_TREES)
    )
    rows = run.scores.collect()
    tested = tables["application_test"]
    assert sorted(r.SK_ID_CURR for r in rows) == sorted(tested[tested.CODE_GENDER != "XNA"].SK_ID_CURR)
    assert all(0 <= r.TARGET <= 1 for r in rows) and run.report is None
    assert spark.read.parquet(f"{out}/train_features").count() == train.count()
    shares = spark.read.parquet(f"{out}/importances").toPandas().importance
    assert shares.sum() == pytest.approx(1.0)


def test_a_stopped_run_goes_on_from_its_matrices(spark, data, tmp_path, monkeypatch):
    folder, _ = data
    options = scoring.Options(trees=2, parameters={**SMALL_TREES, "maxDepth": 1})
    whole = scoring.score_clients(spark, folder, str(tmp_path / "whole"), options)
    want = {r.SK_ID_CURR: r.TARGET for r in whole.scores.collect()}

    def lost(*args):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as patch:
        patch.setattr(scoring, "train_model", lost)
        with pytest.raises(RuntimeError, match="driver lost"):
            scoring.score_clients(spark, folder, str(tmp_path / "first"), options)
    with monkeypatch.context() as patch:
        patch.setattr(scoring, "build_matrix", lost)
        patch.setattr(scoring, "write_scores", lost)
        with pytest.raises(RuntimeError, match="driver lost"):
            scoring.score_clients(spark, folder, str(tmp_path / "second"), options)
    with monkeypatch.context() as patch:
        patch.setattr(scoring, "build_matrix", lost)
        patch.setattr(scoring, "train_model", lost)
        run = scoring.score_clients(spark, folder, str(tmp_path / "third"), options)
        assert {r.SK_ID_CURR: r.TARGET for r in run.scores.collect()} == want
        with pytest.raises(RuntimeError, match="driver lost"):  # a finished run leaves nothing
            scoring.score_clients(spark, folder, str(tmp_path / "fourth"), options)


def test_five_thousand_levels_train_as_sparse_vectors(spark, data, tmp_path):
    """A category too wide for columns is an error, or becomes part of a vector that trees split by."""
    import shutil

    from sparkfeat.operators import model as trees
    from sparkfeat.operators.sparse import entries
    from sparkfeat.sources.schemas import TABLE_FILES

    folder, tables = data
    wide = str(tmp_path / "wide")
    shutil.copytree(folder, wide)
    train = tables["application_train"]
    label = train.set_index("SK_ID_CURR").TARGET
    clients = pd.Index(train.SK_ID_CURR).append(pd.Index(tables["application_test"].SK_ID_CURR))
    more = pd.DataFrame({"SK_ID_CURR": clients.repeat(26)})
    more["SK_ID_PREV"] = range(len(more))
    more["NAME_GOODS_CATEGORY"] = [f"level {i}" for i in range(len(more))]
    tells = more.groupby("SK_ID_CURR").cumcount() == 0
    answer = more.SK_ID_CURR.map(label).fillna(0).astype(int)
    more.loc[tells, "NAME_GOODS_CATEGORY"] = ["tells " + "ny"[a] for a in answer[tells]]
    first = tables["previous_application"]
    whole = {c: "Int64" for c in first.columns if first[c].dtype.kind == "i"}
    previous = pd.concat([first, more]).astype(whole)
    previous.to_csv(f"{wide}/{TABLE_FILES['previous_application']}", index=False)
    assert previous.NAME_GOODS_CATEGORY.nunique() >= 5000
    options = scoring.Options(trees=1, parameters={"maxDepth": 1, "minInstancesPerNode": 2, "featureSubsetStrategy": "all"})
    with pytest.raises(ValueError, match="more than 1000 levels"):
        scoring.build_matrices(spark, wide, options)
    matrix, _ = scoring.build_matrices(spark, wide, dataclasses.replace(options, sparse_levels=True))
    shares = entries(matrix, "SK_ID_CURR", scoring.LEVELS).toPandas()
    kept = previous[previous.SK_ID_CURR.isin(set(shares.SK_ID_CURR))]
    want = kept.fillna({"NAME_GOODS_CATEGORY": "missing"}).groupby("SK_ID_CURR").NAME_GOODS_CATEGORY.value_counts(normalize=True)
    got = shares.sort_values(["SK_ID_CURR", "value"])
    assert len(got) == len(want) and got.groupby("SK_ID_CURR").value.sum().to_list() == pytest.approx([1.0] * shares.SK_ID_CURR.nunique())
    assert sorted(got.value) == pytest.approx(sorted(want))
    fitted = scoring.train_model(matrix, options)
    used = trees.split_importances(spark, fitted).where("splits > 0").collect()
    assert used and all(r.feature.startswith("LEVELS[") for r in used)


def test_clients_in_buckets_give_the_same_matrix(spark, data):
    folder, _ = data
    plain, _ = scoring.build_matrices(spark, folder, scoring.Options())
    dealt, _ = scoring.build_matrices(spark, folder, scoring.Options(client_buckets=4))
    same(dealt, plain.toPandas().set_index("SK_ID_CURR"), [c for c in plain.columns if c != "SK_ID_CURR"])


def test_command_line():
    from sparkfeat.__main__ import arguments

    args = arguments(["in", "out", "--variant", "polynomial", "--trees", "9", "--tune"])
    assert (args.input, args.variant, args.trees, args.tune) == ("in", "polynomial", 9, "weights")
    assert scoring.VARIANTS["polynomial"].clip_trigger == 3.5
    assert scoring.VARIANTS["polynomial"].trees == 750


def test_planted_answer_is_not_narrowed(spark, small, monkeypatch):
    from sparkfeat.operators import model
    from sparkfeat.registry import QUERIES, models

    every = {*models._planted_table(spark, small).columns} - {"doc_id", "answer"}
    monkeypatch.setattr(model, "unimportant", lambda tables, times: sorted(every))
    assert {r.feature for r in QUERIES["unimportant_planted"](spark, small).collect()} == every
