"""From the eight input tables to one score per client."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfeat.operators import model as trees
from sparkfeat.operators.columns import drop_lenient, fill_final, plain_names, split_label
from sparkfeat.operators.encode import MAX_LEVELS
from sparkfeat.operators.joins import assemble
from sparkfeat.operators.observed import Statistics, load_loan_observed
from sparkfeat.operators.profile import narrow
from sparkfeat.operators.sparse import level_index, or_empty, sparse_vectors, wide_columns, wide_rates
from sparkfeat.operators.split import SEED, k_fold, stratified_split
from sparkfeat.plans import application, history
from sparkfeat.sources.schemas import TABLE_FILES
from sparkfeat.sources.store import Stages, intermediate_tables, materialize, store_bucketed
from sparkfeat.sources.tables import load_loan_table, read_csv, write_features, write_scores

LABEL = "TARGET"
HISTORY_TABLES = [
    "bureau", "bureau_balance", "previous_application", "pos_cash_balance",
    "installments_payments", "credit_card_balance",
]
IN_TRAIN = "in_train"
LEVELS = "LEVELS"
# Categories that the plans select, filter or look up by.
NAMED = {"CREDIT_ACTIVE", "NAME_CONTRACT_STATUS", "CODE_GENDER", "ORGANIZATION_TYPE"}


@dataclass(frozen=True)
class Options:
    """What differs between runs; the defaults are the plain variant."""

    clip_trigger: float = 3.0
    age_polynomials: bool = False
    approval_rate: bool = False
    narrow_integers: bool = False
    unwanted: Sequence[str] = ()
    max_levels: int = MAX_LEVELS
    # Columns with more levels become part of one sparse vector per client instead of an error.
    sparse_levels: bool = False
    # With a number, histories are stored in as many buckets of clients, and assembly moves none.
    client_buckets: int | None = None
    search_trees: int = trees.SEARCH_TREES
    trees: int = trees.FINAL_TREES
    test_share: float = 0.2
    parameters: dict = field(default_factory=dict)


# The three variants: plain; with polynomials and age bins, a wider clip trigger and more trees;
# with approval rates. A list of unwanted columns is a parameter of the last two.
VARIANTS = {
    "plain": Options(),
    "polynomial": Options(clip_trigger=3.5, age_polynomials=True, trees=750),
    "approval": Options(approval_rate=True),
}


def history_tables(
    spark: SparkSession, directory: str
) -> tuple[dict[str, DataFrame], dict[str, Statistics]]:
    """The history tables of a folder, and the statistics of those that are clipped, which come
    from the pass that converts them."""
    cleaned = {"bureau": {}, "previous_application": history.known_days()}
    tables, statistics = {}, {}
    for name in HISTORY_TABLES:
        if name in cleaned:
            tables[name], statistics[name] = load_loan_observed(spark, directory, name, cleaned[name])
        else:
            tables[name] = load_loan_table(spark, directory, name)
    return tables, statistics


def history_features(spark: SparkSession, directory: str, options: Options) -> list[DataFrame]:
    """The five feature tables of the history tables, one row per client each."""
    tables, statistics = history_tables(spark, directory)
    return client_features(tables, options, statistics)


def client_features(
    tables: Mapping[str, DataFrame],
    options: Options,
    statistics: Mapping[str, Statistics] | None = None,
) -> list[DataFrame]:
    """The same from tables that are loaded already, and what is known of them."""
    if options.client_buckets:
        tables = bucketed_by_client(tables, options.client_buckets)
    trigger, most = options.clip_trigger, options.max_levels
    known = statistics or {}
    return [
        history.bureau_features(
            tables["bureau"],
            tables["bureau_balance"],
            trigger=trigger,
            max_levels=most,
            statistics=known.get("bureau"),
        ),
        history.previous_features(
            tables["previous_application"],
            trigger=trigger,
            approval_rate=options.approval_rate,
            max_levels=most,
            statistics=known.get("previous_application"),
        ),
        history.pos_features(tables["pos_cash_balance"], max_levels=most),
        history.instalment_features(tables["installments_payments"], max_levels=most),
        history.card_features(tables["credit_card_balance"], max_levels=most),
    ]


def bucketed_by_client(tables: Mapping[str, DataFrame], buckets: int) -> dict[str, DataFrame]:
    """The tables that have clients, stored in buckets of them."""
    return {
        name: store_bucketed(t, history.CLIENT, buckets, name) if history.CLIENT in t.columns else t
        for name, t in tables.items()
    }


def wide_levels(tables: Mapping[str, DataFrame], most: int) -> dict[str, list[str]]:
    """Category columns with more than ``most`` levels, of the tables that have clients, but for
    those whose levels the plans name."""
    return {
        name: [c for c in wide_columns(t, most) if c not in NAMED]
        for name, t in tables.items()
        if history.CLIENT in t.columns
    }


def application_matrices(
    train: DataFrame, test: DataFrame, options: Options
) -> tuple[DataFrame, DataFrame]:
    """Cleaned and encoded application tables with the same columns; train keeps the label."""
    if options.age_polynomials:
        train, test = application.age_polynomials(train, test)
    train_levels = application.application_levels(train, options.max_levels)
    test_levels = application.application_levels(test, options.max_levels)
    train = application.clean_applications(train)
    stats = application.fit_application(train)
    return application.encode_applications(
        application.application_features(train, stats),
        application.application_features(test, stats),
        train_levels,
        test_levels,
    )


def model_matrices(
    train: DataFrame,
    test: DataFrame,
    features: Sequence[DataFrame],
    options: Options,
    levels: tuple[DataFrame, int] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The training and the scoring part of :func:`store_matrix`."""
    return split_matrix(store_matrix(train, test, features, options, levels))


def split_matrix(stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to train on and rows to score, without the columns that only the others have."""
    return (
        stored.where(F.col(IN_TRAIN) == 1).drop(IN_TRAIN),
        stored.where(F.col(IN_TRAIN) == 0).drop(IN_TRAIN, LABEL),
    )


def store_matrix(
    train: DataFrame,
    test: DataFrame,
    features: Sequence[DataFrame],
    options: Options,
    levels: tuple[DataFrame, int] | None = None,
    path: str | None = None,
) -> DataFrame:
    """Wide tables of one row per client, filled and with trainer-safe names.

    Both tables are assembled in one join chain, which aggregates every history table once and
    moves it once, and are stored together, split by folder: training reads its part many times.
    ``levels`` are sparse vectors per client and their length; they become the last column.
    """
    both = train.withColumn(IN_TRAIN, F.lit(1)).unionByName(
        test.withColumn(IN_TRAIN, F.lit(0)), allowMissingColumns=True
    )
    wide = assemble(both, history.CLIENT, features)
    if options.unwanted:
        wide = drop_lenient(wide, options.unwanted)
    filled, vectors = plain_names(fill_final(wide)), []
    if levels:
        table, size = levels
        filled = filled.join(table, history.CLIENT, "left").withColumn(LEVELS, or_empty(F.col(LEVELS), size))
        vectors = [LEVELS]
    if not options.narrow_integers:
        return _stored_wide(filled, "matrix", vectors=vectors, path=path)
    stored = _stored_wide(filled, "matrix", vectors=vectors)
    return _stored_wide(narrow(stored), "narrow-matrix", path=path)


def _stored_wide(wide: DataFrame, label: str, **settings) -> DataFrame:
    return materialize(wide, label, partition_by=IN_TRAIN, dictionaries=False, **settings)


def build_matrices(
    spark: SparkSession, directory: str, options: Options = Options()
) -> tuple[DataFrame, DataFrame]:
    """Stored training and scoring matrices from the eight tables of a folder."""
    return split_matrix(build_matrix(spark, directory, options))


def build_matrix(
    spark: SparkSession, directory: str, options: Options = Options(), path: str | None = None
) -> DataFrame:
    """Both matrices as one stored table, at a path if one is given."""
    train = load_loan_table(spark, directory, "application_train")
    test = load_loan_table(spark, directory, "application_test")
    tables, statistics = history_tables(spark, directory)
    levels = None
    if options.sparse_levels:
        train, test, tables, levels = without_wide_levels(train, test, tables, options)
    train, test = application_matrices(train, test, options)
    features = client_features(tables, options, statistics)
    return store_matrix(train, test, features, options, levels, path)


def without_wide_levels(
    train: DataFrame, test: DataFrame, tables: Mapping[str, DataFrame], options: Options
) -> tuple[DataFrame, DataFrame, dict[str, DataFrame], tuple[DataFrame, int] | None]:
    """The tables without their wide category columns, and these as a sparse vector per client.

    Levels are those of the histories and of both application tables; a client's value in its
    application is one entry of 1.
    """
    shared = [c for c in train.columns if c in test.columns]
    both = train.select(*shared).unionByName(test.select(*shared))
    sources = {"application": both, **tables}
    wide = wide_levels(sources, options.max_levels)
    if not any(wide.values()):
        return train, test, dict(tables), None
    rates, found = wide_rates(sources, wide, history.CLIENT)
    index = level_index(found)
    vectors = sparse_vectors(rates, history.CLIENT, index, LEVELS)
    dense = {name: t.drop(*wide.get(name, [])) for name, t in tables.items()}
    dropped = wide["application"]
    return train.drop(*dropped), test.drop(*dropped), dense, (vectors, index.size)


def train_model(matrix: DataFrame, options: Options = Options()):
    """Final model on a stored matrix: a stratified 20 % of the rows decides when to stop."""
    names, label = split_label(matrix, LABEL, history.CLIENT)
    marked = stratified_split(
        matrix, history.CLIENT, label, options.test_share, into="is_validation"
    )
    pipeline = trees.boosted_trees(
        names, label, trees=options.trees, validation="is_validation", **options.parameters
    )
    return trees.train_wide(marked, pipeline)


def _search_folds(matrix: DataFrame, options: Options) -> DataFrame:
    """Stored rows with their fold; in every fold the marked share decides when to stop.

    Folds come from another seed than the marks, so that every fold holds marked rows.
    """
    names, label = split_label(matrix, LABEL, history.CLIENT)
    marked = stratified_split(
        matrix, history.CLIENT, label, options.test_share, into="is_validation"
    )
    folds = k_fold(marked, history.CLIENT, label, seed=SEED + 1)
    return materialize(folds, "folds", dictionaries=False)


def tune_class_weight(
    matrix: DataFrame, options: Options = Options(), weights: Sequence[float] = (trees.CLASS_WEIGHT,)
) -> DataFrame:
    """Cross-validated AUC of class weights on a stored matrix, one row a weight.

    A stratified share of the rows decides in each training when to stop, as in the final one.
    """
    points = [{trees.WEIGHT: w} for w in weights]
    return _searched(matrix, options, points)


def tune_at_random(
    matrix: DataFrame,
    options: Options = Options(),
    space: Mapping[str, object] = trees.SEARCH_SPACE,
    points: int = trees.SEARCH_POINTS,
) -> DataFrame:
    """Cross-validated AUC of parameter points drawn from a space, one row a point."""
    return _searched(matrix, options, trees.random_points(space, points))


def search_scores(matrix: DataFrame, options: Options, points: Sequence[Mapping]) -> DataFrame:
    """Scores of all rows of a stored matrix by every point and fold, see ``model.cross_scores``."""
    names, label = split_label(matrix, LABEL, history.CLIENT)
    pipeline = trees.boosted_trees(
        names, label, trees=options.search_trees, validation="is_validation", **options.parameters
    )
    folds = _search_folds(matrix, options)
    return trees.cross_scores(folds, pipeline, points, key=history.CLIENT, label=label)


def _searched(matrix: DataFrame, options: Options, points: Sequence[Mapping]) -> DataFrame:
    report = trees.search_report(search_scores(matrix, options, points), points)
    return trees.last_k(report, "mean_test", "parameters")


@dataclass(frozen=True)
class ScoringRun:
    """What a run leaves behind besides its files."""

    model: PipelineModel
    scores: DataFrame
    report: DataFrame | None


def score_clients(
    spark: SparkSession,
    directory: str,
    output: str,
    options: Options = Options(),
    *,
    tune: str | None = None,
) -> ScoringRun:
    """Read the eight tables, train, and write one score per client of the test table.

    ``tune`` adds a report on class weights (``weights``) or on points drawn at random
    (``random``). Intermediate tables of the run are removed at its end. The matrices and the
    model of a run that stopped are kept: the same call, on unchanged files, goes on from there.
    """
    inputs = [f"{directory}/{file}" for file in TABLE_FILES.values()]
    stages = Stages(spark, inputs, repr(options))
    with intermediate_tables(spark):
        matrix = stages.table("matrix", lambda path: build_matrix(spark, directory, options, path))
        train, test = split_matrix(matrix)
        searches = {"weights": tune_class_weight, "random": tune_at_random}
        report = searches[tune](train, options) if tune else None
        if report is not None:
            report = spark.createDataFrame(report.collect(), report.schema)
        fitted = stages.model("model", lambda: train_model(train, options))
        write_features(train, f"{output}/train_features")
        write_scores(trees.score(fitted, test, history.CLIENT, LABEL), f"{output}/scores")
        shares = trees.importances(spark, fitted)
        shares.join(trees.split_importances(spark, fitted), "feature").write.parquet(
            f"{output}/importances"
        )
    stages.remove()
    stored = read_csv(spark, f"{output}/scores", {history.CLIENT: "bigint", LABEL: "double"})
    return ScoringRun(fitted, stored, report)
