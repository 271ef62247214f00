"""Training, search, reports and scores on labelled documents."""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfeat.operators import model as M
from sparkfeat.operators.columns import fill_final, plain_names, split_label
from sparkfeat.operators.encode import levels, one_hot
from sparkfeat.operators.evaluate import grouped_auc
from sparkfeat.operators.split import SEED, k_fold, stratified_split
from sparkfeat.registry.base import kept, register
from sparkfeat.sources.store import materialize
from sparkfeat.sources.tables import load_table

# Small trees: the labelled documents are few. Their number is bounded by validation alone.
SMALL = {"maxDepth": 3, "minInstancesPerNode": 5}
# Trees that are fitted to a planted rule end at an improvement below a tenth.
PLANTED = {"maxDepth": 3, "minInstancesPerNode": 1, "stepSize": 0.5, "validationTol": 0.1,
           "subsamplingRate": 1.0, "featureSubsetStrategy": "all"}


def document_features(
    spark: SparkSession, sf: str, wanted: DataFrame | None = None
) -> DataFrame:
    """One numeric row per document, or per document that ``wanted`` holds.

    The category levels are those of all documents.
    """
    table = load_table(spark, sf, "documents")
    found = levels(table, ["lang", "source"])
    if wanted is not None:
        table = table.join(wanted.select("doc_id"), "doc_id", "left_semi")
    documents = table.select(
        "doc_id",
        "n_chars",
        (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).alias("n_blanks"),
        (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).alias("n_lines"),
        "lang",
        "source",
    )
    encoded, _ = one_hot(documents, found, null_level=False)
    return encoded


def labelled_documents(spark: SparkSession, sf: str) -> DataFrame:
    """One numeric row per labelled document, without missing values."""
    labels = load_table(spark, sf, "labels")
    joined = labels.join(document_features(spark, sf, labels), "doc_id", "left")
    return plain_names(fill_final(joined))


def every_document(spark: SparkSession, sf: str) -> DataFrame:
    """The same columns but the label for every document, labelled or not."""
    labels = load_table(spark, sf, "labels").drop("quality")
    joined = document_features(spark, sf).join(labels, "doc_id", "left")
    return plain_names(fill_final(joined))


def _training_table(spark, sf) -> DataFrame:
    return materialize(labelled_documents(spark, sf), "documents")


def _trained_with(table: DataFrame, seeds: Sequence[int], label_name: str = "quality", **options):
    """A model for every seed, trained at the same time on the same split of the rows."""
    names, label = split_label(table, label_name, "doc_id")
    marked = stratified_split(table, "doc_id", label, 0.2, into="is_validation")

    def run(seed: int):
        settings = {**SMALL, **options, "seed": seed}
        return M.train(marked, M.boosted_trees(names, label, validation="is_validation", **settings))

    with ThreadPool(len(seeds)) as pool:
        return pool.map(inheritable_thread_target(table.sparkSession)(run), seeds, chunksize=1)


def _trained(table: DataFrame, label_name: str = "quality", seed: int = SEED, **options):
    return _trained_with(table, [seed], label_name, **options)[0]


@register(
    "auc",
    """WITH scored AS (SELECT quality, n_chars FROM labels JOIN documents USING (doc_id)),
            ranked AS (SELECT quality, rank() OVER (ORDER BY n_chars)
                              + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS r FROM scored)
       SELECT round((sum(r) FILTER (WHERE quality = 1) - p * (p + 1) / 2.0) / (p * (n - p)), 9) AS auc
       FROM ranked, (SELECT sum(quality) AS p, count(*) AS n FROM scored) GROUP BY p, n""",
)
def _(spark, sf):
    scored = load_table(spark, sf, "labels").join(
        load_table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id"
    )
    return spark.createDataFrame([(round(M.auc(scored, "n_chars", "quality"), 9),), ], "auc double")


def _model(spark, sf, again: bool):
    return kept(spark, sf, ("documents", "labels"), "model", lambda: _trained(_training_table(spark, sf)), again)


def _scores(spark, sf, again: bool) -> DataFrame:
    return M.score(_model(spark, sf, again), every_document(spark, sf), "doc_id", "score")


@register("gbt_scores")
def _(spark, sf):
    """Scores of all documents, learned from the labelled ones."""
    return _scores(spark, sf, again=True)


@register("gbt_score_facts", "SELECT doc_id, true AS is_probability FROM documents")
def _(spark, sf):
    """What SQL can say about the scores: every document has one, and it is a probability."""
    return _scores(spark, sf, again=False).select(
        "doc_id", F.col("score").between(0, 1).alias("is_probability")
    )


@register("importances")
def _(spark, sf):
    return M.top_k(M.importances(spark, _model(spark, sf, again=True)), "importance", "feature", 20)


@register("split_importances")
def _(spark, sf):
    """How often the trees split by every feature, and what that gained."""
    found = M.split_importances(spark, _model(spark, sf, again=True))
    return M.top_k(found, "splits", "feature", 20)


@register(
    "importance_facts",
    """SELECT CAST(3 + 1 + count(DISTINCT lang) + count(DISTINCT source) AS BIGINT) AS features,
              true AS are_shares, 1.0::DOUBLE AS total FROM documents""",
)
def _(spark, sf):
    """Every feature has an importance, and all of them add up to 1."""
    return M.importances(spark, _model(spark, sf, again=False)).agg(
        F.count(F.lit(1)).alias("features"),
        F.bool_and(F.col("importance").between(0, 1)).alias("are_shares"),
        F.round(F.sum("importance"), 9).alias("total"),
    )


@register("unimportant_features")
def _(spark, sf):
    """Features that get no importance in either of two trainings."""
    table = _training_table(spark, sf)
    tables = [M.importances(spark, m) for m in _trained_with(table, (314, 315))]
    names = M.unimportant(tables, times=2)
    return tables[0].where(F.col("feature").isin(names)).select("feature")


# --- a planted rule that trees must find ----------------------------------------------------

_PLANTED_RULE = "coalesce(lang = 'en' OR (lang = 'de' AND source >= 'src2'), false)"


def _planted_table(spark, sf) -> DataFrame:
    """Every document with the answer of a rule, what it looks at and a constant."""
    rows = load_table(spark, sf, "documents").selectExpr(
        "doc_id",
        f"CAST({_PLANTED_RULE} AS INT) AS answer",
        "CAST(coalesce(lang = 'en', false) AS INT) AS is_en",
        "CAST(coalesce(lang = 'de', false) AS INT) AS is_de",
        "CAST(coalesce(source >= 'src2', false) AS INT) AS is_late",
        "5 AS five",
    )
    return materialize(rows, "planted")


@register(
    "gbt_planted",
    f"SELECT doc_id, {_PLANTED_RULE} AS says_yes FROM documents",
)
def _(spark, sf):
    """Boosted trees reproduce a rule over three features on every document."""
    table = _planted_table(spark, sf)
    scores = M.score(_trained(table, "answer", **PLANTED), table, "doc_id", "score")
    return scores.select("doc_id", (F.col("score") > 0.5).alias("says_yes"))


@register(
    "unimportant_planted",
    "SELECT 'five' AS feature",
)
def _(spark, sf):
    """A constant column is what two trainings on a planted rule agree to drop."""
    table = _planted_table(spark, sf)
    tables = [
        M.importances(spark, m) for m in _trained_with(table, (314, 315), "answer", **PLANTED)
    ]
    names = M.unimportant(tables, times=2)
    return tables[0].where(F.col("feature").isin(names)).select("feature")


def _one_tree(spark, sf) -> DataFrame:
    """The nodes of one tree grown on every document of the planted table."""
    table = _planted_table(spark, sf)
    names, label = split_label(table, "answer", "doc_id")
    model = M.train(table, M.boosted_trees(names, label, trees=1, **PLANTED))
    return M.tree_nodes(spark, model)


# A class is +1 or -1, and a split's gain is the variance it takes from them.
_SPREAD = "avg(y * y) - avg(y) * avg(y)"


@register(
    "tree_root",
    f"""WITH rows AS (SELECT CASE WHEN {_PLANTED_RULE} THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y,
                             coalesce(lang = 'en', false) AS is_en, coalesce(lang = 'de', false) AS is_de,
                             coalesce(source >= 'src2', false) AS is_late FROM documents),
             sides AS (SELECT feature, side, count(*) AS n, {_SPREAD} AS spread FROM
                       (SELECT y, unnest([{{'feature': 'is_en', 'side': is_en}}, {{'feature': 'is_de', 'side': is_de}},
                                          {{'feature': 'is_late', 'side': is_late}}], recursive := true) FROM rows)
                       GROUP BY feature, side),
             gains AS (SELECT feature, (SELECT {_SPREAD} FROM rows) - sum(n * spread) / sum(n) AS gain,
                              CAST(sum(n) AS BIGINT) AS "rows" FROM sides GROUP BY feature)
        SELECT feature, round(gain, 9) AS gain, "rows" FROM gains ORDER BY gains.gain DESC LIMIT 1""",
)
def _(spark, sf):
    """The first split of a tree: the feature that takes most variance, and how much."""
    root = _one_tree(spark, sf).where("node = 0")
    return root.select("feature", F.round("gain", 9).alias("gain"), "rows")


@register(
    "tree_node_facts",
    f"""WITH cells AS (SELECT DISTINCT coalesce(lang = 'en', false) AS is_en, coalesce(lang = 'de', false) AS is_de,
                              coalesce(source >= 'src2', false) AS is_late, {_PLANTED_RULE} AS answer FROM documents),
             used AS (SELECT feature, bool_or(a.answer <> b.answer) AS used FROM cells a JOIN cells b ON true,
                      (VALUES ('is_en'), ('is_de'), ('is_late')) AS f(feature)
                      WHERE (a.is_en = b.is_en) = (feature <> 'is_en') AND (a.is_de = b.is_de) = (feature <> 'is_de')
                        AND (a.is_late = b.is_late) = (feature <> 'is_late') GROUP BY feature)
        SELECT f.feature, coalesce(used, false) AS is_used, coalesce(used, false) AS has_gain,
               (SELECT count(*) FROM documents) AS root_rows
        FROM (VALUES ('is_en'), ('is_de'), ('is_late'), ('five')) AS f(feature) LEFT JOIN used USING (feature)""",
)
def _(spark, sf):
    """A tree on the planted rule splits by the features that the answer depends on, by no other."""
    table = _planted_table(spark, sf)
    names, label = split_label(table, "answer", "doc_id")
    model = M.train(table, M.boosted_trees(names, label, trees=1, **PLANTED))
    nodes = M.tree_nodes(spark, model)
    root = nodes.where("node = 0").select(F.col("rows").alias("root_rows"))
    found = M.split_importances(spark, model, nodes).crossJoin(F.broadcast(root))
    return found.select(
        "feature", (F.col("splits") > 0).alias("is_used"), (F.col("gain") > 0).alias("has_gain"), "root_rows"
    )


# --- search ---------------------------------------------------------------------------------


def _folds(spark, sf):
    """Stored labelled rows with folds; a fifth of the rows decides when a training stops.

    Folds come from another seed than that fifth, so that every fold holds some of it.
    """
    table = labelled_documents(spark, sf)
    names, label = split_label(table, "quality", "doc_id")
    marked = stratified_split(table, "doc_id", label, 0.2, into="is_validation")
    return materialize(k_fold(marked, "doc_id", label, 3, seed=SEED + 1), "folds"), names, label


def _search_trees(names, label, **options):
    return M.boosted_trees(
        names, label, trees=M.SEARCH_TREES, validation="is_validation", **SMALL, **options
    )


_WEIGHTS = [{M.WEIGHT: 1.0}, {M.WEIGHT: M.CLASS_WEIGHT}]


def _search_scores(spark, sf, points) -> DataFrame:
    table, names, label = _folds(spark, sf)
    return M.cross_scores(table, _search_trees(names, label), points, key="doc_id", label=label)


def _report(spark, sf, name: str, points, again: bool) -> DataFrame:
    scores = kept(spark, sf, ("documents", "labels"), name, lambda: _search_scores(spark, sf, points), again)
    return M.last_k(M.search_report(scores, points), "mean_test", "point")


def _weight_report(spark, sf, again: bool) -> DataFrame:
    return _report(spark, sf, "weights", _WEIGHTS, again)


def _random_report(spark, sf, again: bool) -> DataFrame:
    return _report(spark, sf, "random", M.random_points(M.SEARCH_SPACE), again)


def _report_facts(report: DataFrame) -> DataFrame:
    """The points of a report, and whether what was measured can be an AUC and a deviation."""
    sound = (
        F.col("mean_test").between(0, 1)
        & F.col("mean_train").between(0, 1)
        & F.col("std_test").between(0, 1)
    )
    return report.select("parameters", sound.alias("is_sound"))


@register("cv_report")
def _(spark, sf):
    """Class weights by search: one row a weight, three folds."""
    return _weight_report(spark, sf, again=True)


@register(
    "cv_report_facts",
    """SELECT 'classWeight=' || w AS parameters, count(*) > 0 AS is_sound
       FROM labels, (VALUES ('1.0'), ('12.0')) AS t(w) GROUP BY w""",
)
def _(spark, sf):
    """One row a weight, with figures that can be an AUC."""
    return _report_facts(_weight_report(spark, sf, again=False))


@register("random_search")
def _(spark, sf):
    return _random_report(spark, sf, again=True)


@register(
    "random_search_facts",
    """SELECT 'subsamplingRate=' || r AS parameters, count(*) > 0 AS is_sound
       FROM labels, (VALUES ('0.8'), ('0.85')) AS t(r) GROUP BY r""",
)
def _(spark, sf):
    """Two points of two possible ones: each is drawn once."""
    return _report_facts(_random_report(spark, sf, again=False))


# A rule with every tenth answer turned over, and folds by number: what trees can learn is the rule,
# so a decision by score is the rule, and its area in a fold follows from the turned answers.
_NOISY = f"({_PLANTED_RULE}) <> (doc_id % 10 = 3)"


@register(
    "out_of_fold_planted",
    f"""WITH rows AS (SELECT doc_id % 3 AS fold, {_PLANTED_RULE} AS says, {_NOISY} AS answer FROM documents),
             parts AS (SELECT f.fold, rows.fold = f.fold AS held_out, says, answer
                       FROM rows, (VALUES (0), (1), (2)) AS f(fold)),
             rates AS (SELECT fold, held_out, count(*) FILTER (WHERE answer) AS positives,
                              count(*) FILTER (WHERE NOT answer) AS negatives,
                              count(*) FILTER (WHERE answer AND says) AS hits,
                              count(*) FILTER (WHERE NOT answer AND says) AS alarms FROM parts GROUP BY ALL)
        SELECT CAST(fold AS INTEGER) AS fold, held_out, positives, negatives,
               round((hits * (negatives - alarms) + 0.5 * hits * alarms
                      + 0.5 * (positives - hits) * (negatives - alarms)) / (positives * negatives), 9) AS auc
        FROM rates""",
)
def _(spark, sf):
    """Areas of decisions by cross-validated trees, of held-out and of training rows of every fold."""
    rows = load_table(spark, sf, "documents").selectExpr(
        "doc_id",
        f"CAST({_NOISY} AS INT) AS answer",
        "CAST(doc_id % 3 AS INT) AS fold",
        "CAST(coalesce(lang = 'en', false) AS INT) AS is_en",
        "CAST(coalesce(lang = 'de', false) AS INT) AS is_de",
        "CAST(coalesce(source >= 'src2', false) AS INT) AS is_late",
    )
    options = {**PLANTED, "minInstancesPerNode": 5}
    pipeline = M.boosted_trees(["is_en", "is_de", "is_late"], "answer", trees=1, **options)
    table = materialize(rows, "noisy")
    scores = M.cross_scores(table, pipeline, [{}], key="doc_id", label="answer")
    decided = scores.withColumn("decision", (F.col("score") > 0.5).cast("int"))
    areas = grouped_auc(decided, ["fold", "held_out"], "decision", "label")
    return areas.withColumn("auc", F.round("auc", 9))


@register(
    "grouped_auc",
    """WITH scored AS (SELECT m.model, doc_id % 4 AS part, quality,
                              CASE m.model WHEN 'length' THEN n_chars WHEN 'source' THEN ascii(substr(source, 4))
                                           ELSE 7 END AS score
                       FROM labels JOIN documents USING (doc_id), (VALUES ('length'), ('source'), ('none')) AS m(model)),
            ranked AS (SELECT *, rank() OVER (PARTITION BY model, part ORDER BY score)
                              + (count(*) OVER (PARTITION BY model, part, score) - 1) / 2.0 AS r FROM scored),
            sums AS (SELECT model, part, count(*) FILTER (WHERE quality = 1) AS p, count(*) FILTER (WHERE quality = 0) AS q,
                            sum(r) FILTER (WHERE quality = 1) AS ranks FROM ranked GROUP BY model, part)
       SELECT model, part, p AS positives, q AS negatives,
              round(CASE WHEN p * q > 0 THEN (ranks - p * (p + 1) / 2.0) / (p * q) END, 9) AS auc FROM sums""",
)
def _(spark, sf):
    """Areas of several scores on several parts of the rows, one of them with nothing but ties."""
    documents = load_table(spark, sf, "documents").select("doc_id", "n_chars", "source")
    joined = load_table(spark, sf, "labels").join(documents, "doc_id")
    scores = F.inline(
        F.array(
            *[
                F.struct(F.lit(name).alias("model"), score.cast("double").alias("score"))
                for name, score in {
                    "length": F.col("n_chars"), "source": F.ascii(F.substring("source", 4, 1)), "none": F.lit(7),
                }.items()
            ]
        )
    )
    rows = joined.select((F.col("doc_id") % 4).alias("part"), "quality", scores)
    areas = grouped_auc(rows, ["model", "part"], "score", "quality")
    return areas.withColumn("auc", F.round("auc", 9))


@register(
    "class_weight",
    "SELECT doc_id, quality, CASE WHEN quality = 1 THEN 12.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM labels",
)
def _(spark, sf):
    return load_table(spark, sf, "labels").select(
        "doc_id", "quality", M.class_weight("quality").alias("weight")
    )


@register(
    "blend",
    """SELECT c_custkey, ((c_acctbal + 1000) / 16000 + c_nationkey / 25.0::DOUBLE) / 2.0::DOUBLE AS score
       FROM customer""",
)
def _(spark, sf):
    customers = load_table(spark, sf, "customer")
    first = customers.select("c_custkey", ((F.col("c_acctbal") + 1000) / 16000).alias("score"))
    second = customers.select("c_custkey", (F.col("c_nationkey") / F.lit(25.0)).alias("score"))
    return M.blend([first, second], "c_custkey", "score")


@register(
    "blend_unequal",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey / 25.0::DOUBLE
                              WHEN c_custkey % 5 = 0 THEN (c_acctbal + 1000) / 16000
                              ELSE ((c_acctbal + 1000) / 16000 + c_nationkey / 25.0::DOUBLE) / 2.0::DOUBLE
                         END AS score
       FROM customer""",
)
def _(spark, sf):
    """Tables that lack some customers each: every customer keeps a score."""
    customers = load_table(spark, sf, "customer")
    first = customers.where("c_custkey % 3 <> 0").select(
        "c_custkey", ((F.col("c_acctbal") + 1000) / 16000).alias("score")
    )
    second = customers.where("c_custkey % 3 = 0 OR c_custkey % 5 <> 0").select(
        "c_custkey", (F.col("c_nationkey") / F.lit(25.0)).alias("score")
    )
    return M.blend([first, second], "c_custkey", "score")


@register(
    "blend_three",
    """SELECT o_orderkey, (o_totalprice / 500000 + o_custkey / 32768.0::DOUBLE + o_orderkey / 65536.0::DOUBLE)
              / 3.0::DOUBLE AS score FROM orders""",
)
def _(spark, sf):
    orders = load_table(spark, sf, "orders")
    parts = [
        F.col("o_totalprice") / 500000,
        F.col("o_custkey") / F.lit(32768.0),
        F.col("o_orderkey") / F.lit(65536.0),
    ]
    return M.blend([orders.select("o_orderkey", p.alias("score")) for p in parts], "o_orderkey", "score")
