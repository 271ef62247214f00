"""Reading input tables and writing feature and score tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfeat.functions.missing import as_column, quoted
from sparkfeat.sources.schemas import TABLE_FILES, known_types
from sparkfeat.sources.store import materialize

# The texts a CSV field may hold for "missing".
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

INTEGER_PATTERN = r"^\s*[+-]?[0-9]{1,19}\s*$"
NUMBER_PATTERN = (
    r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))\s*$"
)


def blank_na_tokens(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Replace every missing-value token of the string columns by NULL, in one projection."""
    columns = columns or [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    return df.withColumns(
        {c: F.when(~as_column(c).isin(NA_TOKENS), as_column(c)) for c in columns}
    )


def infer_types(texts: DataFrame, columns: list[str]) -> dict[str, str]:
    """Type of each text column after token removal, from one aggregate over all rows.

    A column is ``bigint`` if every value reads as an integer and none is missing, ``double``
    if every present value reads as a number (also when all are missing), else ``string``.
    """
    if not columns:
        return {}
    found = texts.agg(*[e.alias(n) for n, e in text_checks(columns).items()]).first()
    names = ("missing", "no_int", "no_num")
    return {c: kind_of({n: found[f"{n}_{i}"] for n in names}) for i, c in enumerate(columns)}


def text_checks(columns: list[str]) -> dict[str, Column]:
    """Aggregates that tell the type of text columns: of the i-th one, how many values are missing
    (``missing_i``), no integer (``no_int_i``) or no number (``no_num_i``)."""
    checks = {}
    for i, c in enumerate(columns):
        value = as_column(c)
        # The pattern comes first: it is much cheaper than a cast that fails.
        no_int = ~value.rlike(INTEGER_PATTERN) | value.try_cast("bigint").isNull()
        checks[f"missing_{i}"] = F.count_if(value.isNull())
        checks[f"no_int_{i}"] = F.count_if(value.isNotNull() & no_int)
        checks[f"no_num_{i}"] = F.count_if(~value.rlike(NUMBER_PATTERN))
    return checks


def kind_of(found: Mapping[str, int]) -> str:
    """The type that the checks of a column allow."""
    if found["no_num"]:
        return "string"
    return "double" if found["no_int"] or found["missing"] else "bigint"


BROKEN = "_broken_record"


def csv_texts(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """All fields of a CSV file with a header row as text, tokens for "missing" as NULL.

    With ``multi_line`` a quoted field may hold line breaks; a file is then read by one task, so
    large inputs should come as many files.
    """
    return blank_na_tokens(
        spark.read.csv(
            path, header=True, inferSchema=False, enforceSchema=False, escape='"', multiLine=multi_line
        )
    )


def csv_records(
    spark: SparkSession, path: str, types: Mapping[str, str], multi_line: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Records of CSV files whose columns are known, and apart from them those that do not parse.

    The first table has the columns as listed, tokens for "missing" as NULL; the second has the
    text of records with a wrong number of fields, and of those with a field that does not fit
    its type, as ``record`` and with the reason, ``fields`` or the name of the column. Both are
    read from one stored copy. Quoted fields may hold line breaks, quotes and separators.
    """
    schema = ", ".join(f"{quoted(c)} string" for c in [*types, BROKEN])
    raw = spark.read.schema(schema).csv(
        path, header=True, enforceSchema=True, escape='"', multiLine=multi_line, mode="PERMISSIVE",
        columnNameOfCorruptRecord=BROKEN, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
    texts = materialize(blank_na_tokens(raw, list(types)), "records")
    unfit = [
        F.when(as_column(c).isNotNull() & as_column(c).try_cast(kind).isNull(), F.lit(c))
        for c, kind in types.items()
        if kind != "string"
    ]
    reason = F.coalesce(F.when(F.col(BROKEN).isNotNull(), "fields"), *unfit, F.lit(None).cast("string"))
    marked = texts.withColumn("__reason", reason)
    good = marked.where(F.col("__reason").isNull())
    kept = good.select(*[as_column(c).cast(kind).alias(c) for c, kind in types.items()])
    fields = F.to_csv(F.struct(*[as_column(c) for c in types]))
    bad = marked.where(F.col("__reason").isNotNull())
    return kept, bad.select(F.coalesce(F.col(BROKEN), fields).alias("record"), F.col("__reason").alias("reason"))


def _typed(texts: DataFrame, types: Mapping[str, str]) -> DataFrame:
    return texts.select(*[as_column(c).cast(types[c]).alias(c) for c in texts.columns])


def read_csv(
    spark: SparkSession, path: str, types: Mapping[str, str] | None = None
) -> DataFrame:
    """CSV with a header row. Listed columns are cast as given, the others are inferred.

    Fields are read as text, missing-value tokens become NULL, and the cast then raises on
    anything that does not fit the column's type. Only unlisted columns cost an extra pass.
    """
    texts, types = csv_texts(spark, path), dict(types or {})
    types.update(infer_types(texts, [c for c in texts.columns if c not in types]))
    return _typed(texts, types)


def convert_csv(
    spark: SparkSession, path: str, types: Mapping[str, str] | None = None, label: str = "csv"
) -> DataFrame:
    """The table that ``read_csv`` gives, with its text parsed once and stored as parquet.

    Listed columns are stored in their type. Unlisted ones are stored as text: their types come
    from one scan of these columns alone, and the cast is part of the later column scans.
    """
    texts, types = csv_texts(spark, path), dict(types or {})
    unlisted = [c for c in texts.columns if c not in types]
    first = {c: types.get(c, "string") for c in texts.columns}
    stored = materialize(_typed(texts, first), label)
    return _typed(stored, {**first, **infer_types(stored, unlisted)})


def load_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A parquet table of a data folder."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def load_loan_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One of the eight loan-history CSV tables, converted once; every later pass reads columns."""
    return convert_csv(spark, f"{directory}/{TABLE_FILES[name]}", known_types(name), name)


def write_scores(scores: DataFrame, path: str, fmt: str = "csv") -> None:
    """Score table, one file per partition; CSV files carry a header row."""
    writer = scores.write.format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def write_features(
    features: DataFrame,
    path: str,
    *,
    partition_by: str | None = None,
    bucket_by: str | None = None,
    buckets: int | None = None,
    table: str | None = None,
) -> None:
    """Feature table as parquet; bucketed by the entity key if a catalog table is named.

    A bucketed table can be joined and aggregated on its key again without a shuffle.
    """
    writer = features.write.format("parquet")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    if bucket_by:
        if not table or not buckets:
            raise ValueError("bucketing needs a table name and a number of buckets")
        writer.bucketBy(buckets, bucket_by).sortBy(bucket_by).option("path", path).saveAsTable(
            table
        )
    else:
        writer.save(path)
