"""Written intermediate tables: they cut the lineage and survive the loss of executors."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfeat.functions.missing import as_column

_own_dirs: dict[str, str] = {}
_written: list[str] = []
_tables: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own; on a cluster a
    missing setting is an error, because a machine-local folder is not shared.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="sparkfeat-")
    return _own_dirs[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def intermediate_path(spark: SparkSession, label: str) -> str:
    """A path for something that :func:`intermediate_tables` removes."""
    path = scratch_path(spark, label)
    _written.append(path)
    return path


def materialize(
    df: DataFrame,
    label: str = "table",
    partition_by: str | None = None,
    vectors: Sequence[str] = (),
    path: str | None = None,
    dictionaries: bool = True,
) -> DataFrame:
    """Write ``df`` once and read it back; for results that several later jobs scan.

    ``vectors`` names columns that hold vectors in their stored form, to be read as vectors. With
    a ``path`` the table replaces what is there, and :func:`intermediate_tables` leaves it. Without
    ``dictionaries`` values are stored as they are: for tables of hundreds of numbers a row, where
    looking every one up costs more than what is written.
    """
    spark = df.sparkSession
    writer = df.write.mode("overwrite") if path else df.write
    writer = writer if dictionaries else writer.option("parquet.enable.dictionary", "false")
    path = path or intermediate_path(spark, label)
    writer = writer.partitionBy(partition_by) if partition_by else writer
    writer.parquet(path)
    fields = [T.StructField(f.name, VectorUDT() if f.name in vectors else f.dataType) for f in df.schema]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def store_bucketed(df: DataFrame, key: str, buckets: int, label: str = "bucketed") -> DataFrame:
    """Store ``df`` dealt out by its key: aggregates and joins on the key then need no shuffle.

    Tables that are to be joined must have the same number of buckets. The rows of a key share a
    bucket, so this is for tables whose keys are many and none of them very large.
    """
    spark = df.sparkSession
    path = intermediate_path(spark, label)
    table = f"sparkfeat_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, as_column(key))
    dealt.write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    _tables.append(table)
    return spark.table(table)


@contextmanager
def intermediate_tables(spark: SparkSession) -> Iterator[None]:
    """Remove the tables that ``materialize`` writes inside the block when it ends.

    For whole runs whose results are written elsewhere; a table returned from the block is gone.
    """
    before, tables = len(_written), len(_tables)
    try:
        yield
    finally:
        for name in _tables[tables:]:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        del _tables[tables:]
        for name in _written[before:]:
            _remove(spark, name)
        del _written[before:]


def _remove(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Stages:
    """The finished stages of a run, so that a run that was stopped goes on after the last one.

    They lie under the shared folder, by a digest of the run's input files and options: another
    input, a changed file or another option is another run. A stage counts as finished once its
    mark is written, which happens after its table or model is complete; what a stopped stage
    left behind is replaced.
    """

    def __init__(self, spark: SparkSession, inputs: Sequence[str], options: str):
        self.spark = spark
        files = spark.read.format("binaryFile").load(list(inputs))
        seen = files.agg(
            F.count(F.lit(1)).alias("files"),
            F.sum("length").alias("bytes"),
            F.bit_xor(F.xxhash64("path", "length", "modificationTime")).alias("state"),
        ).first()
        identity = hashlib.sha256(repr((tuple(seen), options)).encode()).hexdigest()[:32]
        self.root = f"{scratch_dir(spark)}/run-{identity}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _mark(self, name: str, note: str) -> None:
        table = self.spark.createDataFrame([(note,)], "note string").coalesce(1)
        table.write.mode("overwrite").parquet(self.path(f"{name}-done"))

    def finished(self, name: str) -> str | None:
        """What was noted when the stage ended, or None."""
        try:
            return self.spark.read.schema("note string").parquet(self.path(f"{name}-done")).first()["note"]
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def table(self, name: str, build: Callable[[str], DataFrame]) -> DataFrame:
        """The table that ``build`` stores under the path it is given, now or in an earlier run."""
        schema = self.finished(name)
        if schema is None:
            built = build(self.path(name))
            self._mark(name, built.schema.json())
            return built
        stored = T.StructType.fromJson(json.loads(schema))
        return self.spark.read.schema(stored).parquet(self.path(name))

    def model(self, name: str, build: Callable[[], PipelineModel]) -> PipelineModel:
        """The model that ``build`` trains, now or in an earlier run."""
        if self.finished(name) is None:
            build().write().overwrite().save(self.path(name))
            self._mark(name, "model")
        return PipelineModel.load(self.path(name))

    def remove(self) -> None:
        _remove(self.spark, self.root)


def use_checkpoints(spark: SparkSession) -> None:
    """Give iterative training a checkpoint folder unless the cluster has set one."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_dir(spark))
