"""Operator 7: exact top-k inner products by branch and bound over blocks of dimensions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkfeat.llm.batches import one_thread
from sparkfeat.sources.store import materialize

#: Rows of a block of candidates and of queries, and dimensions added at a time.
CANDIDATES, QUERIES, DIMENSIONS = 8192, 256, 16
#: Candidates, the first by a hash of their ids, whose scores give every query its first bound.
SEEDS = 4096
#: Candidates of a part of the grid, unless that makes fewer parts than a shuffle has.
PART_ROWS = 65536
#: Below this sum of products 64-bit floats are exact, with room for the bounds.
EXACT = 2**50
LONG = 2**63 - 1

FOUND = "query_id long, vec_id long, score long"


def whole_components(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id and floor(scale * x) of every component, of vectors that take part."""
    value = F.col("embedding").cast("array<double>")
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), value.alias("v"))
        .where("v IS NOT NULL AND vec_id IS NOT NULL")
        .where(
            "forall(v, x -> x IS NOT NULL AND NOT isnan(x) "
            "AND abs(x) < CAST('Infinity' AS DOUBLE))"
        )
        .selectExpr("vec_id", f"transform(v, x -> floor(x * {scale}D)) AS v")
    )


def matrix(rows: pa.Array) -> np.ndarray:
    """The vectors as columns of one matrix, filled with zeros up to the longest."""
    width = np.diff(rows.offsets.to_numpy())
    values = rows.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((int(width.max(initial=0)), len(rows)), np.int64)
    within = np.arange(len(values)) - np.repeat(np.cumsum(width) - width, width)
    out[within, np.repeat(np.arange(len(rows)), width)] = values
    return out


def block(batch: pa.RecordBatch) -> pa.RecordBatch:
    """One row: ids in order, dimensions, bytes of a value, and the values dimension by dimension."""
    ids = batch.column("vec_id").to_numpy()
    values = matrix(batch.column("v"))
    order = np.argsort(ids, kind="stable")
    kind = np.int16 if np.abs(values).max(initial=0) < 2**15 else np.int64
    held = np.ascontiguousarray(values[:, order]).astype(kind)
    return pa.record_batch(
        [
            pa.array([ids[order].tobytes()], pa.binary()), pa.array([held.shape[0]], pa.int32()),
            pa.array([held.itemsize], pa.int32()), pa.array([held.tobytes()], pa.binary()),
        ],
        names=["ids", "dims", "width", "vals"],
    )


BLOCK = "ids binary, dims int, width int, vals binary"


def candidate_blocks(rows: DataFrame) -> DataFrame:
    """The rows of every task in blocks of bounded size."""

    def run(batches):
        one_thread()
        held, size = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, CANDIDATES):
                part = batch.slice(i, CANDIDATES)
                if size + part.num_rows > CANDIDATES:
                    yield whole_block(held)
                    held, size = [], 0
                held.append(part)
                size += part.num_rows
        if held:
            yield whole_block(held)

    return rows.mapInArrow(run, BLOCK)


def whole_block(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return block(pa.Table.from_batches(batches).combine_chunks().to_batches()[0])


def seed_block(rows: DataFrame) -> DataFrame:
    """One row with a bounded sample of the candidates, the same in every run."""
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SEEDS)

    def run(table: pa.Table) -> pa.Table:
        one_thread()
        batch = whole_block(table.select(["vec_id", "v"]).to_batches())
        return pa.Table.from_batches([batch]).append_column("one", pa.array([0], pa.int32()))

    return some.groupBy(F.pmod("vec_id", F.lit(1)).cast("int").alias("one")).applyInArrow(run, f"{BLOCK}, one int")


def query_blocks(rows: DataFrame, buckets: int) -> DataFrame:
    """The queries in numbered blocks, dealt by a hash of their distinct ids."""

    def run(table: pa.Table) -> pa.Table:
        one_thread()
        batch = table.combine_chunks().to_batches()[0]
        return pa.Table.from_batches([block(batch)]).append_column(
            "bucket", batch.column("bucket").slice(0, 1)
        )

    dealt = rows.withColumn("bucket", F.expr(f"int(pmod(xxhash64(vec_id), {buckets}))"))
    return dealt.groupBy("bucket").applyInArrow(run, f"{BLOCK}, bucket int")


def unpack(row: dict, side: str) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[f"{side}_ids"], np.int64)
    kind = np.int16 if row[f"{side}_width"] == 2 else np.int64
    values = np.frombuffer(row[f"{side}_vals"], kind).astype(np.int64)
    return ids, values.reshape(row[f"{side}_dims"], len(ids))


def best_of_block(query_ids, queries, ids, values, k: int, floor=None, reached=None):
    """The ``k`` best candidates of one block for every query: index of the query, id, score.

    Every query adds its dimensions in the order of their weight in it, a block of them at a time,
    over the candidates that survive. What is left can add at most the product of the remaining
    norms. A candidate that cannot reach the query's bound is dropped, and those that stay are
    compacted; the bound is the k-th best lower bound in the block, or ``floor`` if that is more: a
    score that k other rows of the table have or exceed. So of a block less than k candidates, or
    none, may be left. Rows with the query's own id, however many, are no candidates.

    ``reached``, a list, gets the number of candidates that every query has at its last block.
    """
    dims = max(len(queries), len(values))
    queries = np.pad(queries, ((0, dims - len(queries)), (0, 0)))
    values = np.pad(values, ((0, dims - len(values)), (0, 0)))
    top = float(np.abs(queries).max(initial=0)) * float(np.abs(values).max(initial=0)) * max(dims, 1)
    square = float(np.abs(values).max(initial=0)) ** 2 * max(dims, 1)
    if max(top, square) >= EXACT:
        return whole_numbers(query_ids, queries, ids, values, k)
    c = values.astype(np.float64)
    squares = (c * c).sum(axis=0)
    found = [(np.zeros(0, np.int64),) * 3]
    for i, own in enumerate(query_ids):
        first = -np.inf if floor is None else floor[i]
        names, scores = best_of_query(queries[:, i].astype(np.float64), c, squares, ids, own, k, first, reached)
        found.append((np.full(len(names), i), names, scores.astype(np.int64)))
    return first_k(*(np.concatenate(x) for x in zip(*found)), k)


def kth(values: np.ndarray, k: int) -> float:
    """The k-th largest value, or less than any if there are fewer."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def best_of_query(q, c, squares, ids, own, k: int, bound: float, reached=None):
    """Names and scores of what may be among the query's ``k`` best; see :func:`best_of_block`."""
    order = np.argsort(-np.abs(q), kind="stable")
    weights = q[order]
    tail = np.sqrt(np.append(np.cumsum((weights * weights)[::-1])[::-1], 0.0)) * (1 + 1e-9)
    alive = np.flatnonzero(ids != own)
    scores, left = np.zeros(len(alive)), squares[alive]
    for d in range(0, len(q), DIMENSIONS):
        rows = order[d : d + DIMENSIONS]
        last = d + DIMENSIONS >= len(q)
        if last and reached is not None:
            reached.append(len(alive))
        part = c[rows] if len(alive) == c.shape[1] else c[np.ix_(rows, alive)]
        scores = scores + weights[d : d + DIMENSIONS] @ part
        if last:
            break
        left = left - (part * part).sum(axis=0)  # whole numbers: exact
        slack = tail[d + DIMENSIONS] * np.sqrt(left) * (1 + 1e-9) + 1e-6
        bound = max(bound, kth(scores - slack, k))
        keep = np.flatnonzero(scores + slack >= bound)
        if len(keep) < len(alive):
            alive, scores, left = alive[keep], scores[keep], left[keep]
    keep = scores >= max(bound, kth(scores, k))
    return ids[alive[keep]], scores[keep]


def whole_numbers(query_ids, queries, ids, values, k: int):
    """The same for components too large for floats, with Python's integers."""
    at, names, scores = [], [], []
    for i in range(len(query_ids)):
        row = queries[:, i].astype(object) @ values.astype(object)
        pairs = sorted((-s, n) for s, n in zip(row, ids.tolist()) if n != query_ids[i])[:k]
        at += [i] * len(pairs)
        names += [n for _, n in pairs]
        scores += [max(-LONG - 1, min(LONG, -s)) for s, _ in pairs]
    return np.array(at, np.int64), np.array(names, np.int64), np.array(scores, np.int64)


def first_k(at, names, scores, k: int):
    """At most ``k`` entries of each query, by score and then the smaller id."""
    order = np.lexsort((names, -scores, at))
    at, names, scores = at[order], names[order], scores[order]
    rank = np.arange(len(at)) - np.searchsorted(at, at)
    return at[rank < k], names[rank < k], scores[rank < k]


def top_k(vectors: DataFrame, every: int, k: int = 5, scale: int = 256) -> DataFrame:
    """The ``k`` highest integer inner products of every ``every``-th vector with all others.

    Components become floor(scale * x). Queries are the rows whose vec_id is divisible by
    ``every``. Ties go to the smaller vec_id. Vectors that are missing, hold a missing or
    non-finite component or have no vec_id take no part. A shorter vector counts as filled with
    zeros; rows with the query's own vec_id are the query's own; a query row that occurs several
    times is answered once; scores beyond 64 bits stay at the limit; an empty table gives no rows.

    Candidates and queries become blocks of bounded size in vertical layout. The scores of a
    bounded sample of the candidates give every query its first bound. Then the blocks of queries,
    an ``every``-th of the rows, go to a grid of parts of the candidates, which move once; a task
    meets its candidates block by block, with the bounds that the blocks before have raised, and
    returns at most k rows a query.
    """
    spark = vectors.sparkSession
    rows = whole_components(vectors, scale)
    blocks = materialize(candidate_blocks(rows), "candidates")
    asked = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    buckets = max(1, -(-asked.count() // QUERIES))
    size = blocks.agg(F.count(F.lit(1)), F.sum(F.octet_length("ids") / 8)).first()
    least = -(-int(size[1] or 0) // PART_ROWS)
    parts = max(1, min(size[0], max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    queries = query_blocks(asked, buckets).withColumn("one", F.pmod("bucket", F.lit(1)))
    bounded = with_floors(queries, seed_block(rows), k)
    candidates = dealt(blocks.toDF("c_ids", "c_dims", "c_width", "c_vals"), parts)
    # the number of parts is given on both sides, as their bytes do not tell how much work they are
    pairs = (
        bounded.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        .repartition(parts, "part")
        .join(candidates.repartition(parts, "part"), "part")
    )

    def run(batches):
        one_thread()
        held = None
        for batch in batches:
            for row in batch.to_pylist():
                if held is None or (row["bucket"], row["part"]) != held.name:
                    if held is not None:
                        yield held.batch()
                    held = Running(row, k)
                held.meet(*unpack(row, "c"))
        if held is not None:
            yield held.batch()

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        pairs.mapInArrow(run, FOUND)
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def dealt(stored: DataFrame, parts: int) -> DataFrame:
    """The rows of a stored table with a ``part`` from 0 below ``parts``, dealt out in turn.

    Every partition of the table starts one part after the one before, so that partitions of few
    rows do not all begin with the same part.
    """
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    turn = F.pmod(F.spark_partition_id() + within, F.lit(parts))
    return stored.withColumn("part", turn.cast("int"))


class Running:
    """A block of queries, with the best of the candidates that it has met and its bounds."""

    def __init__(self, row: dict, k: int):
        self.name, self.k = (row["bucket"], row["part"]), k
        self.ids, self.vectors = unpack(row, "q")
        self.floor = np.frombuffer(row["floor"], np.float64).copy()
        self.best = (np.zeros(0, np.int64),) * 3

    def meet(self, ids: np.ndarray, values: np.ndarray) -> None:
        new = best_of_block(self.ids, self.vectors, ids, values, self.k, self.floor)
        self.best = first_k(*(np.concatenate(x) for x in zip(self.best, new)), self.k)
        at, _, scores = self.best
        full = np.flatnonzero(np.arange(len(at)) - np.searchsorted(at, at) == self.k - 1)
        self.floor[at[full]] = np.maximum(self.floor[at[full]], scores[full])

    def batch(self) -> pa.RecordBatch:
        at, names, scores = self.best
        return pa.record_batch(
            [pa.array(self.ids[at]), pa.array(names), pa.array(scores)],
            names=["query_id", "vec_id", "score"],
        )


def with_floors(queries: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """The blocks of queries with a bound for every query: its k-th best score in the sample."""
    sample = seeds.toDF("c_ids", "c_dims", "c_width", "c_vals", "one")
    named = queries.toDF("q_ids", "q_dims", "q_width", "q_vals", "bucket", "one")
    schema = "q_ids binary, q_dims int, q_width int, q_vals binary, bucket int, floor binary"

    def run(batches):
        one_thread()
        for batch in batches:
            for row in batch.to_pylist():
                ids, vectors = unpack(row, "q")
                floor = np.full(len(ids), -np.inf)
                at, _, scores = best_of_block(ids, vectors, *unpack(row, "c"), k)
                full = np.flatnonzero(np.arange(len(at)) - np.searchsorted(at, at) == k - 1)
                # a score at the limit of 64 bits may stand for a larger one, but never for less
                floor[at[full]] = scores[full]
                kept = [row[n] for n in ("q_ids", "q_dims", "q_width", "q_vals", "bucket")]
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(("q_ids", "q_dims", "q_width", "q_vals", "bucket", "floor"), [*kept, floor.tobytes()]))],
                    schema=FLOORS,
                )

    return named.join(F.broadcast(sample), "one").mapInArrow(run, schema)


FLOORS = pa.schema(
    [
        ("q_ids", pa.binary()), ("q_dims", pa.int32()), ("q_width", pa.int32()),
        ("q_vals", pa.binary()), ("bucket", pa.int32()), ("floor", pa.binary()),
    ]
)
