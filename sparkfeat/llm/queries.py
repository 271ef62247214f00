"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparkfeat.llm.batches import read_table
from sparkfeat.llm.bin_packing import pack_token_ids
from sparkfeat.llm.conversations import audits, damaged
from sparkfeat.llm.exact_search import top_k
from sparkfeat.llm.jaccard_join import near_duplicates
from sparkfeat.llm.language import identify
from sparkfeat.llm.piece_sampling import encode_sampled
from sparkfeat.llm.quality import judge
from sparkfeat.llm.secrets import scan_secrets
from sparkfeat.llm.sharding import shard_documents
from sparkfeat.llm.spelling import spelling_variants
from sparkfeat.llm.token_counts import count_tokens
from sparkfeat.llm.warc import round_trip
from sparkfeat.llm.window_packing import pack_windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def byte_vocabulary() -> tuple[str, str, str]:
    """The id file, the rank file of the same vocabulary, and the pattern that splits text."""
    names = ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
    return (*map(public_tokenizers.path, names), public_tokenizers.PATTERN)


@query
def op1_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as packed rows of 2048 ids; 50256 ends a document."""
    return pack_token_ids(read_table(spark, sf_dir, "documents"), *byte_vocabulary(), end_id=50256)


@query
def op2_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets and linked credential parts of all documents."""
    return scan_secrets(read_table(spark, sf_dir, "documents"))


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents by the piece vocabulary."""
    docs = read_table(spark, sf_dir, "documents")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))


@query
def op4_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents."""
    return identify(read_table(spark, sf_dir, "documents"))


@query
def op5_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards by key, and where they go with 25."""
    return shard_documents(read_table(spark, sf_dir, "documents"), 24)


@query
def op6_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all documents, with cutoffs calibrated on all labels."""
    return judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every 50th vector among all."""
    return top_k(read_table(spark, sf_dir, "embeddings"), every=50)


ORACLES["op7_exact_top_k"] = """
WITH rows AS (
    SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
      AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)
), pairs AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           CAST(list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)]) AS BIGINT) AS score
    FROM rows q JOIN rows c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place
    FROM pairs
)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 5
"""


@query
def op8_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampled segmentation of all documents, seeded by doc_id."""
    docs = read_table(spark, sf_dir, "documents")
    return encode_sampled(docs, public_tokenizers.path("piece_bpe_32k.model"))


@query
def op9_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of at most 1024 ids; id 0 ends a document."""
    return pack_windows(read_table(spark, sf_dir, "documents"), *byte_vocabulary())


@query
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and links of all documents."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words, forms and roots."""
    return spelling_variants(read_table(spark, sf_dir, "documents"))


@query
def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations with faults put in by rule: their cheapest repairs."""
    return audits(damaged(read_table(spark, sf_dir, "conversations")))


@query
def op13_warc_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back."""
    return round_trip(spark, read_table(spark, sf_dir, "pages")).drop("url")


ORACLES["op13_warc_reader"] = """
WITH rows AS (
    SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), known AS (
    SELECT *, octet_length(payload) AS size, max(page_id) OVER (PARTITION BY payload) AS last FROM rows
), marked AS (
    SELECT *, size >= 1000 AND last IS NOT NULL AND page_id IS DISTINCT FROM last AS again FROM known
)
SELECT page_id, size AS payload_bytes, sha1(payload) AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN last END AS refers_to
FROM marked
"""
