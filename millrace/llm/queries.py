"""The driver's queries over the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .bitsliced import top_k
from .bpe import encode_digests
from .classlm import class_lm_scores
from .gif import store_texts
from .langid import identify
from .mixing import mix
from .pii import report
from .runtime import scratches
from .simhash import simhash_components
from .substring import remove_repeats
from .warc import roundtrip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(spark, _table(spark, sf_dir, "documents"))


def op2_classlm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm_scores(spark, _table(spark, sf_dir, "documents"))


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark, _table(spark, sf_dir, "documents"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark, _table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roundtrip(spark, _table(spark, sf_dir, "pages"))


# DuckDB gives SHA-1 in hexadecimal; every five digits are four of base 32.
_BASE32 = """list_aggregate(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), 'string_agg', '')"""

OP5_SQL = f"""
WITH d AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
w AS (SELECT h, max(page_id) AS top FROM d GROUP BY h)
SELECT d.page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_BASE32.replace("(h,", "(d.h,")} AS payload_digest,
       CASE WHEN d.page_id = w.top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN d.page_id = w.top THEN NULL ELSE w.top END AS refers_to
FROM d JOIN w ON d.h = w.h
"""


def op6_bitsliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark, _table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
           FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op7_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_texts(spark, _table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark, _table(spark, sf_dir, "documents"))


VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    return encode_digests(spark, _table(spark, sf_dir, "documents"), str(path), public_tokenizers.PATTERN)


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, _table(spark, sf_dir, "documents"))


Query = Callable[[SparkSession, str], DataFrame]


def _cleared(query: Query) -> Query:
    """A query that leaves no tables behind if it fails."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with scratches(keep_results=True):
            return query(spark, sf_dir)

    return run


_ALL = (
    op1_simhash, op2_classlm, op3_substring, op4_langid, op5_warc, op6_bitsliced, op7_gif, op8_pii, op9_bpe, op10_mix,
)
QUERIES: dict[str, Query] = {q.__name__: _cleared(q) for q in _ALL}
ORACLE_SQL: dict[str, str] = {"op5_warc": OP5_SQL, "op6_bitsliced": OP6_SQL}
