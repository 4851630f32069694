"""The training-data operators bound to the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrastat.llm.conversations import damaged, repair_report
from terrastat.llm.decontaminate import benchmark_hits
from terrastat.llm.langid import identify
from terrastat.llm.minhash import near_duplicates
from terrastat.llm.packing import pack
from terrastat.llm.quality import learn_quality, quality_scores
from terrastat.llm.recurrent import language_scores
from terrastat.llm.repeats import repeated_strings
from terrastat.llm.rules import quality_rules
from terrastat.llm.secrets import secret_report
from terrastat.llm.toxicity import learn_severity, severity
from terrastat.llm.vectorcodes import encode
from terrastat.llm.warc import archive_report

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of the session and the folder of tables under ``name``."""

    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def crc_mod(k: int) -> Column:
    """crc32 of ``doc_id`` as text, modulo ``k``; a missing id counts as 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % k, F.lit(0))


@query("op1_packing")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, with_tokens=False)


@query("op2_quality_classifier")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs, held_out = table(spark, folder, "documents"), crc_mod(5) == 0
    model = learn_quality(docs, table(spark, folder, "labels"), ~held_out)
    return quality_scores(docs, model, cut=0.3).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op3_secret_scans")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return secret_report(table(spark, folder, "documents"))


@query("op4_toxicity")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return severity(docs, learn_severity(docs, table(spark, folder, "labels")))


OP5_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
    FROM documents),
g AS (
    SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct([array_to_string(ws[i:i + 3], ' ') FOR i IN range(1, len(ws) - 2)]) END AS gs
    FROM w),
s AS (SELECT doc_id, len(gs) AS n, hash(unnest(gs)) AS h FROM g),
p AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id AND r.root < e.b),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT g.doc_id, CAST(len(gs) AS BIGINT) AS n_shingles, component_id, g.doc_id = component_id AS kept FROM g JOIN c USING (doc_id)
"""


@query("op5_minhash", OP5_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), words=4, similarity=80)


@query("op6_decontamination")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return benchmark_hits(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op7_suffix_dedup")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_strings(table(spark, folder, "documents"), length=400)


@query("op8_quality_rules")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op9_language_id")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = crc_mod(3) == 1
    return identify(docs, ~held_out).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op10_recurrent_scores")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    held_out = crc_mod(7) == 2
    rows = language_scores(table(spark, folder, "documents"), ~held_out)
    return rows.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op11_vector_codes")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    rows = encode(table(spark, folder, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)
    return rows.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


@query("op12_warc")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return archive_report(table(spark, folder, "pages"), least_bytes=0)


@query("op13_conversation_repair")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return repair_report(damaged(table(spark, folder, "conversations")))
