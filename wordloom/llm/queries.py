"""The operators' queries over the tables of a folder, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import byte_bpe, chat_format, decontaminate, image_copies, jaccard_join, language_id, license_scan, token_archive, toxicity, warc
from wordloom.llm.shared import fold_of

END_ID = 2


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a benchmark passage, with the item and the region."""
    return decontaminate.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang").withColumn("held_out", fold_of(F.col("doc_id")) == 0)
    model = language_id.fit(docs.where(~F.col("held_out")))
    return language_id.predict(docs, model, keep=("doc_id", "held_out"))


def op3_image_copies(spark: SparkSession, folder: str) -> DataFrame:
    """Classes of near-copies among the vectors of ``embeddings``, drawn as images."""
    return image_copies.copies(image_copies.render_vectors(table(spark, folder, "embeddings"), "vec_id", "embedding"))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text").withColumn("held_out", fold_of(F.col("doc_id")) == 0)
    labels = table(spark, folder, "labels").where(fold_of(F.col("doc_id")) != 0)
    return toxicity.score(docs, toxicity.fit(docs, labels), keep=("doc_id", "held_out"))


def op5_token_archive(spark: SparkSession, folder: str) -> DataFrame:
    path, manifest, dictionary = token_archive.write_archive(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return token_archive.digest(token_archive.read_archive(path, manifest, dictionary))


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's URL is looked up in the index, and the records that it names are read."""
    pages = table(spark, folder, "pages")
    path, captures = warc.write_archives(pages)
    return warc.read_archives(path, warc.look_up(path, warc.write_index(path, captures), pages))


def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(table(spark, folder, "documents"))


def op8_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    out = byte_bpe.round_trip_digests(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.withColumnRenamed("id", "doc_id")


def op9_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    return chat_format.link_calls(chat_format.turns_as_calls(table(spark, folder, "conversations")), chat_format.REPLY_SCHEMA)


def op10_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Sets of four-word shingles, linked from a similarity of 0.85 on."""
    return jaccard_join.join_components(table(spark, folder, "documents"), 4, 85, 100)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


#: A SHA-1 in hexadecimal as base32: five digits at a time are four letters.
_BASE32 = "list_aggregate(list_transform(range(0, 8), lambda i: list_aggregate(list_transform([15, 10, 5, 0], lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(h, CAST(5 * i + 1 AS INTEGER), 5) AS INTEGER) >> b) & 31) + 1, 1)), 'string_agg', '')), 'string_agg', '')"

OP6_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages WHERE page_id IS NOT NULL),
q AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h, min(page_id) OVER (PARTITION BY b) AS f FROM p)
SELECT page_id, n AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to FROM q
"""

OP9_SQL = """
WITH m AS (SELECT conv_id AS conversation, turn, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE role END AS kind, CASE role WHEN 'user' THEN 't' || turn WHEN 'assistant' THEN 't' || (turn - 1) END AS call_id, text FROM conversations),
c AS (SELECT DISTINCT conversation, call_id, turn FROM m WHERE kind = 'call'), r AS (SELECT DISTINCT conversation, call_id FROM m WHERE kind = 'result')
SELECT m.conversation, m.turn, m.kind, m.call_id, CASE WHEN m.kind = 'result' THEN greatest(m.turn, c.turn) ELSE m.turn END AS sort_turn, CASE WHEN m.kind = 'result' THEN 1 ELSE 0 END AS sort_phase,
CASE m.kind WHEN 'call' THEN r.call_id IS NOT NULL WHEN 'result' THEN c.call_id IS NOT NULL END AS linked, CASE m.kind WHEN 'call' THEN true END AS valid,
'{' || concat_ws(',', CASE WHEN m.kind = 'call' THEN '"arguments":{"prompt":' || to_json(coalesce(m.text, '')) || ',"turn":' || m.turn || '}' END, '"call_id":' || to_json(m.call_id), CASE WHEN m.kind <> 'call' THEN '"content":' || to_json(m.text) END, '"kind":' || to_json(m.kind), CASE WHEN m.kind = 'call' OR m.kind = 'result' AND c.call_id IS NOT NULL THEN '"name":"reply"' END) || '}' AS message
FROM m LEFT JOIN c ON m.kind IN ('call', 'result') AND c.conversation = m.conversation AND c.call_id = m.call_id LEFT JOIN r ON m.kind = 'call' AND r.conversation = m.conversation AND r.call_id = m.call_id
"""

OP10_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x09-\\x0D\\x20]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
l AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
t AS (SELECT u, v FROM l UNION SELECT t.u, l.v FROM t JOIN l ON t.v = l.u)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, least(doc_id, coalesce(z.c, doc_id)) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT u AS doc_id, min(v) AS c FROM t GROUP BY u) z USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that it can express; the others are tested against plain versions."""
    return {"op6_warc": OP6_SQL, "op9_chat_format": OP9_SQL, "op10_jaccard_join": OP10_SQL}
