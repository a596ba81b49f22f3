"""The registered queries of the training-data operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartwright.llm import conversations, decontaminate, html, lm, negatives, packing, quality, records, simhash, tokens, toxicity, vectors, warc
from chartwright.llm.common import read_table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, distance, end) of every benchmark item in every document; null, empty, repeated and clashing
    input as in contaminated_pairs()."""
    return decontaminate.contaminated_pairs(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of every document by the model of its labelled ones; null and empty texts get the intercepts' values,
    repeated rows are scored each, empty documents give no rows, without toxic labels nothing is toxic."""
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score_severity(docs, toxicity.fit_toxicity(docs, read_table(spark, sf_dir, "labels")))


def packed_digest(docs: DataFrame) -> DataFrame:
    """The pieces of packed_pieces() with their ids' checksum; cases as there."""
    pieces = packing.packed_pieces(docs, VOCABULARY, 1024)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents; cases as in packed_pieces()."""
    return packed_digest(read_table(spark, sf_dir, "documents"))


def op4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start, length and checksum of every document, read back from its record; cases as in write_records(). Empty
    documents: no files, no rows."""
    docs = read_table(spark, sf_dir, "documents")
    _, manifest = records.write_records(docs, VOCABULARY)
    back = records.read_records(spark, manifest)
    return back.select("doc_id", "start", F.expr("cast(length(ids) / 4 as long)").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page and its length in code points; cases as in extract_main_text()."""
    pages = html.extract_main_text(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document; cases as in fit_and_score()."""
    return lm.fit_and_score(read_table(spark, sf_dir, "documents"))


def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and classes of every vector; cases as in vector_links()."""
    # the exact margin makes a row a guest nearly everywhere, so that few, large cells copy least
    return vectors.vector_links(read_table(spark, sf_dir, "embeddings"), cell_rows=8000, spread=None).withColumnRenamed("id", "vec_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every document; cases as in simhash_classes()."""
    classes = simhash.simhash_classes(read_table(spark, sf_dir, "documents"))
    return classes.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length histogram with its suffix sums; null texts have one token, repeated rows count each, empty documents
    give no rows."""
    lengths = tokens.encoded_lengths(read_table(spark, sf_dir, "documents"), VOCABULARY)
    return tokens.suffix_totals(tokens.length_histogram(lengths))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn documents; cases as in resample()."""
    return quality.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The negatives of every anchor and positive; cases as in hard_negatives()."""
    found = negatives.hard_negatives(read_table(spark, sf_dir, "embeddings"))
    return found.drop("blocks_read", "blocks_skipped")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts and cheapest edits of every conversation after damage; cases as in damaged() and repair()."""
    return conversations.repair(conversations.damaged(read_table(spark, sf_dir, "conversations")))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record as read back from files of 32 MB; cases as in write_archive()."""
    _, manifest = warc.write_archive(read_table(spark, sf_dir, "pages"), file_bytes=32 << 20)
    return warc.read_archive(spark, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_toxicity": op2_toxicity,
    "op3_packing": op3_packing,
    "op4_records": op4_records,
    "op5_html": op5_html,
    "op6_lm": op6_lm,
    "op7_vectors": op7_vectors,
    "op8_simhash": op8_simhash,
    "op9_token_counts": op9_token_counts,
    "op10_quality": op10_quality,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_conversations": op12_conversations,
    "op13_warc": op13_warc,
}
ORACLE_SQL: dict[str, str] = {
    "op11_hard_negatives": """WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
  s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score FROM r a JOIN r ON a.vec_id % 50 = 0 AND len(a.v) = len(r.v)),
  p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same AND id <> anchor_id QUALIFY ROW_NUMBER() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
  n AS (SELECT p.*, id AS negative_id, score AS negative_score, CAST(ROW_NUMBER() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
  SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
    "op13_warc": """WITH p AS (SELECT page_id, COALESCE(html, '') AS html FROM pages),
  w AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest, ROW_NUMBER() OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS nth, MIN(page_id) OVER (PARTITION BY html) AS first FROM p)
  SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND nth > 1 THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 100 AND nth > 1 THEN first END AS refers_to FROM w""",
}
