"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, language, line_dedup, lm_score, neighbours, ngram_join, packing, sentencepiece_codec, toxicity, warc
from .common import crc_mod, read

#: The vocabularies of the packing, language-model and SentencePiece queries: a path is a parameter of each operator.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document. Labels of held-out ids, those whose crc32 is a multiple of 5, teach nothing.

    Null and empty texts have the bias alone as their score; a repeated row is scored as often as it comes; a null id isn't held out.
    """
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic").where(crc_mod("doc_id", 5) != 0)
    scored = toxicity.score(documents, toxicity.fit(documents, labels), ["doc_id"])
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, round_trip, parity) of every document; ids_crc32 is over little-endian unsigned 32-bit ids.

    A null or empty text has no tokens and the checksum 0; a repeated row is encoded as often as it comes.
    """
    return sentencepiece_codec.encode(read(spark, sf_dir, "documents"), PIECES)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every document: 4-word shingles, Jaccard similarity of 0.85 or more.

    Texts without words have no shingle and link with nothing; rows of one doc_id are one document; a null doc_id has a null component.
    """
    return ngram_join.join(read(spark, sf_dir, "documents"), n=4, percent=85)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, from the merged index of the archives it was written to.

    A null html is an empty payload, a null url has an empty key; a repeated row has a record for each time, all of the largest page_id responses.
    """
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(86_400 * 365)))  # pages have no time of their own
    return warc.archive(pages.withColumn("capture_ts", at)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group).

    A null or empty text is the end token alone; repeated rows are packed as often as they come.
    """
    return packing.pack(read(spark, sf_dir, "documents"), TOKENIZER)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, bits_per_byte) of every document; those whose id's crc32 leaves 2 modulo 4 are held out.

    `und` with score 0 where the text is null or has no letter; a repeated row is scored as often as it comes.
    """
    documents = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    trees = language.fit(documents.where(crc_mod("doc_id", 4) != 2))
    scored = language.predict(documents.select("doc_id", "text"), trees, ["doc_id"])
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document.

    A null text is empty; of rows with one doc_id the order by text hash decides which is next; null ids come last.
    """
    return fingerprints.fingerprint(read(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_kept, removed_lines) of every document: the places of the lines that repeat or resemble one before them.

    Blank lines stay; a null or empty text has one blank line; rows of one doc_id are one document.
    """
    return line_dedup.report(read(spark, sf_dir, "documents"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document; ids whose crc32 leaves 1 modulo 5 teach nothing.

    A null or empty text is its end alone; a repeated row counts and is scored as often as it comes.
    """
    return lm_score.score(read(spark, sf_dir, "documents"), RANKS)


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, rank, vec_id, score): the 10 nearest found of each vector whose id is divisible by 100, among all others.

    Vectors null, empty, zero or with null or non-finite components take no part; ties go to the smaller id.
    """
    return neighbours.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op")}


OP4_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
k as (select payload_digest, max(page_id) as keeper from p where payload_bytes >= 1000 group by payload_digest)
select p.page_id, p.payload_bytes, p.payload_digest,
  case when keeper is not null and p.page_id <> keeper then 'revisit' else 'response' end as record_type,
  case when keeper is not null and p.page_id <> keeper then keeper end as refers_to
from p left join k using (payload_digest)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": OP4_SQL}
