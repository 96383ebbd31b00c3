"""The registered ``opN_*`` queries: each applies its operator to a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, mixing, quality, token_files, warc
from .alignment import align_corpus
from .embeddings import near_vectors
from .exact import exact_dedup
from .packing import pack
from .passages import repeated_passages
from .shards import shard_documents
from .simhash import simhash_dedup
from .variants import spelling_variants


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in tiers of 512 to 4096 tokens."""
    return pack(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), end_id=2)


def fold(parts: int) -> Column:
    """The fixed folds: crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as archives, read back; files roll at 64 MB compressed."""
    back = warc.write_and_read(_table(spark, sf_dir, "pages"), revisit_bytes=1000, roll_bytes=64 << 20)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def language_model(spark: SparkSession, sf_dir: str) -> langid.Model:
    """Learned from about 20,000 documents of the folds that aren't held out."""
    learn = _table(spark, sf_dir, "documents").where(fold(4) != 2)
    return langid.train(learn, "text", "lang", "doc_id", sample_rows=20000)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return langid.predict(_table(spark, sf_dir, "documents"), language_model(spark, sf_dir),
                          carry=[F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out")], with_spans=False)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as bit-packed ids in doc_id order, read back."""
    return token_files.write_and_read(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), end_id=2)


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that repeat, exactly or at a similarity of
    0.8 over 5-word shingles, in another document."""
    return repeated_passages(_table(spark, sf_dir, "documents"), min_words=50, similarity=0.8, hashes=4)


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3-word shingles, XXH64 seed 42, links at 2 or fewer differing bits."""
    return simhash_dedup(_table(spark, sf_dir, "documents"), size=3, seed=42, budget=2)


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings; links at cosine 0.9 or more."""
    return near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.9)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content sort of all documents; the smallest doc_id of equal texts stays."""
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; 2,048 references a label from the folds that
    aren't held out."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(fold(3) != 1), per_class=2048, dims=64)
    return quality.score(docs, model, neighbours=25,
                         carry=[F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out")])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their sampling probabilities: shares of source and
    language to the power 0.7, of topic 0.8, at 80 % of all tokens."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), budget=0.8,
                       temper={"source": 0.7, "lang": 0.7, "topic": 0.8})
    return mixed.select("doc_id", "source", "lang", "topic", "tokens", "weight", "probability", "selected")


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes; equal texts are linked."""
    return shard_documents(_table(spark, sf_dir, "documents"), shards=16)


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level against piece tokens of all documents."""
    return align_corpus(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"),
                        _vocabulary("piece_bpe_32k.model"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of 7 or more code points with 2 or more occurrences in all
    documents; forms are near words 10 times as frequent."""
    return spelling_variants(_table(spark, sf_dir, "documents"), least=7, occurrences=2, ratio=10, every=31)


QUERIES = {f.__name__: f for f in (
    op1_packing, op2_warc, op3_language_id, op4_token_files, op5_repeated_passages, op6_simhash_near_dedup,
    op7_near_vectors, op8_exact_dedup, op9_quality, op10_mixing, op11_sharding,
    op12_cross_tokenizer_alignment, op13_spelling_variants)}

ORACLES = {
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
        d AS (SELECT page_id, octet_length(encode(t)) AS payload_bytes, sha1(t) AS payload_digest,
                     max(page_id) OVER (PARTITION BY t) AS top FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
        FROM d""",
    "op8_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t
                   FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id,
               count(*) OVER (PARTITION BY t) AS group_size,
               row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept,
               sha256(t) AS text_sha256
        FROM n""",
}
