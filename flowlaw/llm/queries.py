"""The queries opN_<name> over whole tables, and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, media, mixing, oracles, packing, pii, repetition, scoring, sharding, simhash, tokenfiles, toxicity, trie, whitening
from .common import table
from .tokens import byte_bpe_50k, word_bpe_49k

Query = Callable[[SparkSession, str], DataFrame]


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as lossless pictures, stored, read back and described. Null texts are empty, repeated rows alike, long ones several pictures; no documents: no rows."""
    return media.round_trip(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes each document, and its source's size and target. Null sources are one of their own, null texts without words; no documents: no rows."""
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all documents in sequences of 2048 ids. Null texts are one closing id, repeated rows pieces of their own; no documents: no rows."""
    return packing.pack(table(spark, sf_dir, "documents"), byte_bpe_50k(), window=2048)


def op4_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's conditional log-likelihood, token by token from both sides. Null texts have no tokens; no documents: no rows."""
    return scoring.score(table(spark, sf_dir, "documents"), byte_bpe_50k())


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data, and how many. Null texts stay null, repeated rows agree; no documents: no rows."""
    return pii.replaced(table(spark, sf_dir, "documents"), key="a key of the job").select("doc_id", "text", "pii_units")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a network that learns from labels not held out. Null texts count as empty, a null doc_id is not held out; no documents: no rows."""
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and the components that links of at most three bits make. Null texts have fingerprint zero, rows without a doc_id none; no documents: no rows."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, threshold=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations as read back from their formatted texts. Null roles and texts are empty; without rows there is the added conversation only."""
    return chat.format_conversations(spark, sf_dir)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in 16 shards that all have the mixture of sources. Null sources are one of their own, repeated and frequent ids are spread; no documents: no rows."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=16)


def op10_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, repetitions and verdicts by rolling hashes. Null texts have no words; no documents: no rows."""
    return repetition.rules(table(spark, sf_dir, "documents"))


def op11_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places, numbers and checksums of all documents' ids, from files in order of doc_id. Null texts have the closing id only; no documents: no rows."""
    index = tokenfiles.write(table(spark, sf_dir, "documents"), word_bpe_49k(), end=2)
    return tokenfiles.documents(index).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of all embeddings. Null vectors and such with null or non-finite entries have no rows; a deviation too large for a long is null."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), most=32).withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of rebuilt conversations with sums over their subtrees. Null roles and texts are empty, rows without conv_id are left out; no conversations: no rows."""
    return trie.conversation_trie(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it builds on this subpackage

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    found = (op1_media, op2_mixing, op3_packing, op4_scoring, op5_pii, op6_toxicity, op7_simhash, op8_chat, op9_sharding, op10_repetition, op11_tokens, op12_whitening, op13_trie)
    return {f.__name__: f for f in (*found, pipeline)}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
