"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import chat, fingerprint, lines, packing, pieces, pii, repair, simhash, substring, topk, toxicity, warc, whitening
from tidewell.session import load


def vocabulary_path(name: str) -> str:
    """A public vocabulary file's place on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the passages that an earlier document, or place, has."""
    cut = substring.remove_repeats(load(spark, sf_dir, "documents"))
    return cut.select("doc_id", "text", "removed_sentences", "removed_chars")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint.fingerprint_documents(load(spark, sf_dir, "documents"))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sampled segmentations of every document, distinct, with their scores, decoded."""
    return pieces.sample_digests(load(spark, sf_dir, "documents"), vocabulary_path("piece_bpe_32k.model"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back; a row per page."""
    index, folder = warc.write_warc(load(spark, sf_dir, "pages"))
    return warc.read_warc(index, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"
    )


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best inner products of every vector whose id is divisible by 50."""
    vectors = topk.quantised(load(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens; a row per piece."""
    pieces = packing.pack(load(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))
    return packing.with_checksums(pieces)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1 of control strings, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    extra = [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    extra = spark.createDataFrame(extra, "conv_id long, turn long, role string, text string")
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    vocabulary = vocabulary_path("byte_bpe_50k.json")
    read = chat.read_back(chat.assemble(chat.format_turns(rows, vocabulary)), vocabulary)
    return read.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their SimHash fingerprint and the group of near-duplicates."""
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


def toxicity_chain(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Chain:
    """The chain low_quality, toxic, fitted to the labels of ``docs``."""
    labels = load(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return toxicity.train(docs, labels, ["low_quality", "toxic"])


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the chain's probabilities and its verdict."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_chain(spark, docs, sf_dir))
    return scored.select(
        "doc_id", F.round("p_low_quality", 6).alias("p_low_quality"), F.round("p_toxic", 6).alias("p_toxic"),
        (F.col("p_toxic") >= toxicity.THRESHOLD).cast("int").alias("toxic"),
    )


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that an earlier document, or place, has, be it
    with slight changes."""
    cut = lines.dedup_lines(load(spark, sf_dir, "documents"))
    return cut.select("doc_id", "text", "removed_lines")


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return pii.find(load(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 whitened components of all embeddings."""
    return whitening.whiten(load(spark, sf_dir, "embeddings"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged as the contract says and repaired."""
    return repair.repair(load(spark, sf_dir, "conversations"))
