"""One thin query per operator: the operator over the whole of its table, digest columns from its rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import (bitpack, decontaminate, divergence, entropy, filter_audit, hilbert, mixing_lm, neardup, ngram_join, repeats, rules, secrets,
               toxicity)
from .common import shared_path, stash, table, text_bytes
from .registry import query


@query("op1_hilbert_shards")
def op1(spark, sf_dir):
    """All documents in 16 shards along a Hilbert curve over source, language and size (law ``rows``)."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", (F.length(text_bytes()) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text_bytes()).alias("text_crc32"))
    out = hilbert.hilbert_shards(stash(docs, "slim"), ["source", "lang", "size"], 16, ["text_crc32", "doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "curve")


@query("op2_bit_packing")
def op2(spark, sf_dir):
    """All documents' token ids written as packed blocks in doc_id order, and read back from the files."""
    import public_tokenizers
    path = shared_path(spark, "packed")
    bitpack.write_packed(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), 50_257, 2)
    return bitpack.read_packed(spark, path)


@query("op3_conv_toxicity")
def op3(spark, sf_dir):
    """Toxicity score of every document from a model that has learned no held-out label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.DECIDE).cast("int").alias("predicted"))


@query("op4_context_mixing")
def op4(spark, sf_dir):
    """Unigram and context-mixing log probabilities of every document."""
    out = mixing_lm.score_texts(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


@query("op5_entropy_mix", entropy.ORACLE)
def op5(spark, sf_dir):
    """All documents mixed to the source targets by entropy balancing."""
    out = entropy.mix_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


@query("op6_prefix_join")
def op6(spark, sf_dir):
    """Words and items of the benchmark found in every document."""
    out = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                      F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op7_bwt_repeats")
def op7(spark, sf_dir):
    """Bytes of every document covered by a 400-byte string that also starts elsewhere."""
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("row")


@query("op8_decision_list")
def op8(spark, sf_dir):
    """Base statistics of every document and the verdict of the learned decision list."""
    out = rules.judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op9_secret_ownership")
def op9(spark, sf_dir):
    """Secret spans of every document, with corpus-wide ownership of each candidate value."""
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


@query("op10_chosen_path")
def op10(spark, sf_dir):
    """Near-duplicate components of all documents."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).drop("row")


@query("op11_count_bitmaps", divergence.ORACLE)
def op11(spark, sf_dir):
    """Divergence of every source of a language from its other sources, and the terms that set it apart."""
    return divergence.audit(table(spark, sf_dir, "documents"))


@query("op12_ngram_join")
def op12(spark, sf_dir):
    """Components of all documents by n-gram similarity."""
    return ngram_join.ngram_components(table(spark, sf_dir, "documents")).drop("row")


@query("op13_filter_potential", filter_audit.ORACLE)
def op13(spark, sf_dir):
    """What five filters remove from all documents, in each of their 120 orders."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
