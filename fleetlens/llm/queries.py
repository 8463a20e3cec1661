"""Registered queries of the training-data operators, with DuckDB statements where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import chats, decontaminate, jaccardjoin, langid, linerules, nearestvectors, prefixtrie, secretledger, sentencepieces, spellings, tokenfiles, toxicity, wholetokens
from fleetlens.llm.oracles import ORACLE  # noqa: F401
from fleetlens.session import cut_lineage, scratch


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    hits = decontaminate.find_hits(table(spark, sf, "documents"), table(spark, sf, "benchmark"), keep=["doc_id"])
    return decontaminate.digest(hits)


def op6_token_files(spark: SparkSession, sf: str) -> DataFrame:
    return tokenfiles.encode_and_read(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return wholetokens.count_tokens(
        table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"]
    )


def op2_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccardjoin.join(table(spark, sf, "documents"), words=3, num=9, den=10)


def op3_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    held_out = langid.fold(F.col("doc_id"), 4) == 2
    model = langid.fit(docs.where(~held_out))
    return langid.identify(docs, model, keep=["doc_id"]).withColumn("held_out", held_out)


def op4_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    labels = table(spark, sf, "labels")
    held_out = langid.fold(F.col("doc_id"), 5) == 0
    model = toxicity.language_model(docs)
    weights, bias = toxicity.fit(docs, labels.where(~held_out), model)
    scored = toxicity.score(docs, model, weights, bias, keep=["doc_id"])
    return scored.withColumns({"held_out": held_out, "predicted": (F.col("score") >= 0.5).cast("int")})


def op5_line_rules(spark: SparkSession, sf: str) -> DataFrame:
    judged = linerules.judge(table(spark, sf, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_chars")


def op8_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "chats")
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    chats.render(turns.unionByName(chats.attack(spark))).write.parquet(path)
    return chats.digest(spark.read.parquet(path))


def op9_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return sentencepieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"], with_ids=False)


def op10_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    ledger = secretledger.Ledger(spark, scratch(spark, "ledger"))
    ledger.update(docs)
    return secretledger.digest(ledger.of_paths(docs))


def op11_nearest_vectors(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return nearestvectors.search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op12_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spellings.variants(table(spark, sf, "documents").select("doc_id", "text"), plant=True)


def op13_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    turns = prefixtrie.numbered(table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"))
    turns = cut_lineage(turns, "numbered")
    return prefixtrie.trie(prefixtrie.rebuilt(turns), prefixtrie.conversations(turns))


QUERIES = {q.__name__: q for q in (op1_decontaminate, op2_jaccard_join, op3_language, op4_toxicity, op5_line_rules, op6_token_files, op7_token_counts, op8_chat_format, op9_sentencepiece, op10_secret_scan, op11_nearest_vectors, op12_spelling_variants, op13_prefix_trie)}
