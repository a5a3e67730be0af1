"""The queries of this folder by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillroll.llm import chat, collocations, decontamination, embeddings, html, packing, pii, quality, repeats, simhash, spelling, tokens, toxicity
from tillroll.llm.common import table


def op1_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    return chat.digests(chat.format_conversations(chat.with_planted(table(spark, folder, "conversations"))))


def op2_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return pii.find(docs, pii.train(docs))


def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def op4_embedding_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, folder, "embeddings"))


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.score_documents(docs, quality.train(docs, table(spark, folder, "labels")))


def op6_repeated_strings(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, folder, "documents"))


def op7_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract(table(spark, folder, "pages"))


def op8_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.round_trip(table(spark, folder, "documents"))


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op11_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, folder, "labels")))


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.group_variants(table(spark, folder, "documents"))


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.top_collocations(table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat_format, op2_personal_data, op3_best_fit_packing, op4_embedding_duplicates, op5_quality,
                                    op6_repeated_strings, op7_main_text, op8_token_ids, op9_decontamination, op10_simhash,
                                    op11_toxicity, op12_spelling_variants, op13_collocations)}


def oracle_sql() -> dict[str, str]:
    """SQL for what SQL can express; the others are held against brute force in the tests."""
    return {"op1_chat_format": chat.SQL, "op4_embedding_duplicates": embeddings.SQL, "op6_repeated_strings": repeats.SQL,
            "op7_main_text": html.SQL, "op9_decontamination": decontamination.SQL,
            "op12_spelling_variants": spelling.SQL, "op13_collocations": collocations.SQL}
