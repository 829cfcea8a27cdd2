"""The queries of the corpus operators, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelloom.llm.common import Workspace, table


def op1_bitplane_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from panelloom.llm.tokens import token_table

    return token_table(table(spark, sf_dir, "documents"), Workspace(spark, "op1"), public_tokenizers.path("word_bpe_49k.json"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelloom.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), Workspace(spark, "op2"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelloom.llm.lines import dedup_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, Workspace(spark, "op3")).select("doc_id", "n_lines", "n_dropped", "text")


def op4_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelloom.llm.quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Workspace(spark, "op4"))


def op5_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelloom.llm.matroska import media_column

    return media_column(table(spark, sf_dir, "documents"), Workspace(spark, "op5"))


def op6_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelloom.llm.decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Workspace(spark, "op6"))


def op7_collinear_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelloom.llm.passages import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"), Workspace(spark, "op7"))


def op8_unigram_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from panelloom.llm.pieces import piece_table

    return piece_table(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_mincut_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelloom.llm.html import extract

    return extract(table(spark, sf_dir, "pages"))


def op10_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelloom.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op11_sparse_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelloom.llm.infill import infill_digests

    return infill_digests(table(spark, sf_dir, "documents"))


def op12_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelloom.llm.forest import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), Workspace(spark, "op12"))


def op13_harmonic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelloom.llm.periods import run_digests

    return run_digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bitplane_tokens, op2_simhash_dedup, op3_line_dedup, op4_bradley_terry, op5_matroska, op6_spaced_seeds, op7_collinear_passages, op8_unigram_pieces, op9_mincut_html, op10_cross_parsing, op11_sparse_infill, op12_lsh_forest, op13_harmonic_runs)}


def oracle_sql() -> dict[str, str]:
    from panelloom.llm import forest, infill

    return {"op11_sparse_infill": infill.SQL, "op12_lsh_forest": forest.SQL}
