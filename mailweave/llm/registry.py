"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mailweave.llm import (
    bpe_automaton,
    cap_filters,
    chunk_fingerprints,
    collision_search,
    hard_negatives,
    line_dedup,
    ngram_join,
    piece_language,
    pseudo_likelihood,
    pu_quality,
    source_mix,
    spelling_variants,
    warc_zip,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pu_quality": pu_quality.op1_pu_quality,
        "op2_source_mix": source_mix.op2_source_mix,
        "op3_piece_language": piece_language.op3_piece_language,
        "op4_pseudo_likelihood": pseudo_likelihood.op4_pseudo_likelihood,
        "op5_collision_search": collision_search.op5_collision_search,
        "op6_warc_zip": warc_zip.op6_warc_zip,
        "op7_ngram_join": ngram_join.op7_ngram_join,
        "op8_bpe_automaton": bpe_automaton.op8_bpe_automaton,
        "op9_line_dedup": line_dedup.op9_line_dedup,
        "op10_cap_filters": cap_filters.op10_cap_filters,
        "op11_hard_negatives": hard_negatives.op11_hard_negatives,
        "op12_spelling_variants": spelling_variants.op12_spelling_variants,
        "op13_chunk_fingerprints": chunk_fingerprints.op13_chunk_fingerprints,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_source_mix": source_mix.OP2_SQL,
        "op6_warc_zip": warc_zip.OP6_SQL,
        "op9_line_dedup": line_dedup.OP9_SQL,
        "op11_hard_negatives": hard_negatives.OP11_SQL,
        "op12_spelling_variants": spelling_variants.OP12_SQL,
    }
