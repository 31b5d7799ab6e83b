"""The queries of this package and, where SQL can express them, their DuckDB twins."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    collision_embeddings,
    curve_packing,
    fim_automaton,
    gif_columns,
    kn_language,
    line_runs,
    linear_grouping,
    phrase_automata,
    pivot_simhash,
    pu_toxicity,
    token_counts,
    url_aliases,
    word_table_bpe,
)

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_url_aliases": url_aliases.op1_url_aliases,
        "op2_line_runs": line_runs.op2_line_runs,
        "op3_curve_packing": curve_packing.op3_curve_packing,
        "op4_kn_language": kn_language.op4_kn_language,
        "op5_pivot_simhash": pivot_simhash.op5_pivot_simhash,
        "op6_collision_embeddings": collision_embeddings.op6_collision_embeddings,
        "op7_word_table_bpe": word_table_bpe.op7_word_table_bpe,
        "op8_pu_toxicity": pu_toxicity.op8_pu_toxicity,
        "op9_gif_columns": gif_columns.op9_gif_columns,
        "op10_token_counts": token_counts.op10_token_counts,
        "op11_linear_grouping": linear_grouping.op11_linear_grouping,
        "op12_fim_automaton": fim_automaton.op12_fim_automaton,
        "op13_phrase_automata": phrase_automata.op13_phrase_automata,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_aliases": url_aliases.ORACLE,
        "op2_line_runs": line_runs.ORACLE,
        "op6_collision_embeddings": collision_embeddings.ORACLE,
        "op12_fim_automaton": fim_automaton.ORACLE,
        "op13_phrase_automata": phrase_automata.ORACLE,
    }
