"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexigrove.llm.bpe import op5_bpe
from lexigrove.llm.centroids import OP11_SQL, op11_centroids
from lexigrove.llm.chat_template import op1_chat_format
from lexigrove.llm.decontamination import OP12_SQL, op12_decontamination
from lexigrove.llm.fingerprint import op2_fingerprint
from lexigrove.llm.html_extract import op7_html_extract
from lexigrove.llm.line_templates import op4_line_templates
from lexigrove.llm.mixing import OP8_SQL, op8_mixing
from lexigrove.llm.ngram_join import op9_ngram_join
from lexigrove.llm.periodic_runs import op13_periodic_runs
from lexigrove.llm.plain_sql import OP1_SQL, OP2_SQL, OP6_SQL, OP9_SQL, OP13_SQL
from lexigrove.llm.prefix_free import op6_prefix_free_dedup
from lexigrove.llm.quality_crf import op3_quality_crf
from lexigrove.llm.rules import OP10_SQL, op10_rules


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_format": op1_chat_format,
        "op2_fingerprint": op2_fingerprint,
        "op3_quality_crf": op3_quality_crf,
        "op4_line_templates": op4_line_templates,
        "op5_bpe": op5_bpe,
        "op6_prefix_free_dedup": op6_prefix_free_dedup,
        "op7_html_extract": op7_html_extract,
        "op8_mixing": op8_mixing,
        "op9_ngram_join": op9_ngram_join,
        "op10_rules": op10_rules,
        "op11_centroids": op11_centroids,
        "op12_decontamination": op12_decontamination,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_format": OP1_SQL,
        "op2_fingerprint": OP2_SQL,
        "op6_prefix_free_dedup": OP6_SQL,
        "op8_mixing": OP8_SQL,
        "op9_ngram_join": OP9_SQL,
        "op10_rules": OP10_SQL,
        "op11_centroids": OP11_SQL,
        "op12_decontamination": OP12_SQL,
        "op13_periodic_runs": OP13_SQL,
    }
