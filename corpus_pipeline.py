"""A corpus pipeline of five stages, each one of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next one's input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexigrove.llm.bpe import stage_bpe
from lexigrove.llm.common import materialize, read_table
from lexigrove.llm.line_templates import stage_lines
from lexigrove.llm.mixing import stage_mixing
from lexigrove.llm.ngram_join import stage_near_duplicates
from lexigrove.llm.quality_crf import stage_quality

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", stage_quality),
    ("line dedup", stage_lines),
    ("n-gram Jaccard join", stage_near_duplicates),
    ("mixing sources to target weights", stage_mixing),
    ("BPE encoding and decoding", stage_bpe),
]

#: The classifier and the template tree have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
