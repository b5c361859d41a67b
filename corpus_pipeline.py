"""The corpus pipeline: quality, near copies, repeated passages, personal data, packing."""

from __future__ import annotations

from touchline.llm import near_dup, packing, pii, quality, repeats
from touchline.llm.common import table
from touchline.operators.lineage import written

STAGES = [
    ("quality", quality.stage),
    ("near_dup", near_dup.stage),
    ("repeats", repeats.stage),
    ("pii", pii.stage),
    ("packing", packing.stage),
]
ORACLE_SQL = None


def run(spark, sf_dir):
    """Every stage on all that the one before kept; each but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
