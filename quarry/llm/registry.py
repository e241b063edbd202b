"""Queries of the corpus operators and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm.bpe import op9_bpe
from quarry.llm.chat import OP3_SQL, op3_rotation
from quarry.llm.decontaminate import OP2_SQL, op2_wu_manber
from quarry.llm.embeddings import OP6_SQL, op6_pivots
from quarry.llm.lines import OP4_SQL, op4_lines
from quarry.llm.pii import op1_pii
from quarry.llm.quality import op7_pu
from quarry.llm.sharding import op5_ring
from quarry.llm.simhash import op8_simhash
from quarry.llm.warc import OP10_SQL, op10_merkle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_wu_manber": op2_wu_manber,
    "op3_rotation": op3_rotation,
    "op4_lines": op4_lines,
    "op5_ring": op5_ring,
    "op6_pivots": op6_pivots,
    "op7_pu": op7_pu,
    "op8_simhash": op8_simhash,
    "op9_bpe": op9_bpe,
    "op10_merkle": op10_merkle,
}

#: Equivalent DuckDB SQL, where SQL can express the operator.
ORACLES: dict[str, str] = {
    "op2_wu_manber": OP2_SQL,
    "op3_rotation": OP3_SQL,
    "op4_lines": OP4_SQL,
    "op6_pivots": OP6_SQL,
    "op10_merkle": OP10_SQL,
}
