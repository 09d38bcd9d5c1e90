"""Queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

from strataplan.llm.bpe import op1_bpe
from strataplan.llm.exact_dedup import OP7_SQL, op7_exact_dedup
from strataplan.llm.language import op2_language
from strataplan.llm.lines import OP9_SQL, op9_lines
from strataplan.llm.near_dedup import op8_near_dedup
from strataplan.llm.neighbours import op10_neighbours
from strataplan.llm.packing import op3_packing
from strataplan.llm.passages import op5_passages
from strataplan.llm.secrets import op6_secrets
from strataplan.llm.sharding import op4_sharding

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_language": op2_language,
    "op6_secrets": op6_secrets,
    "op3_packing": op3_packing,
    "op5_passages": op5_passages,
    "op4_sharding": op4_sharding,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_near_dedup": op8_near_dedup,
    "op9_lines": op9_lines,
    "op10_neighbours": op10_neighbours,
}

ORACLE_SQL = {"op7_exact_dedup": OP7_SQL, "op9_lines": OP9_SQL}
