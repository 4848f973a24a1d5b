"""The corpus operators' queries, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from histlake.llm.chat import OP13_SQL, op13_chat
from histlake.llm.divergence import OP12_SQL, op12_divergence
from histlake.llm.infill import OP11_SQL, op11_infill
from histlake.llm.line_dedup import OP9_SQL, op9_line_dedup
from histlake.llm.mixing import OP2_SQL, op2_mixing
from histlake.llm.near_dups import op3_near_dups
from histlake.llm.neighbours import op6_neighbours
from histlake.llm.packing import op10_packing
from histlake.llm.quality import op1_quality
from histlake.llm.rules import op5_quality_rules
from histlake.llm.sharding import op7_sharding
from histlake.llm.token_files import op8_token_files
from histlake.llm.toxicity import op4_toxicity

QUERIES = {
    "op1_quality": op1_quality,
    "op2_mixing": op2_mixing,
    "op3_near_dups": op3_near_dups,
    "op4_toxicity": op4_toxicity,
    "op5_quality_rules": op5_quality_rules,
    "op6_neighbours": op6_neighbours,
    "op7_sharding": op7_sharding,
    "op8_token_files": op8_token_files,
    "op9_line_dedup": op9_line_dedup,
    "op10_packing": op10_packing,
    "op11_infill": op11_infill,
    "op12_divergence": op12_divergence,
    "op13_chat": op13_chat,
}

ORACLES = {
    "op2_mixing": OP2_SQL,
    "op9_line_dedup": OP9_SQL,
    "op11_infill": OP11_SQL,
    "op12_divergence": OP12_SQL,
    "op13_chat": OP13_SQL,
}
