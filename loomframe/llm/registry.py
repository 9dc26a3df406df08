"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from loomframe.llm.classifier import op6_ftrl_quality
from loomframe.llm.htmltext import op10_layout_text
from loomframe.llm.mixing import op8_raked_mixing
from loomframe.llm.packing import op9_cost_balanced_packing
from loomframe.llm.quotes import op2_quotation_linking
from loomframe.llm.repetition import OP1_SQL, op1_repetition_rules
from loomframe.llm.sharding import op3_sampled_splitters
from loomframe.llm.simhash import op7_simhash_byte_index
from loomframe.llm.sketch import op5_bottom_k_sketch
from loomframe.llm.tokenscan import op4_separator_scan

QUERIES = {
    f.__name__: f
    for f in (
        op1_repetition_rules,
        op2_quotation_linking,
        op3_sampled_splitters,
        op4_separator_scan,
        op5_bottom_k_sketch,
        op6_ftrl_quality,
        op7_simhash_byte_index,
        op8_raked_mixing,
        op9_cost_balanced_packing,
        op10_layout_text,
    )
}
ORACLES: dict[str, str] = {"op1_repetition_rules": OP1_SQL}
