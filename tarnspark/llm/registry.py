"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import byte_bpe, chat, collocations, context_tree, fill_middle, jaccard_join, licenses, line_cleaning, minhash, multi_index, packing, sstable, toxicity
from .sql import ORACLES

QUERIES = {
    "op1_prefix_targets": chat.op1_prefix_targets,
    "op2_sstable": sstable.op2_sstable,
    "op3_minmax_dedup": minhash.op3_minmax_dedup,
    "op4_pattern_packing": packing.op4_pattern_packing,
    "op5_context_tree": context_tree.op5_context_tree,
    "op6_multi_index": multi_index.op6_multi_index,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_pu_toxicity": toxicity.op8_pu_toxicity,
    "op9_byte_bpe": byte_bpe.op9_byte_bpe,
    "op10_line_cleaning": line_cleaning.op10_line_cleaning,
    "op11_collocations": collocations.op11_collocations,
    "op12_jaccard_join": jaccard_join.op12_jaccard_join,
    "op13_fill_middle": fill_middle.op13_fill_middle,
}

__all__ = ["ORACLES", "QUERIES"]
