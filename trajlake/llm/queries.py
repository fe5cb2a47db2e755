"""Queries over the driver's tables for the operators of this package, and their SQL."""

from __future__ import annotations

from trajlake.llm.collocations import OP11_SQL, op11_pair_naming
from trajlake.llm.decontaminate import op2_decontaminate_edit
from trajlake.llm.language_id import op9_language_id_compression
from trajlake.llm.mixing import op6_mixing_soft_membership
from trajlake.llm.quality_fm import op3_quality_factorisation_machine
from trajlake.llm.quality_rules import op5_quality_divergence
from trajlake.llm.quality_rules import oracle_sql as op5_sql
from trajlake.llm.simhash import op10_simhash_covering_lsh
from trajlake.llm.substring_dedup import OP13_SQL, op13_prefix_suffix_trees
from trajlake.llm.suffix_dedup import OP7_SQL, op7_suffix_run_length
from trajlake.llm.token_counts import op8_token_counts
from trajlake.llm.toxicity import op4_toxicity_counterfactual
from trajlake.llm.warc import OP1_SQL, op1_warc_round_trip
from trajlake.llm.whitening import op12_svd_whitening

QUERIES = {
    "op1_warc_round_trip": op1_warc_round_trip,
    "op2_decontaminate_edit": op2_decontaminate_edit,
    "op3_quality_factorisation_machine": op3_quality_factorisation_machine,
    "op4_toxicity_counterfactual": op4_toxicity_counterfactual,
    "op5_quality_divergence": op5_quality_divergence,
    "op6_mixing_soft_membership": op6_mixing_soft_membership,
    "op7_suffix_run_length": op7_suffix_run_length,
    "op8_token_counts": op8_token_counts,
    "op9_language_id_compression": op9_language_id_compression,
    "op10_simhash_covering_lsh": op10_simhash_covering_lsh,
    "op11_pair_naming": op11_pair_naming,
    "op12_svd_whitening": op12_svd_whitening,
    "op13_prefix_suffix_trees": op13_prefix_suffix_trees,
}

ORACLES: dict[str, str] = {
    "op1_warc_round_trip": OP1_SQL,
    "op5_quality_divergence": op5_sql(),
    "op7_suffix_run_length": OP7_SQL,
    "op11_pair_naming": OP11_SQL,
    "op13_prefix_suffix_trees": OP13_SQL,
}
