"""Queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .ann import op8_nearest
from .decontamination import OP9_SQL, op9_decontamination
from .language import op3_language_id, op3_language_id_pages
from .lm import op6_lm_scores
from .mixing import OP1_SQL, op1_mixing
from .passages import op7_passages
from .pii import op4_personal_data
from .secrets import op10_secrets
from .sharding import op5_sharding
from .simhash import op2_simhash

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_simhash": op2_simhash,
    "op3_language_id": op3_language_id,
    "op3_language_id_pages": op3_language_id_pages,
    "op4_personal_data": op4_personal_data,
    "op5_sharding": op5_sharding,
    "op6_lm_scores": op6_lm_scores,
    "op7_passages": op7_passages,
    "op8_nearest": op8_nearest,
    "op9_decontamination": op9_decontamination,
    "op10_secrets": op10_secrets,
}

ORACLES = {"op1_mixing": OP1_SQL, "op9_decontamination": OP9_SQL}
