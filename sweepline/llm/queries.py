"""The registered queries of this subpackage and, where SQL can say it, their SQL."""

from __future__ import annotations

import corpus_pipeline

from .centroids import OP11_SQL, op11_centroids
from .decontaminate import op7_decontamination
from .hard_negatives import OP13_SQL, op13_hard_negatives
from .language import op8_language
from .licenses import op1_licenses
from .lm_scoring import op10_lm_scoring
from .main_text import op12_main_text
from .mixing import OP9_SQL, op9_mixing
from .simhash import op4_simhash
from .token_counts import op2_token_counts
from .token_files import op5_token_output
from .toxicity import op6_toxicity
from .weighted_fingerprints import op3_fingerprints

QUERIES = {
    "op1_licenses": op1_licenses,
    "op2_token_counts": op2_token_counts,
    "op3_fingerprints": op3_fingerprints,
    "op4_simhash": op4_simhash,
    "op5_token_output": op5_token_output,
    "op6_toxicity": op6_toxicity,
    "op7_decontamination": op7_decontamination,
    "op8_language": op8_language,
    "op9_mixing": op9_mixing,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_centroids": op11_centroids,
    "op12_main_text": op12_main_text,
    "op13_hard_negatives": op13_hard_negatives,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {"op9_mixing": OP9_SQL, "op11_centroids": OP11_SQL, "op13_hard_negatives": OP13_SQL}
