"""The queries of this subpackage and their DuckDB equivalents, for ``__spark_entry__``."""

from __future__ import annotations

from millrace.llm import decontamination, hard_negatives, importance_resampling, lattice_dedup, license_scan, minhash_dedup, secret_scan
from millrace.llm.language_id import op8_language_id
from millrace.llm.lattice_dedup import op1_lattice_dedup
from millrace.llm.license_scan import op6_license_scan
from millrace.llm.maxent_lm import op7_maxent_lm
from millrace.llm.minhash_dedup import op4_minhash_dedup
from millrace.llm.quality_classifier import op12_quality_classifier
from millrace.llm.ring_sharding import op10_ring_sharding
from millrace.llm.secret_scan import op3_secret_scan
from millrace.llm.sentencepiece_codec import op2_sentencepiece
from millrace.llm.suffix_dedup import op5_suffix_dedup

QUERIES = {
    "op1_lattice_dedup": op1_lattice_dedup,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_secret_scan": op3_secret_scan,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_license_scan": op6_license_scan,
    "op7_maxent_lm": op7_maxent_lm,
    "op8_language_id": op8_language_id,
    "op9_decontamination": decontamination.op9_decontamination,
    "op10_ring_sharding": op10_ring_sharding,
    "op11_importance_resampling": importance_resampling.op11_importance_resampling,
    "op12_quality_classifier": op12_quality_classifier,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
    "secret_base_counts": secret_scan.secret_base_counts,
    "license_base_places": license_scan.license_base_places,
}

ORACLES: dict[str, str] = {
    "op1_lattice_dedup": lattice_dedup.ORACLE,
    "op4_minhash_dedup": minhash_dedup.ORACLE,
    "op9_decontamination": decontamination.ORACLE,
    "op11_importance_resampling": importance_resampling.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
    "secret_base_counts": secret_scan.BASE_ORACLE,
    "license_base_places": license_scan.BASE_ORACLE,
}
