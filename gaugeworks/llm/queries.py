"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .alignment import op12_alignment
from .decontamination import OP3_SQL, op3_decontamination
from .html_extraction import op4_html_extraction
from .language_id import op2_language_id
from .lexical_search import OP11_SQL, op11_lexical_search
from .license_scan import OP7_SQL, op7_license_scan
from .mixing import OP1_SQL, op1_mix_sources
from .near_dedup import OP9_SQL, op9_near_dedup
from .quality_classifier import op5_quality_classifier
from .quality_rules import op10_quality_rules
from .simhash import op13_simhash
from .substring_dedup import OP6_SQL, op6_substring_dedup
from .toxicity import op8_toxicity

QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_language_id": op2_language_id,
    "op3_decontamination": op3_decontamination,
    "op4_html_extraction": op4_html_extraction,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_license_scan": op7_license_scan,
    "op8_toxicity": op8_toxicity,
    "op9_near_dedup": op9_near_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_lexical_search": op11_lexical_search,
    "op12_alignment": op12_alignment,
    "op13_simhash": op13_simhash,
}
ORACLE_SQL = {
    "op1_mix_sources": OP1_SQL,
    "op3_decontamination": OP3_SQL,
    "op6_substring_dedup": OP6_SQL,
    "op7_license_scan": OP7_SQL,
    "op9_near_dedup": OP9_SQL,
    "op11_lexical_search": OP11_SQL,
}
