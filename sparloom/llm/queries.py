"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from sparloom.llm.decontamination import op4_decontamination
from sparloom.llm.html_text import op9_html_extraction
from sparloom.llm.license_scan import OP6_SQL, op6_license_scan
from sparloom.llm.lm_scoring import op1_lm_scoring
from sparloom.llm.mixing import OP10_SQL, op10_mixing
from sparloom.llm.ngram_join import OP13_SQL, op13_ngram_join
from sparloom.llm.pii import op2_pii
from sparloom.llm.prefix_trie import OP11_SQL, op11_prefix_trie
from sparloom.llm.quality_rules import OP5_SQL, op5_quality_rules
from sparloom.llm.simhash import op8_simhash
from sparloom.llm.spelling import OP12_SQL, op12_spelling_variants
from sparloom.llm.substring_dedup import op3_substring_dedup
from sparloom.llm.url_filters import OP7_SQL, op7_url_filters

QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_pii": op2_pii,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_quality_rules": op5_quality_rules,
    "op6_license_scan": op6_license_scan,
    "op7_url_filters": op7_url_filters,
    "op8_simhash": op8_simhash,
    "op9_html_extraction": op9_html_extraction,
    "op10_mixing": op10_mixing,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_ngram_join": op13_ngram_join,
}
SQL = {
    "op5_quality_rules": OP5_SQL,
    "op6_license_scan": OP6_SQL,
    "op7_url_filters": OP7_SQL,
    "op10_mixing": OP10_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op12_spelling_variants": OP12_SQL,
    "op13_ngram_join": OP13_SQL,
}
