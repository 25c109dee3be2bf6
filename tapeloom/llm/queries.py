"""The corpus operators' queries, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from tapeloom.llm import classifier, collocations, decontaminate, hard_negatives, jaccard_join, language_model, license_scan, line_dedup, packing, quality_rules, substring_dedup, token_files, url_filter

QUERIES = {
    "op1_license_scan": license_scan.query,
    "op2_quality_rules": quality_rules.query,
    "op3_classifier": classifier.query,
    "op4_jaccard_join": jaccard_join.query,
    "op5_substring_dedup": substring_dedup.query,
    "op6_token_files": token_files.query,
    "op7_url_filter": url_filter.query,
    "op8_language_model": language_model.query,
    "op9_packing": packing.query,
    "op10_decontaminate": decontaminate.query,
    "op11_hard_negatives": hard_negatives.query,
    "op12_phrase_collocations": collocations.query,
    "op13_line_dedup": line_dedup.query,
}
ORACLE_SQL = {"op4_jaccard_join": jaccard_join.SQL, "op7_url_filter": url_filter.SQL, "op11_hard_negatives": hard_negatives.SQL, "op12_phrase_collocations": collocations.SQL, "op13_line_dedup": line_dedup.SQL}
