"""Queries of this subpackage and, where SQL can express one, its SQL."""

from . import decontaminate, exact_dedup, license_scan, line_dedup, ngram_join, packing, periodic, quality, segment, sharding, token_align, topk, url_filter

QUERIES = {
    "op1_segment": segment.op1_segment,
    "op2_top_k": topk.op2_top_k,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_license_scan": license_scan.op4_license_scan,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_quality_classifier": quality.op7_quality_classifier,
    "op8_packing": packing.op8_packing,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_sharding": sharding.op10_sharding,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_token_alignment": token_align.op12_token_alignment,
    "op13_decontaminate": decontaminate.op13_decontaminate,
}

ORACLE = {
    "op2_top_k": topk.SQL,
    "op5_exact_dedup": exact_dedup.SQL,
    "op9_line_dedup": line_dedup.SQL,
    "op11_periodic_runs": periodic.SQL,
    "op12_token_alignment": token_align.op12_token_alignment,
    "op13_decontaminate": decontaminate.SQL,
}
