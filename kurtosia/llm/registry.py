"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import decontamination, html_text, jaccard_join, nn_descent, packing, periodic_runs, quality, secret_scan, source_divergence, substring_dedup, toxicity, url_filter, warc


def queries() -> dict:
    return {
        "op1_nn_descent": nn_descent.op1,
        "op2_url_filter": url_filter.op2,
        "op3_packing": packing.op3,
        "op4_substring_dedup": substring_dedup.op4,
        "op5_decontamination": decontamination.op5,
        "op6_warc_derivatives": warc.op6,
        "op7_jaccard_join": jaccard_join.op7,
        "op8_toxicity": toxicity.op8,
        "op9_html_text": html_text.op9,
        "op10_secret_scan": secret_scan.op10,
        "op11_periodic_runs": periodic_runs.op11,
        "op12_source_divergence": source_divergence.op12,
        "op13_line_quality": quality.op13,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_filter": url_filter.ORACLE_SQL,
        "op4_substring_dedup": substring_dedup.ORACLE_SQL,
        "op7_jaccard_join": jaccard_join.ORACLE_SQL,
        "op10_secret_scan": secret_scan.ORACLE_SQL,
        "op11_periodic_runs": periodic_runs.ORACLE_SQL,
        "op12_source_divergence": source_divergence.ORACLE_SQL,
    }
