"""The queries of this subpackage, their SQL, and nothing else."""

from __future__ import annotations

from kelvora.llm import fill_middle, html_text, importance, mixing, near_dup, packing, pii, quality_rules, suffix_dedup, token_files, topk, url_filter, warc


def queries() -> dict:
    return {
        "op1_suffix_dedup": suffix_dedup.query,
        "op2_url_filter": url_filter.query,
        "op3_mixing": mixing.query,
        "op4_pii": pii.query,
        "op5_packing": packing.query,
        "op6_token_files": token_files.query,
        "op7_topk": topk.query,
        "op8_quality_rules": quality_rules.query,
        "op9_near_dup": near_dup.query,
        "op10_warc": warc.query,
        "op11_html_text": html_text.query,
        "op12_fill_middle": fill_middle.query,
        "op13_importance": importance.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_mixing": mixing.ORACLE,
        "op7_topk": topk.ORACLE,
        "op8_quality_rules": quality_rules.ORACLE,
        "op10_warc": warc.ORACLE,
        "op12_fill_middle": fill_middle.ORACLE,
        "op13_importance": importance.ORACLE,
    }
