"""Queries of the training-data operators, by name."""

from __future__ import annotations

from windowmill.llm import decontaminate, filter_audit, html_text, license_scan, near_vectors, ngram_join, packing, piece_counts, quality, substring_dedup, token_files, warc, whitening


def queries() -> dict:
    return {
        "op1_ngram_join": ngram_join.query,
        "op2_html_text": html_text.query,
        "op3_quality": quality.query,
        "op4_near_vectors": near_vectors.query,
        "op5_decontamination": decontaminate.query,
        "op6_warc": warc.query,
        "op7_license_scan": license_scan.query,
        "op8_token_files": token_files.query,
        "op9_piece_counts": piece_counts.query,
        "op10_best_fit_packing": packing.query,
        "op11_filter_audit": filter_audit.query,
        "op12_substring_dedup": substring_dedup.query,
        "op13_whitening": whitening.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_decontamination": decontaminate.SQL, "op6_warc": warc.SQL, "op11_filter_audit": filter_audit.SQL, "op12_substring_dedup": substring_dedup.SQL}
