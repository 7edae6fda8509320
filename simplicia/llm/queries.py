"""Registry of the subpackage: one query for each operator, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from simplicia.llm import bpe, centroids, decontaminate, gam, html, jaccard, licenses, lines, maxent, negatives, quality, substrings, urls


def queries() -> dict:
    return {
        "op1_quality": quality.op1_quality,
        "op2_licenses": licenses.op2_licenses,
        "op3_bpe": bpe.op3_bpe,
        "op4_gam": gam.op4_gam,
        "op5_decontaminate": decontaminate.op5_decontaminate,
        "op6_jaccard": jaccard.op6_jaccard,
        "op7_lines": lines.op7_lines,
        "op8_urls": urls.op8_urls,
        "op9_maxent": maxent.op9_maxent,
        "op10_html": html.op10_html,
        "op11_negatives": negatives.op11_negatives,
        "op12_centroids": centroids.op12_centroids,
        "op13_substrings": substrings.op13_substrings,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_decontaminate": decontaminate.OP5_SQL, "op7_lines": lines.OP7_SQL, "op11_negatives": negatives.OP11_SQL, "op12_centroids": centroids.OP12_SQL, "op13_substrings": substrings.OP13_SQL}
