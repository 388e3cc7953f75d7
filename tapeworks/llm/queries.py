"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from . import chat, decontam, html_text, line_dedup, packing, pii, quality, runs, simhash, topk, url_filter, variants, warc

QUERIES = {
    f.__name__: f
    for f in (
        line_dedup.op1_line_dedup,
        packing.op2_packing,
        simhash.op3_simhash,
        warc.op4_warc,
        chat.op5_chat,
        pii.op6_pii,
        decontam.op7_decontamination,
        html_text.op8_html_text,
        url_filter.op9_url_filter,
        quality.op10_quality,
        variants.op11_spelling_variants,
        topk.op12_exact_top_k,
        runs.op13_periodic_runs,
    )
}
ORACLES = line_dedup.SQL | warc.SQL | chat.SQL | topk.SQL | variants.SQL
