"""The queries opN_<name>, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import htmltext, linededup, media, mixing, packing, resample, runs, simhash, sufdedup, tokencount, topk, toxicity, urlfilter

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_transport_stream": media.op2_transport_stream,
    "op3_topk": topk.op3_topk,
    "op4_url_filter": urlfilter.op4_url_filter,
    "op5_line_dedup": linededup.op5_line_dedup,
    "op6_mixing": mixing.op6_mixing,
    "op7_suffix_dedup": sufdedup.op7_suffix_dedup,
    "op8_simhash": simhash.op8_simhash,
    "op9_html_text": htmltext.op9_html_text,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_token_counts": tokencount.op11_token_counts,
    "op12_periodic_runs": runs.op12_periodic_runs,
    "op13_importance_resampling": resample.op13_importance_resampling,
}

ORACLE_SQL: dict[str, str] = {
    "op3_topk": topk.ORACLE,
    "op4_url_filter": urlfilter.ORACLE,
    "op5_line_dedup": linededup.ORACLE,
    "op6_mixing": mixing.ORACLE,
}
