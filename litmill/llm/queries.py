"""The registered queries of this package and their SQL."""

from __future__ import annotations

from litmill.llm import avi_media, bounded_pack, collocations, exact_dedup, jaccard_join, language_id, line_dedup, mixing, packing, pii_spans, pitman_yor, source_audit, url_filter

QUERIES = {
    f.__name__: f
    for f in (
        avi_media.op1_avi_media,
        pii_spans.op2_pii_spans,
        pitman_yor.op3_pitman_yor,
        url_filter.op4_url_filter,
        exact_dedup.op5_exact_dedup,
        line_dedup.op6_line_dedup,
        language_id.op7_language_id,
        mixing.op8_fair_mix,
        packing.op9_best_fit_pack,
        jaccard_join.op10_jaccard_join,
        collocations.op11_collocations,
        bounded_pack.op12_bounded_pack,
        source_audit.op13_source_audit,
    )
}

ORACLES = {"op5_exact_dedup": exact_dedup.SQL_OP5, "op6_line_dedup": line_dedup.SQL_OP6, "op8_fair_mix": mixing.SQL_OP8, "op11_collocations": collocations.SQL_OP11, "op13_source_audit": source_audit.SQL_OP13}
