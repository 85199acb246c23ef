"""Queries of the operators over the input tables, and their SQL where SQL can express them."""

from __future__ import annotations

from fieldlab.llm import byte_bpe, canonical, divergence, language, licenses, manifest, media, mixing, near_dups, plane_store, quality, stream_dedup, token_counts

QUERIES = {
    "op1_plane_store": plane_store.op1_plane_store,
    "op2_licenses": licenses.op2_licenses,
    "op3_media": media.op3_media,
    "op4_mixing": mixing.op4_mixing,
    "op5_canonical": canonical.op5_canonical,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_byte_bpe": byte_bpe.op7_byte_bpe,
    "op8_language": language.op8_language,
    "op9_quality": quality.op9_quality,
    "op10_near_dups": near_dups.op10_near_dups,
    "op11_stream_dedup": stream_dedup.op11_stream_dedup,
    "op12_manifest": manifest.op12_manifest,
    "op13_divergence": divergence.op13_divergence,
}

ORACLE_SQL: dict[str, str] = {
    "op4_mixing": mixing.OP4_SQL,
    "op11_stream_dedup": stream_dedup.OP11_SQL,
    "op12_manifest": manifest.OP12_SQL,
    "op13_divergence": divergence.OP13_SQL,
}
