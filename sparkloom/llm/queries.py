"""The queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, chat, decontam, fim, lines, lm, manifest, mixing, quality, revisits, sharding, simhash, urls

QUERIES = {
    "op1_shard_lookup": sharding.op1_shard_lookup,
    "op2_chat_perspectives": chat.op2_chat_perspectives,
    "op3_simhash_components": simhash.op3_simhash_components,
    "op4_gru_scores": lm.op4_gru_scores,
    "op5_site_line_dedup": lines.op5_site_line_dedup,
    "op6_warc_revisits": revisits.op6_warc_revisits,
    "op7_benchmark_edit_matches": decontam.op7_benchmark_edit_matches,
    "op8_byte_bpe": bpe.op8_byte_bpe,
    "op9_url_filter": urls.op9_url_filter,
    "op10_line_quality": quality.op10_line_quality,
    "op11_merkle_manifest": manifest.op11_merkle_manifest,
    "op12_source_mix": mixing.op12_source_mix,
    "op13_fill_in_middle": fim.op13_fill_in_middle,
}

SQL = {
    "op2_chat_perspectives": chat.SQL,
    "op5_site_line_dedup": lines.SQL,
    "op6_warc_revisits": revisits.SQL,
    "op9_url_filter": urls.SQL,
    "op10_line_quality": quality.SQL,
    "op11_merkle_manifest": manifest.SQL,
    "op12_source_mix": mixing.SQL,
    "op13_fill_in_middle": fim.SQL,
}
