"""Queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import additive_quantiser, bpe, kd_shards, license_scan, partenum, pfair_mix, ppm, quality_rules, url_lists, warc

QUERIES = {
    "op1_kd_shards": kd_shards.op1_kd_shards,
    "op2_partenum_join": partenum.op2_partenum_join,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_line_frequency": quality_rules.op4_line_frequency,
    "op5_temporal_lists": url_lists.op5_temporal_lists,
    "op6_additive_quantiser": additive_quantiser.op6_additive_quantiser,
    "op7_ppm_language": ppm.op7_ppm_language,
    "op8_bpe_words": bpe.op8_bpe_words,
    "op9_pfair_mix": pfair_mix.op9_pfair_mix,
    "op10_warc_zstd": warc.op10_warc_zstd,
}
ORACLES = {
    "op2_partenum_join": partenum.ORACLE,
    "op3_license_scan": license_scan.ORACLE,
    "op4_line_frequency": quality_rules.ORACLE,
    "op5_temporal_lists": url_lists.ORACLE,
    "op10_warc_zstd": warc.ORACLE,
}
