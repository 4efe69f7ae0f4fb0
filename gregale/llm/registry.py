"""The queries of this subpackage, and their SQL."""

from __future__ import annotations

from gregale.llm import bpe, fertility, jaccard, linededup, mixing, negatives, quality, repair, sharding, suffix, tiff, urlfilter, warc

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_bpe": bpe.op2_bpe,
    "op3_quality": quality.op3_quality,
    "op4_jaccard": jaccard.op4_jaccard,
    "op5_mixing": mixing.op5_mixing,
    "op6_tiff": tiff.op6_tiff,
    "op7_warc": warc.op7_warc,
    "op8_linededup": linededup.op8_linededup,
    "op9_suffix": suffix.op9_suffix,
    "op10_fertility": fertility.op10_fertility,
    "op11_urlfilter": urlfilter.op11_urlfilter,
    "op12_negatives": negatives.op12_negatives,
    "op13_repair": repair.op13_repair,
}
SQL = {"op4_jaccard": jaccard.SQL4, "op7_warc": warc.SQL7, "op8_linededup": linededup.SQL8, "op11_urlfilter": urlfilter.SQL11, "op12_negatives": negatives.SQL12}
