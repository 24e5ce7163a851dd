"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from . import bitplanes, decontaminate, lexical, lines, merkle, naming, near, ngram_join, packing, quality, substrings, token_counts, warc
from .sql import ORACLES

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_lines": lines.op2_lines,
    "op3_token_planes": bitplanes.op3_token_planes,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_quality": quality.op5_quality,
    "op6_substrings": substrings.op6_substrings,
    "op7_packing": packing.op7_packing,
    "op8_near": near.op8_near,
    "op9_exact": naming.op9_exact,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_merkle": merkle.op11_merkle,
    "op12_lexical": lexical.op12_lexical,
    "op13_ngram_join": ngram_join.op13_ngram_join,
}
__all__ = ["ORACLES", "QUERIES"]
