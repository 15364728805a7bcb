"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from veinlode.llm import fim, langid, line_dedup, lm_scoring, merkle, mixing, mpeg_audio, ngram_join, pieces, quality, sharding, suffix_dedup, voronoi_join

_QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_lm_scoring": lm_scoring.op2_lm_scoring,
    "op3_voronoi_join": voronoi_join.op3_voronoi_join,
    "op4_mpeg_audio": mpeg_audio.op4_mpeg_audio,
    "op5_pieces": pieces.op5_pieces,
    "op6_mixing": mixing.op6_mixing,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_langid": langid.op8_langid,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_sharding": sharding.op10_sharding,
    "op11_merkle": merkle.op11_merkle,
    "op12_fim": fim.op12_fim,
    "op13_quality": quality.op13_quality,
}
_SQL = {"op3_voronoi_join": voronoi_join.ORACLE, "op6_mixing": mixing.ORACLE, "op11_merkle": merkle.ORACLE, "op12_fim": fim.ORACLE, "op13_quality": quality.ORACLE}


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict:
    return dict(_SQL)
