"""The thin queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bottomk, chat_format, compaction, golay_simhash, line_rules, mil_quality, packing, piece_lattice, toxic_segments, url_reputation

QUERIES = {
    "op1_mil_quality": mil_quality.op1,
    "op2_toxic_segments": toxic_segments.op2,
    "op3_compaction": compaction.op3,
    "op4_line_rules": line_rules.op4,
    "op5_chat_format": chat_format.op5,
    "op6_best_fit_packing": packing.op6,
    "op7_golay_simhash": golay_simhash.op7,
    "op8_url_reputation": url_reputation.op8,
    "op9_bottomk": bottomk.op9,
    "op10_piece_lattice": piece_lattice.op10,
}

ORACLE = {
    "op3_compaction": compaction.ORACLE,
    "op4_line_rules": line_rules.ORACLE,
    "op5_chat_format": chat_format.oracle(),
    "op8_url_reputation": url_reputation.oracle(),
}
