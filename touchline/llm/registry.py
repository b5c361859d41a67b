"""Queries of this package, and SQL that gives the same rows where SQL can express them."""

from . import harmonic, licences, media, near_dup, packing, pieces, pii, quality, repeats, runs, turns, vectors, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_repeats": repeats.op2_repeats,
    "op3_packing": packing.op3_packing,
    "op4_pii": pii.op4_pii,
    "op5_vectors": vectors.op5_vectors,
    "op6_licences": licences.op6_licences,
    "op7_quality": quality.op7_quality,
    "op8_near_dup": near_dup.op8_near_dup,
    "op9_pieces": pieces.op9_pieces,
    "op10_media": media.op10_media,
    "op11_periodic_runs": runs.op11_periodic_runs,
    "op12_harmonic": harmonic.op12_harmonic,
    "op13_turns": turns.op13_turns,
}

ORACLE_SQL = {
    "op1_warc": warc.OP1_SQL,
    "op6_licences": licences.OP6_SQL,
}
