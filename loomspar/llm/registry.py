"""The queries of this subpackage with their SQL."""

from __future__ import annotations

from loomspar.llm import canon, copies, identities, leaks, packing, pieces, sentences, sql, subjects

QUERIES = {
    "p1_found": canon.found,
    "p2_found": sentences.found,
    "p3_found": identities.found,
    "p3_links": identities.linked,
    "p4_found": pieces.found,
    "p4_pieces": pieces.pieces,
    "p4_cover": pieces.cover,
    "p5_found": copies.found,
    "p5_counts": copies.counted,
    "p6_sequences": packing.sequences,
    "p6_long_sequences": packing.long_sequences,
    "p7_found": leaks.found,
    "p7_leaks": leaks.leaks,
    "p8_found": subjects.found,
    "p8_quality": subjects.quality,
}

ORACLE_SQL = {name: text for name, text in sql.TEXTS.items() if name in QUERIES}
