"""Queries of the training-data problems, by name."""

from __future__ import annotations

from twinloom.llm import duplicates, language, leakage, lookalikes, mixture, overlap, reading

QUERIES = {
    "p1_found": language.found,
    "p1_profile": language.profile,
    "p1_segments": language.all_segments,
    "p2_found": overlap.found,
    "p2_report": overlap.report,
    "p3_found": duplicates.found,
    "p3_distinct_records": duplicates.distinct_records,
    "p4_found": lookalikes.found,
    "p4_groups": lookalikes.groups,
    "p4_members": lookalikes.members,
    "p5_found": leakage.found,
    "p5_items": leakage.leaked_items,
    "p6_mixture": mixture.chosen,
    "p6_shares": mixture.report,
    "p7_found": reading.found,
    "p7_levels": reading.all_levels,
    "p7_profile": reading.profile,
}
