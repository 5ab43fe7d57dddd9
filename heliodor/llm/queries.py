"""The queries of this subpackage, and SQL for those that SQL can express on whole tables."""

from heliodor.llm import languages, mixing, near_duplicates, neighbours, packing, residue, source_files, speaker_turns, splitting

QUERIES = {
    "p1_found": speaker_turns.p1_found,
    "p1_turns": speaker_turns.p1_turns,
    "p2_found": near_duplicates.p2_found,
    "p2_classes": near_duplicates.p2_classes,
    "p3_found": neighbours.p3_found,
    "p3_neighbours": neighbours.p3_neighbours,
    "p4_found": source_files.p4_found,
    "p4_reasons": source_files.p4_reasons,
    "p5_found": splitting.p5_found,
    "p5_pieces": splitting.p5_pieces,
    "p6_found": residue.p6_found,
    "p8_containers": packing.p8_containers,
    "p8_report": packing.p8_report,
    "p9_mixture": mixing.p9_mixture,
    "p9_report": mixing.p9_report,
    "p9_budget_report": mixing.p9_budget_report,
    "p9_entropy_report": mixing.p9_entropy_report,
    "p10_found": languages.p10_found,
    "p10_segments": languages.p10_segments,
}

SQL = {"p2_found": near_duplicates.P2_FOUND_SQL, "p2_classes": near_duplicates.P2_CLASSES_SQL, "p3_found": neighbours.P3_FOUND_SQL, "p3_neighbours": neighbours.P3_NEIGHBOURS_SQL, "p5_found": splitting.P5_FOUND_SQL}
