"""Record types of the tables that operators exchange."""

from __future__ import annotations




CHUNK_DDL = "chunk_id string, file_id string, pos int, text string"
ENTITY_DDL = "file_id string, name string, type string, description string, source_id array<string>"
RELATION_DDL = "file_id string, rel_key string, source string, target string, keywords array<string>, description string, source_id array<string>"
VECTOR_DDL = "id string, vec array<float>"
TRACE_DDL = "qid string, mode string, kind string, rank int, id string"
SPAN_DDL = (
    "evidence_id string, sentence_start int, sentence_end int, char_start int, char_end int, "
    "supports_answer_points array<int>, text_sha256 string, text_preview string"
)
QUESTION_DDL = (
    "id string, difficulty string, question_type string, question string, gold_entities array<string>, "
    "gold_relations array<string>, gold_answer_points array<string>, expected_keyword_groups array<array<string>>, "
    f"gold_evidence_spans array<struct<{SPAN_DDL}>>"
)
GOLD_DDL = (
    "schema_version string, dataset string, "
    "source struct<path string, sha256 string, character_count int, sentence_count int>, "
    "segmentation map<string,string>, annotation struct<chunk_independent boolean>, entity_aliases map<string,string>, "
    f"questions array<struct<{QUESTION_DDL}>>"
)
