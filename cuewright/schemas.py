"""Schemas of transcripts and of the state tables; nothing is inferred."""

CUE = "source_id string, cue_index int, start double, end double, text string"
UTTERANCES = "array<struct<start:double,end:double,text:string>>"
PARAGRAPHS = "array<struct<start:double,end:double,text:string,wordCount:int>>"
STATS = "struct<format:string,rawCueCount:int,cleanedUtteranceCount:int,dedupedCount:int,mergedCueCount:int,droppedNoiseCount:int,start:double,end:double,rejectedCueCount:int>"
NORMALIZED = (
    "schema_version int, kind string, source struct<input_path:string,file_name:string,stem:string,source_id:string,source_label:string,subtitle_format:string>, "
    f"cleaning_summary string, cleaned_utterances {UTTERANCES}, paragraph_records {PARAGRAPHS}, paragraphs array<string>, stats {STATS}"
)
NORMALIZED_KIND = "normalized_subtitle_transcript"
SCHEMA_VERSION = 1

# Columns of the state tables.
TABLES = {
    "schema_meta": "key string, value string",
    "sources": "id string, language string, material_type string, track string, title string, source_url string, creator string, raw_path string, cleaned_path string, imported_at string, status string",
    "segments": "id string, source_id string, material_type string, track string, segment_index int, segment_path string, start_ref string, end_ref string, context_before_summary string, context_after_summary string, scene_or_argument_summary string, created_at string, status string",
    "sessions": "id string, language string, track string, session_type string, source_id string, segment_id string, lesson_path string, answers_path string, feedback_path string, started_at string, finished_at string, status string",
    "review_items": "id string, language string, track string, review_category string, item_type string, content string, normalized_key string, source_id string, segment_id string, first_seen_at string, last_seen_at string, last_reviewed_at string, due_at string, interval_days double, stability double, priority_score double, status string",
    "profile_events": "id string, language string, session_id string, event_type string, signal string, evidence string, strength double, created_at string",
    "user_actions": "id string, target_type string, target_id string, action_type string, reason string, created_at string",
}
# Which table a column's ids are of.
REFERENCES = {
    "segments": {"source_id": "sources"},
    "sessions": {"source_id": "sources", "segment_id": "segments"},
    "review_items": {"source_id": "sources", "segment_id": "segments"},
    "profile_events": {"session_id": "sessions"},
}
# Columns that have to be filled where the state is strict.
FILLED = {
    "schema_meta": ["value"],
    "sources": ["language", "material_type", "track", "title", "raw_path", "imported_at", "status"],
    "segments": ["source_id", "material_type", "track", "segment_index", "segment_path", "created_at", "status"],
    "sessions": ["language", "session_type", "started_at", "status"],
    "review_items": ["language", "review_category", "item_type", "content", "normalized_key", "first_seen_at", "last_seen_at", "status"],
    "profile_events": ["language", "event_type", "signal", "created_at"],
    "user_actions": ["target_type", "target_id", "action_type", "created_at"],
}
BUCKET_BY = {"segments": "source_id"}  # the others by their key
KEYS = {name: "key" if name == "schema_meta" else "id" for name in TABLES}
TRACKS = ["live_chat", "article_reading"]
ITEM_STATUSES = CATEGORY_STATUSES = ["active", "paused", "ignored", "deleted", "mastered"]


def columns_of(table: str) -> list[str]:
    return [field.split()[0] for field in TABLES[table].split(", ")]
