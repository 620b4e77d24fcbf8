"""The engine's tables. Novels have ranked sources; chapters are known by (novel_id, number)."""

from __future__ import annotations

NOVELS = "id bigint NOT NULL, title string NOT NULL, author string, cover_url string, genre string, status_hint string NOT NULL, derived_state string NOT NULL, export_pending boolean NOT NULL, created_at timestamp NOT NULL, updated_at timestamp NOT NULL"
SOURCES = "id bigint NOT NULL, novel_id bigint NOT NULL, source_name string NOT NULL, url string NOT NULL, priority bigint NOT NULL, last_seen_chapter bigint, last_synced_at timestamp"
CHAPTERS = "novel_id bigint NOT NULL, number bigint NOT NULL, title string NOT NULL, body string NOT NULL, source_id bigint, fetched_at timestamp NOT NULL, exported boolean NOT NULL, exported_at timestamp"
GAPS = "novel_id bigint NOT NULL, number bigint NOT NULL, detected_at timestamp NOT NULL"
META = "key string NOT NULL, value string NOT NULL"
#: Observations: what a crawler saw. mode is full or latest; outcome ok, not_found or error.
DISCOVERED = "novel_id bigint, source_id bigint, mode string, pos bigint, number bigint, title string, url string"
DISCOVERY_ERRORS = "novel_id bigint, source_id bigint, mode string, message string"
FETCHED = "novel_id bigint, source_id bigint, number bigint, outcome string, title string, paragraphs array<string>, message string"

TABLES = {"novels": NOVELS, "sources": SOURCES, "chapters": CHAPTERS, "chapter_gaps": GAPS, "meta": META}

#: 0: snapshots under a pointer, without later columns; 1: the columns above; 2: marks in meta, so that ids of deleted rows are not given again.
SCHEMA = 2
