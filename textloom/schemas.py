"""Explicit schemas of the records that the operators exchange."""

from __future__ import annotations

METADATA = (
    "title string, author string, description string, content string, excerpt string, bvid string, video_id string, note_id string, content_id string, content_type string, "
    "publish_time string, created_time string, updated_time string, cover_url string, video_url string, images_text string, duration bigint, pubdate bigint, view_count bigint, "
    "like_count bigint, collect_count bigint, comment_count bigint, share_count bigint, voteup_count bigint, images array<string>, tags array<string>, topics array<string>"
)
CONTENT = f"platform string, url string, status string, message string, metadata struct<{METADATA.replace(' string', ':string').replace(' bigint', ':bigint').replace(' array<string>', ':array<string>')}>, content string"
EDGES = "doc_id bigint, kind string, ord int, source string, target string, relationship string, strength double"
CACHE = "url_hash string, url string, cached_at timestamp, file_size bigint, payload string"
