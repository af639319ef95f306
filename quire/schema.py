"""Schemas of the tables a library reads and writes."""

from __future__ import annotations

HIGHLIGHT = "struct<id:string,start:int,end:int,color:string>"
#: A record of a library file.
LIBRARY = f"id string, title string, date string, time string, city string, version string, audio_url string, text string, highlights array<{HIGHLIGHT}>"
NOTE = "id string, title string, content string, color string, note_order int, creation_date string, note_date string"
CITATION = "id string, note_id string, sermon_id string, sermon_title_snapshot string, sermon_date_snapshot string, sermon_version_snapshot string, quoted_text string, date_added string, paragraph_index int"
CHAT = "chat_key string, seq int, role string, content string, timestamp string, sources array<struct<title:string,uri:string>>"
DEFINITION = "word string, definition string, synonyms array<string>, etymology string, seq long"
