"""Every registered query of the session-memory operators, with its SQL twin where SQL can say it."""

from __future__ import annotations

from . import audits, briefs, decisions, gates, memory, notes, sessions, subjects, texts, transcripts

_PARTS = (memory, sessions, texts, briefs, subjects, audits, decisions, gates, notes, transcripts)

QUERIES: dict = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
SQL: dict = {name: text for part in _PARTS for name, text in part.SQL.items()}
