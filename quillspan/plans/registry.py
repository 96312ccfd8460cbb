"""All queries of the library but the corpus operators'."""

from __future__ import annotations

from quillspan.plans import clips, contracts, media, moments, render, replies, review, stored, transcripts

_ALL = {**transcripts.QUERIES, **moments.QUERIES, **replies.QUERIES, **clips.QUERIES, **review.QUERIES, **contracts.QUERIES, **media.QUERIES, **stored.QUERIES, **render.QUERIES}
QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLES = {name: sql for name, (_, sql) in _ALL.items() if sql}
