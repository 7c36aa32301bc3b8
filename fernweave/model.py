"""Schemas of the stored tables."""

from __future__ import annotations

#: One statement. o_kind: iri or literal; o_dt: a datatype or null (a plain literal); both are part of a term's identity.
QUAD = "g string, s string, p string, o string, o_kind string, o_dt string, o_lang string"
TERM = ["s", "p", "o", "o_kind", "o_dt", "o_lang"]
CARD = "iri string, type string, title string, snippet string, card_text string"
VECTOR = "iri string, embedding array<float>"
SECTION = "struct<heading: string, level: int, text: string>"
PAGE = f"url string, title string, content_hash string, sections array<{SECTION}>"
VIOLATION = "focus string, path string, component string, message string"
GUARD = "part string, prev long, new long, ratio double, status string"
COMMENT = "struct<body: string, user: struct<name: string>, createdAt: string>"
ISSUE = f"""id string, identifier string, title string, description string, branchName string, team string, sourceSystem string,
 state struct<name: string, type: string>, labels struct<nodes: array<struct<name: string>>>, project struct<name: string>,
 parent struct<identifier: string>, relations struct<nodes: array<struct<type: string, relatedIssue: struct<identifier: string>>>>, comments string"""
PULL = "number long, title string, body string, state string, merged_at string, merge_commit_sha string, base struct<ref: string>, user struct<login: string>"
REVIEW = "id long, body string, user struct<login: string>, path string, line long, original_line long, commit_id string, original_commit_id string, created_at string, submitted_at string, state string"
