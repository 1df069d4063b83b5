"""Schemas of the symbol store, the event store and the documents (data model)."""

from __future__ import annotations

NODES = (
    "id string, kind string, name string, qualified_name string, file_path string, language string,"
    " start_line int, end_line int, parent string, signature string, docstring string, sym_hash string,"
    " is_closure boolean, updated_at timestamp"
)
EDGES = "source string, target string, kind string, line int, col int, metadata string, provenance string"
FILES = "path string, content_hash string, language string, size long, modified_at timestamp, indexed_at timestamp, node_count int, errors array<string>, norm_hash string"
IMPORTS = "file_path string, line int, source string, kind string, type_only boolean"
EMBEDDING_CACHE = "cache_key string, dim int, vector array<float>, created_at timestamp"
SYMBOL_DIFFS = "file_path string, from_hash string, to_hash string, added array<string>, removed array<string>, changed array<string>, norm_from string, norm_to string, updated_at timestamp"
UNRESOLVED_REFS = "from_node_id string, reference_name string, reference_kind string, line int, col int, candidates string, file_path string, language string, status string, name_tail string"
EVENTS = "probe string, time timestamp, source string, fields string, trace_id string, frame_id long, parent_id long"
LEDGER = "id string, created_at string, declared_files array<string>, expected_files array<string>, status string, consumed_at string, matched_seq long, unexpected_files array<string>, actual_files array<string>"
MANIFEST = (
    "name string, schema_version string, description string, language string, verified boolean, seed_files array<string>,"
    " closure struct<internal:array<string>,external:array<struct<source:string,class:string>>>,"
    " aggregate struct<exposes:array<struct<name:string,kind:string,fields:array<struct<name:string,type:string,required:boolean>>,origin:string>>,"
    "consumes:array<struct<name:string>>,emits:array<string>>"
)
#: An edge is identified by these; nulls in line and col count as equal.
EDGE_KEY = ["source", "target", "kind", "line", "col"]
#: States of an unresolved reference.
REF_STATES = ("pending", "resolved", "external", "failed")
