"""Schemas of the tables that pass between operators."""

from __future__ import annotations

SOURCE_REF = "struct<path:string,start_line:int,end_line:int,snippet:string,metadata:map<string,string>>"

FILES = "relative_path string, size long, content string"

NODES = (
    "path string, pre int, last int, parent_pre int, depth int, type string, named boolean, error boolean, missing boolean, "
    "start_byte int, end_byte int, start_line int, start_column int, end_line int, end_column int, text string"
)
ISSUES = "array<struct<code:string,message:string,start_line:int,end_line:int,fatal:boolean>>"
PARSES = f"path string, language string, status string, has_tree boolean, has_errors boolean, parser_backend string, issues {ISSUES}"

#: Place of a fact in the order of emission: stage-local phase, node, position.
ORDER = "struct<file:string,phase:int,pre:int,pos:int>"

SCOPES = f"id string, kind string, name string, display_name string, parent_scope_id string, source_refs array<{SOURCE_REF}>, metadata string"
ENTITIES = f"id string, kind string, origin string, name string, display_name string, scope_id string, source_refs array<{SOURCE_REF}>, metadata string"
RELATIONSHIPS = f"id string, kind string, from_entity_id string, to_entity_id string, label string, source_refs array<{SOURCE_REF}>, metadata string"
DIAGNOSTICS = (
    "id string, severity string, phase string, code string, message string, fatal boolean, file_path string, "
    f"scope_id string, entity_id string, source_refs array<{SOURCE_REF}>, metadata string"
)
SNAPSHOT = "relative_path string, size_bytes long, content_hash string, detected_language string, file_type string"

# The kinds that a valid document may hold.
ENTITY_KINDS = ["MODULE", "CLASS", "INTERFACE", "FUNCTION", "SERVICE", "ENDPOINT", "DATASTORE", "EXTERNAL_SYSTEM", "PERSISTENCE_ADAPTER", "UI_MODULE", "STARTUP_POINT", "CONFIG_ARTIFACT"]
RELATIONSHIP_KINDS = ["CONTAINS", "DEPENDS_ON", "CALLS", "READS", "WRITES", "USES", "EXPOSES"]
SCOPE_KINDS = ["REPOSITORY", "DIRECTORY", "FILE", "MODULE", "PACKAGE", "COMPONENT"]
LANGUAGES = ["java", "typescript", "sql", "json", "yaml", "properties", "xml"]
