"""Schemas of the tables the package reads and writes."""

from __future__ import annotations

ARGUMENT = "struct<name:string,type:string,default_value:string,kind:string>"

SIGNATURE = "struct<signature_index:int,signature:string,raw_signature:string>"

FUNCTIONS = (
    "function_id string, module_name string, class_name string, function_name string, "
    "decorator string, provider string, mapping_status string, "
    "parameter_inference_status string, return_inference_status string, "
    "failure_reason string, source_location string, source_text string, "
    f"signatures array<{SIGNATURE}>"
)

MEASUREMENTS = (
    "function_id string, elapsed_ns bigint, elapsed_ms double, provider string, "
    "mapping_status string, parameter_inference_status string, "
    "return_inference_status string, signature_count int, failure_reason string"
)

EVALUATIONS = (
    "function_id string, module_name string, class_name string, function_name string, "
    "signature_index int, inferred_signature string, "
    "parameter_structure_code string, parameter_structure_reason string, "
    "parameter_type_code string, parameter_type_reason string, "
    "return_type_code string, return_type_reason string, "
    "status string, status_reason string, reasoning_content string, "
    "reference_kind string, reference string"
)

REFERENCE_SIGNATURES = (
    "module_name string, class_path string, function_name string, "
    "ordinal int, text string, line int"
)

COMPILE_COMMANDS = "file string, directory string, arguments array<string>"

NODES = "node_id string, parent_id string, kind string, name string, doc string, bases array<string>"

RULES = "category string, name string, type string, imports array<string>, priority int"

POSITIONAL_ONLY = "POSITIONAL_ONLY"
POSITIONAL_OR_KEYWORD = "POSITIONAL_OR_KEYWORD"
VAR_POSITIONAL = "VAR_POSITIONAL"
KEYWORD_ONLY = "KEYWORD_ONLY"
VAR_KEYWORD = "VAR_KEYWORD"

# Domains of the status and code columns.
STATUSES = ["unknown", "success", "failed"]
CODES = ["rule_unqualified", "unqualified", "qualified"]
VERDICT_CODES = ["qualified", "unqualified"]
ROW_STATUSES = ["ok", "llm_error"]
DIMENSIONS = ["parameter_structure", "parameter_type", "return_type"]


def column_names(ddl: str) -> list[str]:
    """Top-level column names of a DDL string."""
    from pyspark.sql import types as T

    return T.StructType.fromDDL(ddl).names
