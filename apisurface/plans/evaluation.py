"""Evaluation of inferred signatures: references, verdicts and rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apisurface import schemas as S
from apisurface.functions.types import evaluate_once
from apisurface.functions.verdicts import build_messages, parse_verdict
from apisurface.operators.filters import check_domain, split_double_failures
from apisurface.operators.joins import choose_reference, match_references
from apisurface.operators.ordering import sample_k
from apisurface.operators.projections import (
    FAILED_CODE,
    FAILED_REASONS,
    explode_signatures,
    override_failed,
    with_evidence,
)
from apisurface.operators.sets import combine_rows

# Fixed value: reason recorded when both inferences failed without a reason of their own.
DOUBLE_FAILURE = "参数和返回值推断阶段均失败。"


def signature_entries(functions: DataFrame, sample: int | None = None, seed: int = 0) -> DataFrame:
    """One row per inferred signature with the function's evidence; optionally a seeded sample."""
    with_facts = with_evidence(functions, ["provider", "source_location", "source_text"], out="function_evidence")
    exploded = explode_signatures(with_facts.drop("source_location", "source_text"))
    entries = exploded.select(
        *[c for c in exploded.columns if c not in ("signature", "signature_index")],
        "signature_index",
        F.col("signature.signature").alias("inferred_signature"),
        F.col("signature.raw_signature").alias("raw_signature"),
    )
    if sample is None:
        return entries
    keyed = entries.withColumn(
        "_entry", F.concat("function_id", F.lit("#"), F.lpad(F.col("signature_index").cast("string"), 9, "0"))
    )
    return sample_k(keyed, sample, seed, "_entry").drop("_entry")


def immediate_rows(failed: DataFrame) -> DataFrame:
    """Evaluation rows of signatures whose inferences both failed."""
    codes = {}
    for d in S.DIMENSIONS:
        codes[f"{d}_code"] = F.lit(FAILED_CODE)
        codes[f"{d}_reason"] = F.lit(FAILED_REASONS[d])
    return _evaluation_columns(
        failed.withColumns(
            {
                **codes,
                "status": F.lit("ok"),
                "status_reason": F.coalesce("failure_reason", F.lit(DOUBLE_FAILURE)),
                "reasoning_content": F.lit(""),
                "reference_kind": F.lit("inference_status"),
                "reference": F.coalesce("function_evidence", F.lit("")),
            }
        )
    )


def _evaluation_columns(df: DataFrame) -> DataFrame:
    return df.withColumn("class_name", F.coalesce("class_name", F.lit(""))).select(*S.column_names(S.EVALUATIONS))


def prepare(entries: DataFrame, references: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(pending entries with reference kind and text, immediate evaluation rows).

    A pending entry without any reference makes the query fail and is named.
    """
    failed, pending = split_double_failures(entries)
    pending = with_evidence(pending, ["function_evidence", "raw_signature"], out="signature_evidence")
    if references is None:
        manual = F.lit(None).cast("string")
    else:
        pending = match_references(
            pending.withColumn("class_path", F.coalesce("class_name", F.lit(""))), references, out="manual"
        )
        listed = F.transform("manual", lambda m: F.struct(m["text"].alias("signature"), m["line"].alias("line")))
        manual = F.to_json(listed)
    chosen = choose_reference(pending, [("manual_stub", manual), ("signature_evidence", F.col("signature_evidence"))])
    message = F.concat(
        F.lit("no reference for "), F.col("function_id"), F.lit(" signature "), F.col("signature_index").cast("string")
    )
    present = F.when(F.col("reference").isNotNull(), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return chosen.where(present), immediate_rows(failed)


def messages(pending: DataFrame) -> DataFrame:
    """Judge messages per pending entry."""
    fields = {
        "function": F.col("function_id"),
        "module": F.col("module_name"),
        "class": F.coalesce("class_name", F.lit("<module>")),
        "name": F.col("function_name"),
        "signature index": F.col("signature_index"),
        "inferred signature": F.col("inferred_signature"),
        "reference": F.col("reference"),
    }
    return pending.select("function_id", "signature_index", build_messages(fields, "reference_kind").alias("messages"))


def judged_rows(pending: DataFrame, answers: DataFrame, answer: str = "answer", reasoning: str = "reasoning_content") -> DataFrame:
    """Evaluation rows from judge answers keyed by (function_id, signature_index).

    An answer that does not parse, or none at all, gives an error row; failed inference steps override
    their dimensions either way.
    """
    # (function_id, signature_index) is the key of both sides.
    keyed = pending.join(answers, ["function_id", "signature_index"], "left")
    parsed = evaluate_once(keyed, "_v", parse_verdict(answer))
    bad = F.col("_v.error").isNotNull()
    columns = {}
    for d in S.DIMENSIONS:
        columns[f"{d}_code"] = F.when(bad, F.lit("unqualified")).otherwise(F.col(f"_v.{d}_code"))
        columns[f"{d}_reason"] = F.when(bad, F.lit("no usable verdict")).otherwise(F.col(f"_v.{d}_reason"))
    rows = parsed.withColumns(
        {
            **columns,
            "status": F.when(bad, F.lit("llm_error")).otherwise(F.lit("ok")),
            "status_reason": F.coalesce("_v.error", F.lit("")),
            "reasoning_content": F.when(bad, F.lit("")).otherwise(F.coalesce(F.col(reasoning), F.lit(""))),
        }
    )
    return _evaluation_columns(override_failed(rows))


def evaluation_rows(pending: DataFrame, immediate: DataFrame, answers: DataFrame) -> DataFrame:
    return combine_rows(immediate, judged_rows(pending, answers))


def checked_codes(evaluations: DataFrame) -> DataFrame:
    """Rows of legal status and codes, error rows among them; any other makes the query fail."""
    rules = {"status": S.ROW_STATUSES, **{f"{d}_code": S.CODES for d in S.DIMENSIONS}}
    return check_domain(evaluations, rules, ["function_id", "signature_index"])


def checked_evaluations(evaluations: DataFrame) -> DataFrame:
    """Rows fit for a summary; an error row or an illegal code makes the query fail."""
    rules = {"status": ["ok"], **{f"{d}_code": S.CODES for d in S.DIMENSIONS}}
    return check_domain(evaluations, rules, ["function_id", "signature_index"])
