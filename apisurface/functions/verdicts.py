"""Judge messages and answers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from apisurface import schemas as S
from apisurface.functions.text import col_of, strip
from apisurface.functions.types import let


def parse_verdict(text: Column | str, codes: Sequence[str] = S.VERDICT_CODES, dimensions: Sequence[str] = S.DIMENSIONS) -> Column:
    """Struct of trimmed code and reason per dimension, plus ``error``.

    The answer must be a JSON object whose fields are strings, codes from the set, reasons not blank.
    """
    fields = [f"{d}_{part}" for d in dimensions for part in ("code", "reason")]

    def read(value: Column) -> Column:
        def field(name: str) -> Column:
            is_text = F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant")) == "STRING"
            return F.when(is_text, strip(F.try_variant_get(value, f"$.{name}", "string")))

        is_object = F.coalesce(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), F.lit(False))
        return F.struct(*[field(name).alias(name) for name in fields], is_object.alias("is_object"))

    def judged(v: Column) -> Column:
        problems = [F.when(~v["is_object"], F.lit("not a JSON object"))]
        problems += [F.when(v[n].isNull(), F.lit(f"{n} is not text")) for n in fields]
        problems += [F.when(~v[n].isin(*codes), F.lit(f"illegal {n}")) for n in fields if n.endswith("_code")]
        problems += [F.when(v[n] == "", F.lit(f"{n} is empty")) for n in fields if n.endswith("_reason")]
        return F.struct(*[v[n].alias(n) for n in fields], F.coalesce(*problems).alias("error"))

    return let(let(F.try_parse_json(col_of(text)), read), judged)


DEFAULT_SYSTEM = (
    "You judge one inferred Python signature of an extension function against reference material. "
    "Answer with one JSON object holding a code (qualified or unqualified) and a reason for "
    "parameter_structure, parameter_type and return_type."
)
DEFAULT_INSTRUCTIONS = {
    "manual_stub": "The reference lists hand-written signatures; they take precedence over other knowledge.",
    "signature_evidence": "The reference is the source the signature was inferred from; fill gaps from the known API.",
}


def build_messages(
    fields: Mapping[str, Column | str],
    reference_kind: Column | str,
    system: str = DEFAULT_SYSTEM,
    instructions: Mapping[str, str] = DEFAULT_INSTRUCTIONS,
    fallback: str = "signature_evidence",
) -> Column:
    """Array of struct(role, content): the system text, then one line per field and the instruction."""
    kind = col_of(reference_kind)
    instruction = F.lit(instructions[fallback])
    for name, text in instructions.items():
        instruction = F.when(kind == name, F.lit(text)).otherwise(instruction)
    lines = [F.concat(F.lit(f"{label}: "), F.coalesce(col_of(v).cast("string"), F.lit(""))) for label, v in fields.items()]
    user = F.concat_ws("\n", *lines, F.concat(F.lit("reference kind: "), kind), F.concat(F.lit("instruction: "), instruction))
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")),
    )
