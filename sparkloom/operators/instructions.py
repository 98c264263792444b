"""Instruction records: typed rows from JSON Lines, prompts, the audit of files, tagged training lines, span rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import STANDARD, let
from .annotations import RESERVED

# The frame of a prompt.
PREAMBLE = "Below is an instruction that describes a task. Write a response that appropriately completes the request."
FORMATS = {
    "alpaca": "alpaca", "llms_from_scratch_ch07": "alpaca", "instruction": "alpaca", "compact": "compact_profile",
    "compact_profile": "compact_profile", "profile": "compact_profile",
}
PROFILE, SEPARATOR, PROTEIN, END = RESERVED


def clean(text: Column) -> Column:
    """No reserved token, single spaces; null is empty."""
    text = F.coalesce(text, F.lit(""))
    for token in RESERVED:
        text = F.replace(text, F.lit(token), F.lit(" "))
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def compact(text: Column) -> Column:
    """Upper case without white space; null is empty."""
    return F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", ""))


def prompt(instruction: Column, given: Column, form: str = "alpaca") -> Column:
    """The prompt of cleaned texts in one of the ``FORMATS``."""
    if form not in FORMATS:
        raise ValueError(f"form must be one of {sorted(FORMATS)}")
    if FORMATS[form] == "compact_profile":
        return clean(F.when(given == "", instruction).otherwise(F.concat(instruction, F.lit("; input "), given)))
    asked = F.when(given == "", "").otherwise(F.concat(F.lit(" ### Input: "), given))
    return clean(F.concat(F.lit(f"{PREAMBLE} ### Instruction: "), instruction, asked, F.lit(" ### Response: ")))


def _text(payload: Column, name: str) -> Column:
    """A field of a variant as text; null if it's missing or null."""
    return F.try_variant_get(payload, f'$["{name}"]', "string")


def records(rows: DataFrame, form: str = "alpaca", sequence_type: str = "protein", names: tuple[str, str, str] = ("instruction", "input", "output")) -> DataFrame:
    """``rows`` of ``read_json_lines`` with status, profile, sequence and sequence_type.

    ``names`` are the fields of instruction, input and output. Status: empty, invalid, not_object,
    missing_instruction, missing_output, missing_both or valid; profile and sequence are null unless valid.
    """
    p = F.col("payload")
    instruction, given, output = clean(_text(p, names[0])), clean(_text(p, names[1])), compact(_text(p, names[2]))
    parts = rows.withColumns({"_i": instruction, "_g": given, "_o": output})
    lacks = F.when(F.col("_i") == "", F.when(F.col("_o") == "", "missing_both").otherwise("missing_instruction")).when(F.col("_o") == "", "missing_output")
    status = F.when(F.col("status") == "valid", F.coalesce(lacks, F.lit("valid"))).otherwise(F.col("status"))
    own = F.nullif(_text(p, "sequence_type"), F.lit(""))
    nested = F.nullif(F.try_variant_get(p, "$.metadata.sequence_type", "string"), F.lit(""))
    kind = F.lower(F.trim(F.coalesce(own, nested, F.lit(sequence_type))))
    judged = parts.withColumn("status", status)
    good = F.col("status") == "valid"
    return judged.select(
        *rows.columns, F.when(good, prompt(F.col("_i"), F.col("_g"), form)).alias("profile"), F.when(good, F.col("_o")).alias("sequence"),
        F.when(good, kind).alias("sequence_type"),
        F.when(good, F.coalesce(F.nullif(F.trim(_text(p, "output_format")), F.lit("")), F.lit("unspecified"))).alias("output_format"),
    )


def required(found: DataFrame) -> DataFrame:
    """The valid rows; any other row but an empty one fails the job with its status, its beginning and, if known, its place."""
    at = [F.lit(" at "), F.col("place")] if "place" in found.columns else []
    fault = F.concat(F.lit("instruction row is "), F.col("status"), *at, F.lit(": "), F.substring("value", 1, 80))
    ok = F.when(F.col("status") != "valid", F.raise_error(fault).cast("boolean")).otherwise(True)
    return found.where("status <> 'empty'").where(ok)


def audit(found: DataFrame) -> DataFrame:
    """(kind, value, n) over ``records``: counts of rows by status, sequence type and output format, and of keys.

    Keys count for every object, whether or not its row is valid.
    """
    pair = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    keys = F.coalesce(F.json_object_keys(F.when(F.col("payload").isNotNull() & ~F.col("status").isin("empty", "invalid", "not_object"), F.to_json("payload"))), F.array().cast("array<string>"))
    seen = F.when(F.col("status") != "empty", F.array(pair("rows", F.lit("seen")))).otherwise(F.array().cast("array<struct<kind:string,value:string>>"))
    each = F.concat(
        seen, F.array(pair("status", F.col("status"))), F.transform(keys, lambda k: pair("key", k)),
        F.filter(F.array(pair("sequence_type", F.col("sequence_type")), pair("output_format", F.col("output_format"))), lambda x: x["value"].isNotNull()),
    )
    return found.select(F.explode(each).alias("e")).groupBy("e.kind", "e.value").agg(F.count("*").alias("n"))


def previews(found: DataFrame, k: int, order: str) -> DataFrame:
    """The first ``k`` valid rows in ``order``: beginnings of the profile and the sequence, and the sequence's length."""
    first = found.where("status = 'valid'").orderBy(order).limit(k)
    return first.select(
        order, F.substring("profile", 1, 360).alias("profile"), F.substring("sequence", 1, 80).alias("output_prefix"),
        F.length("sequence").alias("output_length"), "sequence_type",
    )


def split_key(payload: Column, fallback: Column) -> Column:
    """What decides a record's split: its accession or id, else its texts as sorted JSON, else ``fallback``."""
    named = F.trim(F.coalesce(F.nullif(_text(payload, "accession"), F.lit("")), F.nullif(_text(payload, "id"), F.lit("")), F.lit("")))
    fields = ("description", "input", "instruction", "organism", "output")
    pieces = [
        F.when(F.coalesce(_text(payload, f), F.lit("")) != "", F.concat(F.lit(f'"{f}": '), F.to_json(F.array(_text(payload, f)))))
        for f in fields
    ]
    # A one-element JSON array without its brackets is the string's JSON form.
    plain = [F.regexp_replace(x, r'^("[a-z]+": )\[(.*)\]$', "$1$2") for x in pieces]
    texts = F.array_compact(F.array(*plain))
    body = F.concat(F.lit("{"), F.array_join(texts, ", "), F.lit("}"))
    return F.when(named != "", F.concat(F.lit("accession:"), named)).when(F.size(texts) > 0, body).otherwise(fallback)


def stratum(payload: Column) -> tuple[Column, Column]:
    """(group, bucket) of a record for stratified samples, in lower case and single spaces.

    The group is the record's dataset group, the bucket the first of its products, description and accession that isn't
    blank.
    """
    plain = lambda path: F.nullif(F.lower(F.trim(F.regexp_replace(F.coalesce(F.try_variant_get(payload, path, "string"), F.lit("")), r"(?U)\s+", " "))), F.lit(""))
    bucket = F.coalesce(*[plain(p) for p in ("$.metadata.product", "$.product", "$.description", "$.accession")], F.lit("unknown-protein"))
    return F.coalesce(plain("$.metadata.dataset_group"), F.lit("unknown")), bucket


def train_line(profile: Column, sequence: Column) -> Column:
    """The tagged line of a profile and its sequence."""
    return F.concat(F.lit(PROFILE), profile, F.lit(SEPARATOR + PROTEIN), sequence, F.lit(END))


def field_faults(text: Column) -> Column:
    """Whether a field can't stand in a tagged line: empty, or with a reserved token."""
    fault = F.coalesce(F.trim(text), F.lit("")) == ""
    for token in RESERVED:
        fault = fault | F.contains(text, F.lit(token))
    return fault


def parsed_line(line: Column) -> Column:
    """(profile, sequence) of a tagged line; null for any other line."""
    pattern = rf"^\Q{PROFILE}\E(.*?)\Q{SEPARATOR}{PROTEIN}\E(.*)\Q{END}\E$"
    return let(F.regexp_replace(line, r"[\r\n]+$", ""), lambda plain: F.when(
        plain.rlike(pattern),
        F.struct(F.regexp_extract(plain, pattern, 1).alias("profile"), F.regexp_extract(plain, pattern, 2).alias("sequence")),
    ))


def between_tags(text: Column) -> Column:
    """The sequence in a text: from behind the last protein tag to the next end tag, without reserved tokens."""
    tail = F.when(F.contains(text, F.lit(PROTEIN)), F.substring_index(text, PROTEIN, -1)).otherwise(text)
    inner = F.substring_index(tail, END, 1)
    for token in RESERVED:
        inner = F.replace(inner, F.lit(token))
    return F.regexp_replace(inner, r"\s+", "")


def instruction_of(fields: dict[str, Column]) -> Column:
    """``name value; name value`` of the fields that aren't blank, in order."""
    parts = [F.when(F.trim(v) != "", F.concat(F.lit(f"{k} "), F.trim(v))) for k, v in fields.items()]
    return F.array_join(F.array_compact(F.array(*parts)), "; ")


def prefixed(text: Column, prefix: str) -> Column:
    """``prefix; text``, or the text alone if it begins with the prefix in any case; white space is single."""
    plain = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.lower(plain).startswith(prefix.strip().lower()), plain).otherwise(F.concat(F.lit(f"{prefix.strip()}; "), plain))


def input_field(text: Column, name: str) -> Column:
    """The value of ``name value`` in a text of parts between ``; ``; null if there's none."""
    part = F.try_element_at(F.filter(F.split(text, "; "), lambda x: x.startswith(f"{name} ")), F.lit(1))
    return F.trim(F.substr(part, F.lit(len(name) + 2)))


def span_row(sequence: Column, start: Column, length: Column, policy: Column, instruction: Column, flank: int = 64) -> Column:
    """(instruction, input, output, leaks) of a span that is masked out of a sequence; places from 0."""
    output = F.substr(sequence, start + 1, length)
    left = F.substr(sequence, F.greatest(start - flank, F.lit(0)) + 1, F.least(start, F.lit(flank)))
    right = F.substr(sequence, start + length + 1, F.lit(flank))
    mark = F.concat(F.lit("<MASK_"), length.cast("string"), F.lit(">"))
    given = F.concat(
        F.lit("mask_policy "), policy, F.lit("; mask_start "), start.cast("string"), F.lit("; mask_length "), length.cast("string"),
        F.lit("; left_flank "), left, F.lit("; right_flank "), right, F.lit("; partial_sequence "), left, mark, right,
    )
    asked = prefixed(instruction, "task protein span completion")
    leaks = F.contains(F.concat(asked, F.lit("; input "), given), output)
    return F.struct(asked.alias("instruction"), given.alias("input"), output.alias("output"), leaks.alias("leaks"))


def span_row_faults(
    instruction: Column, given: Column, output: Column, start: Column, end: Column, length: Column, original: Column | None = None
) -> Column:
    """Names of the invariants that a span row breaks, against its ``original`` sequence too if that's given and not null."""
    marks = F.regexp_extract_all(given, F.lit(r"<MASK_(\d+)>"), F.lit(1))
    left, right, partial = (F.coalesce(input_field(given, k), F.lit("")) for k in ("left_flank", "right_flank", "partial_sequence"))

    def of_original(whole: Column) -> dict[str, Column]:
        given_too = lambda fault: original.isNotNull() & fault
        return {
            "outside_original": given_too(~((start >= 0) & (start < end) & (end <= F.length(whole)))),
            "original_output": given_too(F.substr(whole, start + 1, end - start) != output),
            "original_left": given_too(~F.endswith(F.substr(whole, F.lit(1), start), left)),
            "original_right": given_too(~F.startswith(F.substr(whole, end + 1), right)),
        }

    def of(found: Column) -> Column:
        checks = {
            "instruction": F.trim(instruction) == "", "input": F.trim(given) == "", "output": F.trim(output) == "",
            "alphabet": output.rlike(f"[^{STANDARD}]"), "mask_span": end - start != length, "output_length": F.length(output) != length,
            "one_mask": F.size(found) != 1, "mask_length": F.coalesce(F.try_element_at(found, F.lit(1)) != length.cast("string"), F.lit(True)),
            "partial": partial != F.concat(left, F.lit("<MASK_"), length.cast("string"), F.lit(">"), right),
            "leak": F.contains(F.concat(instruction, F.lit("; input "), given), output),
        }
        if original is not None:
            checks |= of_original(compact(original))
        return F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit(True)), F.lit(k)) for k, v in checks.items()]))

    return let(marks, of)
