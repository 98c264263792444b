"""Column functions over sequences and text; all stay in generated code."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Residue alphabets.
PROTEIN = "ACDEFGHIKLMNPQRSTVWYX"
STANDARD = "ACDEFGHIKLMNPQRSTVWY"
HYDROPHOBIC = "AILMFWVY"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once for a row and hand it to ``body`` as a bound variable.

    Without this, Catalyst may copy a costly expression to each place that it's used in.
    """
    return F.transform(F.array(value), body)[0]


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, whatever its spelling of upper and lower case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def upper_residues(text: Column) -> Column:
    return F.upper(F.regexp_replace(text, r"(?U)\s+", ""))


def normal_protein(text: Column) -> Column:
    """Upper case without white space; what is no residue becomes X."""
    return F.regexp_replace(upper_residues(text), f"[^{PROTEIN}]", "X")


def normal_dna(text: Column) -> Column:
    return F.regexp_replace(F.translate(upper_residues(text), "U", "T"), "[^ACGTN]", "N")


def normal_rna(text: Column) -> Column:
    return F.regexp_replace(F.translate(upper_residues(text), "T", "U"), "[^ACGUN]", "N")


def reverse_complement(dna: Column) -> Column:
    return F.reverse(F.translate(dna, "ACGTN", "TGCAN"))


def join_segments(sequence: Column, segments: Column, strand: Column) -> Column:
    """Concatenates 1-based inclusive (start, end) segments, skips invalid ones, and turns the minus strand."""
    good = F.filter(segments, lambda s: (s["start"] >= 1) & (s["end"] >= s["start"]) & (s["end"] <= F.length(sequence)))
    joined = F.array_join(F.transform(good, lambda s: F.substring(sequence, s["start"], s["end"] - s["start"] + 1)), "")
    return F.when(strand == "-", reverse_complement(joined)).otherwise(joined)


def share_of(text: Column, letters: str) -> Column:
    """The share of characters in a set of letters; 0 for an empty text."""
    n = F.length(text)
    return F.when(n == 0, F.lit(0.0)).otherwise((n - F.length(F.translate(text, letters, ""))) / n)


def distinct_letters(text: Column, letters: str) -> Column:
    """How many of the letters occur."""
    return reduce(add, [text.contains(x).cast("int") for x in letters])


def longest_run(text: Column, letters: str) -> Column:
    """The length of the longest run of characters of a class."""
    runs = F.regexp_extract_all(text, F.lit(f"([{letters}]+)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(text)), r"[^\p{L}\p{N}]+", "-"), F.lit("-"))


def match_text(text: Column) -> Column:
    """Lower-case words between single spaces, with a space at either end, so that ``contains`` keeps word limits."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), F.lit(" "))


def canonical_accession(value: Column) -> Column:
    return F.regexp_replace(F.trim(value), r"\.\d+$", "")


def accession_version(value: Column) -> Column:
    return F.coalesce(F.regexp_extract(value, r".\.(\d+)$", 1).try_cast("int"), F.lit(-1))


def header_organism(header: Column) -> Column:
    return F.regexp_extract(header, r"\[([^\[\]]+)\]\s*$", 1)


def natural_key(name: Column) -> Column:
    """A sort key by which digit runs compare as numbers and text without regard to case.

    A run of digits comes without leading zeros, behind its length in five digits, so its size doesn't matter.
    """
    runs = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))

    def number(t: Column) -> Column:
        plain = F.regexp_replace(t, "^0+(?=.)", "")
        return F.concat(F.lpad(F.length(plain).cast("string"), 5, "0"), plain)

    return F.array_join(F.transform(runs, lambda t: F.when(t.rlike(r"^\d"), number(t)).otherwise(F.lower(t))), "")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def unit_hash(key: Column, seed: int) -> Column:
    """A stable number in [0, 1): the first 8 bytes of sha1 of ``seed:key``."""
    digest = F.sha1(F.concat(F.lit(f"{seed}:"), key))
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("double") / F.lit(2.0**64)


def warmup_cosine(step: Column, warmup: int, total: int, floor: float = 0.1) -> Column:
    """The learning-rate scale of a step: linear warm-up, then half a cosine down to ``floor``."""
    done = F.least(F.lit(1.0), (step - warmup) / F.lit(float(max(1, total - warmup))))
    falling = F.lit(floor) + F.lit(1 - floor) * F.lit(0.5) * (1 + F.cos(F.pi() * done))
    return F.when(step < warmup, (step + 1) / F.lit(float(max(1, warmup)))).otherwise(falling)


def safe_name(text: Column, most: int = 80) -> Column:
    """A text as a file's name: other characters than letters, digits, ``._-`` as ``_``, none of these three at the ends."""
    plain = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), "[^A-Za-z0-9._-]+", "_")
    inner = F.substring(F.regexp_replace(plain, "^[._-]+|[._-]+$", ""), 1, most)
    return F.when(inner == "", "candidate").otherwise(inner)


def truth(text: Column, default: bool) -> Column:
    """Whether a setting's text says yes: ``1``, ``true``, ``yes`` or ``on`` in any case; the default for null."""
    return F.coalesce(F.lower(F.trim(text)).isin("1", "true", "yes", "on"), F.lit(default))


def whole_number(text: Column) -> Column:
    """A text of digits as a number; null for any other."""
    plain = F.trim(text)
    return F.when(plain.rlike(r"^\d+$"), plain.try_cast("long"))
