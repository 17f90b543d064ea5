"""How strong a captured value looks. Expressions over one value; nothing here keeps it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from exposure.functions import fixed
from exposure.functions.names import _col, is_placeholder, let, unquoted

CLASS_RUNS = f"[{fixed.UPPER}]+|[{fixed.LOWER}]+|[{fixed.DIGIT}]+|[^{fixed.UPPER}{fixed.LOWER}{fixed.DIGIT}]+"
REPEATED = r"(?s)(.)\1++"
WORDS = r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+"


def entropy(value: Column | str) -> Column:
    """Shannon entropy in bits, rounded to 12 digits so that exact thresholds compare exactly.

    Characters are sorted, so that equal ones make a run; characters that stand alone add nothing.
    """
    return let(_col(value), _entropy)


def _entropy(v: Column) -> Column:
    n = F.length(v)
    ordered = F.array_join(F.sort_array(F.split(v, "")), "")
    runs = F.transform(F.regexp_extract_all(ordered, F.lit(REPEATED), F.lit(0)), F.length)
    repeated = F.aggregate(runs, F.lit(0.0), lambda bits, k: bits + k * F.log2(k))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.round(F.log2(n) - repeated / n, 12))


def transition_rate(value: Column | str) -> Column:
    """Share of neighbouring characters whose class differs: runs of one class, less one."""
    v = _col(value)
    n = F.length(v)
    return F.when(n < 2, F.lit(0.0)).otherwise(
        F.round((F.regexp_count(v, F.lit(CLASS_RUNS)) - 1) / (n - 1), 12)
    )


def has_upper(value: Column | str) -> Column:
    return _col(value).rlike(f"[{fixed.UPPER}]")


def has_lower(value: Column | str) -> Column:
    return _col(value).rlike(f"[{fixed.LOWER}]")


def has_digit(value: Column | str) -> Column:
    return _col(value).rlike(f"[{fixed.DIGIT}]")


def mixed_class(value: Column | str) -> Column:
    upper, lower, digit = has_upper(value), has_lower(value), has_digit(value)
    return (upper & (lower | digit)) | (lower & digit)


def word_segments(value: Column | str) -> Column:
    """Camel-case words and digit runs. Every alphanumeric run yields at least one."""
    return F.regexp_extract_all(_col(value), F.lit(WORDS), F.lit(0))


def vowel_segments(value: Column | str) -> Column:
    return F.size(F.filter(word_segments(value), lambda word: word.rlike("[aeiouyAEIOUY]")))


def compact(value: Column | str) -> Column:
    return F.replace(_col(value), F.lit("-"), F.lit(""))


def is_nil(value: Column | str) -> Column:
    return _col(value).rlike(r"^-*+0[0-]*+\z")


def is_long_hex(value: Column | str) -> Column:
    return compact(value).rlike(rf"^[0-9a-fA-F]{{{fixed.MIN_HEX_LENGTH},}}\z")


def is_uuid_or_hex32(value: Column | str) -> Column:
    # A UUID without its dashes is one of these too.
    return compact(value).rlike(r"^[0-9a-fA-F]{32}\z")


def is_call(value: Column | str) -> Column:
    v = _col(value)
    return v.endswith(")") & v.rlike(r"(?d)^[A-Za-z_][A-Za-z0-9_]*+(?:\.[A-Za-z_][A-Za-z0-9_]*+){0,256}\(.*\)\z")


def is_annotation(value: Column | str) -> Column:
    v = _col(value)
    return v.endswith("]") & v.rlike(r"(?d)^[A-Za-z_][A-Za-z0-9_]*+\[.+\]\z")


def classify(value: Column | str) -> Column:
    """``struct(tier, reason)`` of a value: an ordered decision list, evaluated lazily."""
    return let(unquoted(value), _classify)


def _classify(v: Column) -> Column:
    def verdict(tier: str, reason: str | None = None) -> Column:
        return F.struct(F.lit(tier).alias("tier"), F.lit(reason).cast("string").alias("reason"))

    wordy = ~has_digit(v) & (vowel_segments(v) >= fixed.MIN_VOWEL_SEGMENTS)
    return (
        F.when(v.isNull() | (F.length(v) < fixed.MIN_VALUE_LENGTH), verdict(fixed.NONE))
        .when(is_placeholder(v) | is_nil(v), verdict(fixed.NONE))
        .when(is_call(v), verdict(fixed.NONE, fixed.FUNCTION_CALL))
        .when(is_annotation(v), verdict(fixed.NONE, fixed.TYPE_ANNOTATION))
        .when(is_uuid_or_hex32(v), verdict(fixed.LIKELY, fixed.UUID))
        .when(~mixed_class(v), verdict(fixed.NONE))
        .when(entropy(v) < fixed.MIN_ENTROPY, verdict(fixed.NONE))
        .when(wordy & has_upper(F.left(v, F.lit(1))), verdict(fixed.POSSIBLE, fixed.PASSPHRASE))
        .when(wordy, verdict(fixed.POSSIBLE, fixed.IDENTIFIER))
        .when(is_long_hex(v), verdict(fixed.LIKELY))
        .when(transition_rate(v) >= fixed.MIN_TRANSITION, verdict(fixed.LIKELY))
        .otherwise(verdict(fixed.POSSIBLE, fixed.LOW_TRANSITION))
    )


def is_suspicious(tier: Column | str) -> Column:
    """Possible or likely: the older yes/no meaning of a hit."""
    return _col(tier).isin(fixed.POSSIBLE, fixed.LIKELY)


def tier_rank(tier: Column | str) -> Column:
    t = _col(tier)
    return F.when(t == fixed.CERTAIN, 0).when(t == fixed.LIKELY, 1).when(t == fixed.POSSIBLE, 2)


def tier_name(rank: Column | str) -> Column:
    r = _col(rank)
    return F.when(r == 0, fixed.CERTAIN).when(r == 1, fixed.LIKELY).when(r == 2, fixed.POSSIBLE)
