"""Detection: texts to hits, in one narrow pass without a shuffle.

A text first meets literal searches only. The patterns run on the few texts that pass, each once,
and everything about a single value is decided after the explode, where hits are few.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposure.functions import fixed, values
from exposure.functions import names as nm

TEXT_KEY = ("src", "id", "part")

# A match is a keyword with its tail (quote, separator, value). Only the keyword is consumed, so hits
# may overlap. What stands left of it is looked at where a match was found: the run of name
# characters, with the character before it. A keyword is not sought inside a word that already ended
# an earlier keyword.
_KEYWORD = fixed.KEYWORD.replace("token", "(?<!secre)token")
_FIRST = "(?=[apst])"  # letters that a keyword begins with: most places are passed by one look
_GAP = f"[{fixed.SPACES}]*+"
_TAIL = rf"['\"]?{_GAP}[:=]{_GAP}['\"]?(?-i:{fixed.VALUE_CHARS}{{8,}}+)['\"]?"
_LEFT = r"(?:^|[^A-Za-z0-9_-])[A-Za-z0-9_-]{0,300}|[A-Za-z0-9_-]{301}"
ASSIGNMENT = rf"(?i){_FIRST}(?=({_KEYWORD}{_TAIL}))(?<=({_LEFT})){_KEYWORD}"
ASSIGNMENT_HEAD = rf"(?i)^({fixed.KEYWORD})(['\"]?){_GAP}[:=]{_GAP}(['\"]?)"
# A name takes in the ``word_`` segments left of its keyword.
NAME_PREFIX = r"(?:^|[^A-Za-z0-9])((?:[A-Za-z0-9]++[_-])*)\z"

# ``--api-key value``: the value must not look like a variable, a redirect or the next option.
_FLAG_VALUE = rf"[^{fixed.SPACES}'\"`;|&<>()$=\\-][^{fixed.SPACES}'\"`;|&<>()$=\\]{{7,}}+"
FLAG = rf"(?<![\p{{L}}\p{{N}}_./=-])--?[A-Za-z][A-Za-z0-9_-]*+[ \t]++(['\"]?){_FLAG_VALUE}\1"
FLAG_PARTS = r"(?s)^--?([A-Za-z][A-Za-z0-9_-]*)[ \t]+['\"]?(.*?)['\"]?\z"

# One pattern that consumes what it matches: the older detector, kept to compare with.
CONSUMING = (
    r"(?i)(['\"]?)((?:[a-z0-9]+[_-])*(?:api[_-]?key|token|secret|password|passwd|private[_-]?key))"
    r"(['\"]?)\s*[:=]\s*(['\"]?)([^\s'\"]{8,})(['\"]?)"
)

# Hits of one text are numbered: assignments in text order, then flags.
FLAG_SEQ = 1 << 40


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _hit(form: str, seq: Column | int, name: Column | None, value: Column | None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(
        F.lit(form).alias("form"),
        (seq if isinstance(seq, Column) else F.lit(seq)).cast("bigint").alias("seq"),
        (null if name is None else name).alias("name"),
        (null if value is None else value).alias("value"),
    )


def _name_start(left: Column) -> Column:
    """``struct(prefix, before)`` of what stands left of a keyword: the segments that the name takes in, and the character before them."""

    def cut(run: Column) -> Column:
        def taken(prefix: Column) -> Column:
            whole = (F.length(prefix) == F.length(run)) & (F.length(run) <= fixed.MAX_NAME_PREFIX)
            reached = F.regexp_replace(F.right(prefix, F.lit(fixed.MAX_NAME_PREFIX)), "^[_-]", "")
            before = F.when(whole, F.left(left, F.length(left) - F.length(run))).otherwise(F.lit(""))
            return F.struct(reached.alias("prefix"), before.alias("before"))

        return nm.let(F.regexp_extract(run, NAME_PREFIX, 1), taken)

    # Most keywords stand alone: a struct without a pattern for those.
    alone = F.struct(F.lit("").alias("prefix"), left.alias("before"))
    return F.when(left.rlike(r"[A-Za-z0-9_-]\z"), nm.let(F.regexp_replace(left, "^[^A-Za-z0-9_-]", ""), cut)).otherwise(alone)


def _assignments(text: Column) -> Column:
    """``NAME=value`` matches as hit structs. Quotes of the name and of the value must pair."""

    def split(m: Column, i: Column) -> Column:
        # No part holds a line feed, so a match comes apart in one pass: keyword, quote of the name, quote of the value, rest.
        parts = F.split(F.regexp_replace(m.hit, ASSIGNMENT_HEAD, "$1\n$2\n$3\n"), "\n", 4)
        return F.struct(i.alias("i"), parts.alias("parts"), _name_start(m.left).alias("start"))

    def paired(h: Column) -> Column:
        name_end, opener, rest = (h.parts[n] for n in (1, 2, 3))
        return ((name_end == "") | (name_end == h.start.before)) & ((opener == "") | rest.endswith(opener))

    def hit(h: Column) -> Column:
        rest = h.parts[3]
        closed = rest.endswith(nm.QUOTES[0]) | rest.endswith(nm.QUOTES[1])
        value = F.when(closed, F.left(rest, F.length(rest) - 1)).otherwise(rest)
        return _hit("assignment", h.i, F.concat(h.start.prefix, h.parts[0]), value)

    matches = F.arrays_zip(_all(text, ASSIGNMENT, 1).alias("hit"), _all(text, ASSIGNMENT, 2).alias("left"))
    return F.transform(F.filter(F.transform(matches, split), paired), hit)


def _flags(text: Column) -> Column:
    """``--name value`` matches as hit structs; names of variables and paths are no values."""

    def split(hit: Column, i: Column) -> Column:
        name, value = F.regexp_extract(hit, FLAG_PARTS, 1), F.regexp_extract(hit, FLAG_PARTS, 2)
        return _hit("flag", i.cast("bigint") + F.lit(FLAG_SEQ), name, value)

    def kept(h: Column) -> Column:
        return nm.is_secret_name(h["name"]) & ~nm.is_env_name(h["value"]) & ~nm.is_path_value(h["value"])

    return F.filter(F.transform(_all(text, FLAG, 0), split), kept)


def _marks(form: str, found: Column) -> Column:
    """The vendor kind or the bearer capture as at most one hit struct."""
    present = F.filter(F.array(found), lambda v: v.isNotNull() & (v != ""))
    return F.transform(
        present, lambda v: _hit(form, -1, v if form == "prefix" else None, v if form == "bearer" else None)
    )


def found(text: Column) -> Column:
    """Array of every match in a text as hit structs, which hold values; empty for most texts."""
    none = F.array().cast("array<struct<form:string,seq:bigint,name:string,value:string>>")

    def search(t: Column) -> Column:
        keyword = nm.any_literal(t.low, fixed.KEYWORD_LITERALS)
        marked = t.low.contains("bearer") | nm.has_prefix_literal(t.text)
        bearer = F.when(t.low.contains("bearer"), F.regexp_extract(t.text, fixed.BEARER, 1))
        marks = F.flatten(
            F.transform(
                F.array(nm.prefix_kind(t.text)),
                lambda kind: F.concat(_marks("prefix", kind), _marks("bearer", F.when(kind.isNull(), bearer))),
            )
        )
        return F.concat(
            F.when(marked, marks).otherwise(none),
            F.when(keyword, _assignments(t.text)).otherwise(none),
            F.when(keyword & t.text.contains("-"), _flags(t.text)).otherwise(none),
        )

    # The one-element array binds the lower-cased text once for all literal searches.
    bound = F.array(F.struct(text.alias("text"), F.lower(text).alias("low")))
    words = (*fixed.KEYWORD_LITERALS, "bearer")
    gate = F.filter(bound, lambda t: nm.any_literal(t.low, words) | nm.has_prefix_literal(t.text))
    return F.flatten(F.transform(gate, search))


def _key(texts: DataFrame) -> list[str]:
    return [c for c in texts.columns if c != "text"]


def _grade(found: Column, fire_tiers: tuple[str, ...]) -> Column:
    """Add tier, rank and reasons to hit structs and keep those that have a tier.

    Each step binds its result once, so that no expression over a value is evaluated twice.
    """
    none = F.array().cast("array<string>")

    def judge(h: Column) -> Column:
        return F.struct(h.alias("h"), values.classify(h["value"]).alias("v"))

    def fires(x: Column) -> Column:
        form = x.h.form
        return (form == "prefix") | (values.is_suspicious(x.v.tier) & ((form != "flag") | x.v.tier.isin(*fire_tiers)))

    def rate(x: Column) -> Column:
        form, reason = x.h.form, x.v.reason
        flag = F.lit(fixed.FLAG_FORM)
        reasons = F.when(form == "assignment", F.when(reason.isNotNull(), F.array(reason)).otherwise(none)).when(
            form == "flag", F.when(reason.isNotNull(), F.array(flag, reason)).otherwise(F.array(flag))
        )
        return F.struct(
            x.h.seq.alias("seq"), form.alias("form"), x.h["name"].alias("name"), x.h["value"].alias("value"),
            F.when(form == "prefix", fixed.CERTAIN).otherwise(x.v.tier).alias("tier"),
            F.when(form == "prefix", 0).otherwise(values.tier_rank(x.v.tier)).cast("int").alias("tier_rank"),
            F.coalesce(reasons, none).alias("reasons"),
        )

    return F.transform(F.filter(F.transform(found, judge), fires), rate)


def found_hits(text: str, fire_tiers: tuple[str, ...] = (fixed.LIKELY, fixed.POSSIBLE)) -> Column:
    """Graded hits of a text column as one array expression. Its ``value`` field must not be published.

    The expression is large, so it is built once per Spark context and column name.
    """
    context = SparkContext.getOrCreate()
    return _found_hits(context.applicationId, text, tuple(fire_tiers))


@lru_cache(maxsize=64)
def _found_hits(application: str, text: str, fire_tiers: tuple[str, ...]) -> Column:
    return _grade(found(F.col(text)), fire_tiers)


def valued_hits(texts: DataFrame, fire_tiers: tuple[str, ...] = (fixed.LIKELY, fixed.POSSIBLE)) -> DataFrame:
    """Graded hits with their values, for redaction and dictionaries only."""
    return texts.select(*_key(texts), F.inline(found_hits("text", fire_tiers)))


def hits(texts: DataFrame, fire_tiers: tuple[str, ...] = (fixed.LIKELY, fixed.POSSIBLE)) -> DataFrame:
    """Graded hits of every form, without values.

    ``form`` is ``prefix`` (name = vendor kind), ``bearer``, ``assignment`` or ``flag``.
    """
    return valued_hits(texts, fire_tiers).drop("value")


def named_values(texts: DataFrame, form: str) -> DataFrame:
    """Named values of one form before grading. Holds values."""
    text = F.col("text")
    gate = nm.has_keyword(text) & (text.contains("-") if form == "flag" else F.lit(True))
    arrays = _flags(text) if form == "flag" else _assignments(text)
    return texts.where(gate).select(*_key(texts), F.inline(arrays))


def assignment_hits(texts: DataFrame, overlapping: bool = True) -> DataFrame:
    """``NAME=value`` before grading. Holds values.

    Hits may overlap, unless not ``overlapping``: then a value that runs on over a next keyword swallows it.
    """
    return named_values(texts, "assignment") if overlapping else consuming_assignment_hits(texts)


def flag_hits(texts: DataFrame) -> DataFrame:
    """``--name value`` before grading. Holds values."""
    return named_values(texts, "flag")


def prefix_marks(texts: DataFrame) -> DataFrame:
    text = F.col("text")
    return (
        texts.where(nm.has_prefix_literal(text))
        .select(*TEXT_KEY, nm.prefix_kind(text).alias("prefix_kind"))
        .where(F.col("prefix_kind").isNotNull())
    )


def bearer_marks(texts: DataFrame) -> DataFrame:
    return hits(texts).where(F.col("form") == "bearer").select(*TEXT_KEY, F.col("tier").alias("bearer_tier"))


def consuming_assignment_hits(texts: DataFrame) -> DataFrame:
    """The older single-pattern detector, where one match swallows what it covers. Holds values."""
    text = F.col("text")
    groups = F.arrays_zip(*(_all(text, CONSUMING, g).alias(f"g{g}") for g in (1, 2, 3, 4, 5, 6)))
    rows = texts.where(nm.has_keyword(text)).select(*_key(texts), F.posexplode(groups).alias("seq", "g")).select(*_key(texts), "seq", "g.*")
    paired = (F.col("g3").isin("") | (F.col("g1") == F.col("g3"))) & (F.col("g4").isin("") | (F.col("g4") == F.col("g6")))
    return rows.where(paired).select(*_key(texts), F.col("seq").cast("bigint").alias("seq"), F.col("g2").alias("name"), F.col("g5").alias("value"))
