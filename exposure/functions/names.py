"""Predicates on names, paths and whole texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from exposure.functions import fixed

QUOTES = "'\""


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unquoted(value: Column | str) -> Column:
    return F.btrim(_col(value), F.lit(QUOTES))


def is_secret_name(name: Column | str) -> Column:
    """Name ends in a vocabulary word, with only ``word_`` or ``word-`` segments before it."""
    n = unquoted(F.regexp_replace(_col(name), f"^[{fixed.SPACES}]+|[{fixed.SPACES}]+$", ""))
    ends_in_keyword = n.rlike(rf"(?i)(?:^|[_-]){fixed.KEYWORD}\z")
    odd_shape = n.rlike(r"^[_-]|[_-][_-]|[^A-Za-z0-9_-]")
    return ends_in_keyword & ~odd_shape


def is_placeholder(value: Column | str) -> Column:
    v = unquoted(value)
    return F.lower(v).isin(*fixed.PLACEHOLDERS) | v.rlike(r"^(?:[xX]{6,}|0{6,}|1{6,})\z")


def is_env_name(value: Column | str) -> Column:
    """``GOOGLE_API_KEY``: the name of a variable, not a value."""
    return _col(value).rlike(r"^[A-Z][A-Z0-9]*+(?:_[A-Z0-9]++){1,64}\z")


def is_path_value(value: Column | str) -> Column:
    return _col(value).rlike(r"^(?:\.{1,2}/|/|~/|[A-Za-z]:[\\/])")


def is_json_container(text: Column | str) -> Column:
    return _col(text).rlike(rf"^[{fixed.SPACES}]*+[\[{{]")


def any_literal(text: Column, literals: tuple[str, ...]) -> Column:
    out = text.contains(literals[0])
    for literal in literals[1:]:
        out = out | text.contains(literal)
    return out


def _over_lower(text: Column, test) -> Column:
    """Apply ``test`` to the lower-cased text; the lambda variable makes it be built once."""
    return F.exists(F.array(F.lower(text)), test)


def has_keyword(text: Column | str) -> Column:
    """Cheap necessary test for an assignment or flag hit: literal search, no regular expression."""
    return _over_lower(_col(text), lambda low: any_literal(low, fixed.KEYWORD_LITERALS))


def has_bearer_word(text: Column | str) -> Column:
    return _over_lower(_col(text), lambda low: low.contains("bearer"))


def has_prefix_literal(text: Column | str) -> Column:
    literals = tuple(dict.fromkeys(lit for _, lits, _ in fixed.VENDOR_PREFIXES for lit in lits))
    return any_literal(_col(text), literals)


def may_hold_secret(text: Column | str) -> Column:
    """Necessary condition for any hit at all; what a scan filters on before it runs a pattern."""
    t = _col(text)
    words = (*fixed.KEYWORD_LITERALS, "bearer")
    return has_prefix_literal(t) | _over_lower(t, lambda low: any_literal(low, words))


def prefix_kind(text: Column | str) -> Column:
    """First vendor kind in list order (not leftmost match), or null."""
    t = _col(text)
    return F.coalesce(
        *(F.when(any_literal(t, lits) & t.rlike(pattern), F.lit(kind)) for kind, lits, pattern in fixed.VENDOR_PREFIXES)
    )


def has_any_prefix(text: Column | str) -> Column:
    return prefix_kind(text).isNotNull()


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def suffix(path: Column | str) -> Column:
    """Lower-cased last suffix; a leading dot alone makes no suffix."""
    name = basename(path)
    return F.lower(F.regexp_extract(name, r"^.+?.*(\.[^.]+)\z", 1))


def is_dotenv_name(name: Column | str) -> Column:
    n = _col(name)
    return (n == ".env") | (n.startswith(".env.") & ~n.endswith(".imported"))


def file_kind(path: Column | str) -> Column:
    """Kind of a file that is sensitive by name; null for any other."""
    name = basename(path)
    return (
        F.when(is_dotenv_name(name), "dotenv")
        .when(name.isin("credentials.json", ".npmrc", ".pypirc"), name)
        .when(name.isin(*fixed.SSH_KEY_NAMES), "ssh_private_key")
        .when(name.isin(*fixed.MCP_NAMES), "mcp_config")
        .when(name.isin(*fixed.HISTORY_NAMES) | name.endswith("_history"), "shell_history")
        .when(name.isin(*fixed.GIT_CONFIG_NAMES), "git_config")
    )


def is_text_file(path: Column | str) -> Column:
    return suffix(path).isin(*fixed.TEXT_SUFFIXES) | basename(path).isin(*fixed.TEXT_FILE_NAMES)


def git_config_suspect(text: Column | str, strict_url: bool = False) -> Column:
    """Whether a git config may embed credentials.

    By default any URL counts; ``strict_url`` asks for user and password inside the URL.
    """
    t = F.coalesce(_col(text), F.lit(""))
    assigned = t.rlike(r"(?i)(?:token|password|authorization|_authToken)\s*=")
    url = t.rlike(r"https?://[^/\s:]+:[^/\s]+@") if strict_url else t.contains("://")
    return assigned | url
