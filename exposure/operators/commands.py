"""Command logs checked against an allow/deny rule table.

Each command line is a row; splitting, unwrapping and finding the verb happen inside the row. A
nested script becomes a row of its own, in document order, and finished rows pass through. For
decisions each distinct line is taken apart once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from exposure.functions import fixed
from exposure.functions.names import let
from exposure.operators.detection import hits
from exposure.session import store

_QUOTED = r"'[^']*+'|\"[^\"]*+\""
# Quotes group within a word and are then dropped.
_GROUPING = rf"(?:[^\s'\"]++|{_QUOTED})+"
# With backslashes in the line (Windows paths) quotes are kept, and group only at the start of a word.
_KEEPING = rf"{_QUOTED}|[^\s'\"]\S*+|['\"]\S*+"


def policy_rules(spark: SparkSession, tool: str) -> DataFrame:
    """The default rule set as ``rules(tool, verb, sub, effect)`` under the tool's own name."""
    return spark.createDataFrame([(tool, *r) for r in fixed.POLICY_RULES], "tool STRING, verb STRING, sub STRING, effect STRING")


def tokens(text: Column) -> Column:
    """Words of a command line. Escapes inside quotes are not interpreted."""

    def split(t: Column) -> Column:
        words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
        grouped = F.transform(
            F.regexp_extract_all(t, F.lit(_GROUPING), F.lit(0)),
            lambda w: F.regexp_replace(w, r"'([^']*+)'|\"([^\"]*+)\"", "$1$2"),
        )

        def kept_or_words(kept: Column) -> Column:
            open_quote = F.exists(
                kept, lambda w: w.rlike(r"^['\"]") & ((F.length(w) == 1) | (F.left(w, F.lit(1)) != F.right(w, F.lit(1))))
            )
            return F.when(open_quote, words).otherwise(kept)

        unclosed = F.regexp_replace(t, _QUOTED, "").rlike(r"['\"]")
        return F.when(~t.contains("\\") & ~unclosed, grouped).otherwise(
            let(F.regexp_extract_all(t, F.lit(_KEEPING), F.lit(0)), kept_or_words)
        )

    return let(F.trim(text), split)


def chunks(words: Column) -> Column:
    """Words split at chain operators that stand alone."""

    def spans(cuts: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(cuts) - 1),
            lambda k: F.slice(words, F.element_at(cuts, k) + 1, F.element_at(cuts, k + 1) - F.element_at(cuts, k) - 1),
        )

    cuts = F.concat(
        F.array(F.lit(0)),
        F.filter(F.transform(words, lambda w, i: F.when(w.isin(*fixed.CHAIN_OPERATORS), i + 1).otherwise(0)), lambda i: i > 0),
        F.array(F.size(words) + 1),
    )
    return F.filter(let(cuts, spans), lambda c: F.size(c) > 0)


def _base(word: Column) -> Column:
    return F.lower(F.regexp_extract(F.regexp_replace(F.replace(word, F.lit("\\"), F.lit("/")), r"/+\z", ""), r"[^/]*\z", 0))


def shell_scripts(words: Column) -> Column:
    """Scripts given to a shell with ``-c`` (also ``-lc`` and the like)."""
    start = F.struct(F.lit(False).alias("shell"), F.lit(False).alias("c"), F.array().cast("array<string>").alias("scripts"))

    def read(s: Column, w: Column) -> Column:
        option = s.shell & w.startswith("-")
        is_c = w.isin("-c", "-lc") | (~w.startswith("--") & F.regexp_replace(w, "^-+", "").contains("c"))
        script = s.shell & s.c & ~w.startswith("-")
        return F.struct(
            F.when(option, F.lit(True)).when(script, F.lit(False)).otherwise(_base(w).isin(*fixed.SHELL_NAMES)).alias("shell"),
            (option & (s.c | is_c)).alias("c"),
            F.when(script, F.array_append(s.scripts, w)).otherwise(s.scripts).alias("scripts"),
        )

    return F.aggregate(words, start, read, lambda s: s.scripts)


def _index_of(words: Column, test) -> Column:
    """0-based index of the first word that passes, or the number of words."""
    marks = F.transform(words, test)
    at = F.array_position(marks, F.lit(True))
    return F.when(at > 0, at - 1).otherwise(F.size(words)).cast("int")


def _rest(words: Column, start: Column) -> Column:
    return F.slice(words, start + 1, F.greatest(F.size(words) - start, F.lit(0)))


def strip_launcher(words: Column, tool_names: Sequence[str], module: str | None = None) -> Column:
    """Arguments after the tool's launcher, or null where a chunk does not run the tool.

    Skips ``env`` and ``A=b``; knows the tool by name, path or ``.exe``, ``uvx``, ``pipx run`` and
    ``python -m``.
    """
    names = [n for t in tool_names for n in (t, f"{t}.exe")]
    module = module or tool_names[-1].replace("-", "_")

    def is_tool(w: Column) -> Column:
        return _base(w).isin(*names)

    def word(w: Column, i: int) -> Column:
        return F.coalesce(F.try_element_at(w, F.lit(i)), F.lit(""))

    def drop_while(w: Column, test) -> Column:
        return _rest(w, _index_of(w, lambda x: ~test(x)))

    def skip_env(w: Column) -> Column:
        options_gone = drop_while(_rest(w, F.lit(1)), lambda x: x.startswith("-"))
        after = F.when(_base(word(w, 1)) == "env", options_gone).otherwise(w)
        return let(after, lambda a: drop_while(a, lambda x: x.rlike(r"(?s)^[A-Za-z_][A-Za-z0-9_]*+=.")))

    def module_args(options: Column) -> Column:
        """Arguments after ``-m module`` if the module is the tool, else null."""
        is_module = lambda a: (word(a, 1) == "-m") & (F.replace(word(a, 2), F.lit("-"), F.lit("_")) == module)
        after = drop_while(options, lambda x: x.startswith("-") & (x != "-m"))
        return let(after, lambda a: F.when(is_module(a), _rest(a, F.lit(2))))

    def launched(argv: Column) -> Column:
        def by(first: Column) -> Column:
            return (
                F.when((first == "uvx") & is_tool(word(argv, 2)), _rest(argv, F.lit(2)))
                .when((first == "pipx") & (word(argv, 2) == "run") & is_tool(word(argv, 3)), _rest(argv, F.lit(3)))
                .when(first.isin(*names), _rest(argv, F.lit(1)))
                .when(first.isin("py", "py.exe") | first.startswith("python"), module_args(_rest(argv, F.lit(1))))
            )

        return let(_base(word(argv, 1)), by)

    return let(let(words, skip_env), launched)


def first_verb(argv: Column) -> Column:
    """``struct(verb, rest)``. A leading option without ``=`` takes the next word as its value."""
    start = F.struct(
        F.lit(None).cast("string").alias("verb"), F.lit(False).alias("takes"), F.lit(0).alias("read")
    )

    def read(s: Column, w: Column) -> Column:
        done = s.verb.isNotNull()
        option = w.startswith("-") & (w != "--")
        verb = (
            F.when(done, s.verb).when(w.isin("--version", "-V"), "--version").when(w.isin("--help", "-h"), "--help")
            .when(option | (s.takes & ~w.startswith("-")), F.lit(None).cast("string")).otherwise(w)
        )
        return F.struct(
            verb.alias("verb"), (~done & option & ~w.contains("=")).alias("takes"),
            F.when(done, s.read).otherwise(s.read + 1).alias("read"),
        )

    return let(
        F.aggregate(argv, start, read),
        lambda s: F.struct(F.coalesce(s.verb, F.lit("")).alias("verb"), _rest(argv, s.read).alias("rest")),
    )


_PIECE = "struct<ord:array<int>,wrap:string,kind:string,text:string,argv:array<string>>"


def _piece(ord_: Column, wrap: Column, kind: str, text: Column | None, argv: Column | None) -> Column:
    return F.struct(
        ord_.alias("ord"), wrap.alias("wrap"), F.lit(kind).alias("kind"),
        (F.lit(None).cast("string") if text is None else text).alias("text"),
        (F.lit(None).cast("array<string>") if argv is None else argv).alias("argv"),
    ).cast(_PIECE)


def parse(
    commands: DataFrame, tool_names: Sequence[str], wrap_verbs: Sequence[str] = ("run",), module: str | None = None
) -> DataFrame:
    """Commands taken apart: ``cmd_id, ord, wrap, kind, text, argv``.

    ``kind``: ``tool`` (a run of the tool, ``argv`` after the launcher), ``trailing`` (what a
    wrapping verb runs) and ``other`` (another command). ``ord`` orders pieces as a reader meets
    them; ``wrap`` is what stands around. Nesting has no limit: what is still to be read after a
    level goes on alone, and as it is shorter than what it stood in, the rounds end.
    """
    rows = commands.select(
        "cmd_id", F.array().cast("array<int>").alias("ord"), F.lit("").alias("wrap"), F.lit("pending").alias("kind"),
        "text", F.lit(None).cast("array<string>").alias("argv"),
    )
    opened = let(tokens(F.col("text")), lambda words: _pieces(words, tool_names, wrap_verbs, module))
    read: DataFrame | None = None
    while True:
        rows = store(rows.select("cmd_id", F.inline(opened)))
        done = rows.where("kind <> 'pending'")
        read = done if read is None else read.unionByName(done)
        rows = rows.where("kind = 'pending'")
        if rows.isEmpty():
            return read


def _pieces(words: Column, tool_names: Sequence[str], wrap_verbs: Sequence[str], module: str | None) -> Column:
    """What one pending text falls into; scripts and wrapped commands are pending in turn."""
    wrap = F.col("wrap")
    none = F.array().cast(f"array<{_PIECE}>")

    def place(kind: int, i: Column, *more: int) -> Column:
        """Scripts (0) come before the chunks (1) of a line."""
        return F.concat(F.col("ord"), F.array(F.lit(kind), i.cast("int"), *map(F.lit, more)))

    def wrapped(argv: Column, verb: Column, at: Column) -> Column:
        around = F.concat(wrap, F.lit(f"{tool_names[0]} "), verb, F.lit(" wrapping "))

        def tail_pieces(tail: Column) -> Column:
            return F.array(
                _piece(place(1, at, 0), wrap, "trailing", tail, None), _piece(place(1, at, 1), around, "pending", tail, None)
            )

        def after(dash: Column) -> Column:
            return F.when(dash + 1 < F.size(argv), let(F.array_join(_rest(argv, dash + 1), " "), tail_pieces)).otherwise(none)

        return F.when(verb.isin(*wrap_verbs), let(_index_of(argv, lambda x: x == "--"), after)).otherwise(none)

    def chunk(words_: Column, i: Column) -> Column:
        def sorted_out(argv: Column) -> Column:
            # A shell whose script is read in its own right is not read again as a text.
            text = F.when(F.size(shell_scripts(words_)) == 0, F.array_join(words_, " ")).otherwise(F.lit(""))
            other = F.array(_piece(place(1, i), wrap, "other", text, None))
            tool = F.array(_piece(place(1, i), wrap, "tool", None, argv))
            return F.when(argv.isNull(), other).otherwise(
                F.concat(tool, let(first_verb(argv).verb, lambda verb: wrapped(argv, verb, i)))
            )

        return let(strip_launcher(words_, tool_names, module), sorted_out)

    inner = F.transform(shell_scripts(words), lambda s, i: _piece(place(0, i), wrap, "pending", s, None))
    return F.concat(inner, F.flatten(F.transform(chunks(words), chunk)))


def naming(commands: DataFrame, tool_names: Sequence[str], module: str | None = None) -> DataFrame:
    """Commands whose text, quotes taken out, names the tool anywhere: all that can run it."""
    words = dict.fromkeys([*tool_names, module or tool_names[-1]])
    plain = F.translate(F.regexp_replace(F.lower("text"), "['\"]", ""), "-", "_")
    hit = F.lit(False)
    for word in words:
        hit = hit | plain.contains(word.lower().replace("-", "_"))
    return commands.select("cmd_id", "text").where(hit)


def policy_decisions(
    commands: DataFrame, rules: DataFrame, tool_names: Sequence[str], module: str | None = None
) -> DataFrame:
    """Per command ``cmd_id, decision, kind``: the first denied run of the tool in reading order.

    Rules of other tools do not count. A rule may name a verb, a verb with a nested verb, or a verb with an option (``--yes``). What no
    rule denies is allowed, unknown verbs as well. ``kind`` spells the denied command, with what
    wraps it. A decision depends on the text alone, so each text is taken apart once, however often it was run.
    """
    label = tool_names[0]
    rules = rules.where(F.col("tool").isin(*tool_names))
    wraps = [r["verb"] for r in rules.where("effect = 'wrap'").select("verb").distinct().collect()] or ["run"]
    lines = naming(commands, tool_names, module).select("text").distinct().select(F.col("text").alias("cmd_id"), "text")
    argvs = parse(lines, tool_names, wraps, module).where("kind = 'tool'")
    verbs = argvs.withColumn("__v", first_verb(F.col("argv"))).select(
        "cmd_id", "ord", "wrap", F.col("__v.verb").alias("verb"), F.col("__v.rest").alias("rest")
    ).withColumn("nested", first_verb(F.col("rest")).verb)
    deny = rules.where("effect = 'deny'").select(F.col("verb").alias("__verb"), "sub")
    option = F.col("sub").startswith("--") & F.exists(
        "rest", lambda w: (w == F.col("sub")) | w.startswith(F.concat(F.col("sub"), F.lit("=")))
    )
    applies = F.col("sub").isNull() | option | (F.col("nested") == F.col("sub"))
    matched = verbs.join(deny, F.col("verb") == F.col("__verb")).where(applies).select(
        "cmd_id", "ord", F.concat(F.col("wrap"), F.concat_ws(" ", F.lit(label), "verb", "sub")).alias("kind")
    )
    first = matched.groupBy(F.col("cmd_id").alias("text")).agg(F.min_by("kind", "ord").alias("kind"))
    return commands.select("cmd_id", "text").join(first, "text", "left").select(
        "cmd_id", F.when(F.col("kind").isNotNull(), "deny").otherwise("allow").alias("decision"), "kind"
    )


def scan_command_text(commands: DataFrame, tool_names: Sequence[str], module: str | None = None) -> DataFrame:
    """Secret hits in what the tool runs and in its sibling commands, not in the tool's own options."""
    pieces = parse(commands.select("cmd_id", "text"), tool_names, module=module).where("kind in ('trailing', 'other')")
    # A trailing text is parsed further as well; its own chunks would repeat its hits.
    texts = pieces.where("kind = 'trailing' or wrap = ''").select(
        F.lit("commands").alias("src"), F.col("cmd_id").cast("string").alias("id"), F.lit(0).alias("part"), "ord", "text"
    )
    return hits(texts)
