"""License scans: an exact set-similarity join of text blocks with license templates, and exact phrases beside it.

A block is a \\n-split line; its set are the distinct words ([^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased). A template is found
where the block holds at least ``threshold`` of the template's distinct words. Only words of some template can count, so a block's set is cut to
them. Most texts hold too few words of any template, wherever they stand; one pass over all texts leaves them out, and only the rest is cut into
blocks and searched for runs. Words are ordered by how many blocks of these texts have them, rare ones first. With ``need`` = ceil(threshold * size):

- prefix filter: a block that holds ``need`` words holds one of the template's first size - need + 1; only those words are probed;
- length filter: its own set has at least ``need`` words;
- positional filter: behind the first common word, both sets have enough words left to reach ``need``.

What passes is counted. One row of a probe, the first common word, is kept for each block and template, so nothing is shuffled to find pairs.
With ``wrapped``, notices that run over several lines are found as well: a run of as many words as the template has and a quarter more, lines aside, that
holds ``threshold`` of its distinct words (a template of SHORT words or fewer: all of them) and all that tell it from others (``must``). Every such run has one
of the template's first size - need + 1 words in an order of its own, in which words of under four letters come last, so only texts that contain one are
looked at, and there the surroundings of those words.

All of it is DataFrame functions. The templates are a list that the driver holds, so their index is what bounds the broadcast.

Defined cases: a null text is the empty one, which has no words, and so no license; repeated rows give a row each, and a null id stays null; an empty
table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposure.llm.common import id_and_text, save

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHORT = 8
KELVIN, KRA = "K", "ĸ"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    must: tuple[str, ...] = ()


#: Opening words of public license texts and the usual short notices: fixed values.
TEMPLATES = (
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", ("apache",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution",)),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    Template("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ("creative", "commons", "attribution", "4")),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ("gnu", "general", "3")),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("gnu", "general")),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("fee",)),
    Template("mit", "Released under the MIT License"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("charge", "associated")),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla", "2")),
)

#: Phrases of the base scan and their labels: fixed values.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))


def folded(text: F.Column) -> F.Column:
    """A-Z lower-cased. ``lower`` goes by bytes where all are ASCII; the one other letter that it would turn into an ASCII one is kept apart."""
    return F.lower(F.replace(text, F.lit(KELVIN), F.lit(KRA)))


def words_of(text: F.Column) -> F.Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def template_words(template: Template) -> list[str]:
    """In the driver: the distinct words of a template."""
    return sorted(set(re.findall(WORD, template.text.lower())))


def needed(words: list[str], threshold: float) -> int:
    return math.ceil(threshold * len(words) - 1e-9)


def promising(docs: DataFrame, templates: tuple[Template, ...], threshold: float, id_col: str, text_col: str) -> DataFrame:
    """id, h (hash of the text), text (folded) of every text that holds as many words of some template as a block or a run needs: no other text can have a match."""
    rows = id_and_text(docs, id_col, text_col).select("id", F.xxhash64("text").alias("h"), folded(F.col("text")).alias("text"))
    sets = [template_words(t) for t in templates]
    vocabulary = sorted(set().union(*sets))
    among = lambda words, of: F.array_intersect(words, F.array(*map(F.lit, of)))

    def enough(own: F.Column) -> F.Column:
        some = F.lit(False)
        for words in filter(None, sets):
            some = some | (F.size(among(own, words)) >= needed(words, threshold))
        return some

    # a function of the one list: as a column of its own, the words would be made anew for each template when the filter moves down
    return rows.where(F.exists(F.array(among(words_of(F.col("text")), vocabulary)), enough)) if vocabulary else rows.limit(0)


def blocks(texts: DataFrame) -> DataFrame:
    lines = texts.select("id", "h", F.posexplode(F.split("text", "\n")).alias("block_no", "block"))
    return lines.select("id", "h", "block_no", F.array_distinct(words_of(F.col("block"))).alias("words"))


def matches(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", wrapped: bool = False) -> DataFrame:
    """id, h (hash of the text), block_no, template, label, containment: every block and template that meet the threshold; block_no is null for runs of words."""
    spark, sets = docs.sparkSession, [template_words(t) for t in templates]
    vocabulary = sorted(set().union(*sets))
    texts = save(promising(docs, templates, threshold, id_col, text_col), "promising")
    found = blocks(texts)
    probes = found.select("id", "h", "block_no", "words", F.explode("words").alias("word"))
    known = F.broadcast(spark.createDataFrame([(w,) for w in vocabulary], "word string"))
    counts = {r["word"]: r["n"] for r in probes.join(known, "word").groupBy("word").agg(F.count("*").alias("n")).collect()}  # one number for each word of a template
    vocabulary.sort(key=lambda w: (counts.get(w, 0), w))
    place = {w: i for i, w in enumerate(vocabulary)}
    rows = []
    for no, (template, words) in enumerate(zip(templates, sets)):
        words = sorted(words, key=place.get)
        need = needed(words, threshold)
        rows += [(w, no, template.label, words, need, i, words[:i], vocabulary[: place[w]]) for i, w in enumerate(words[: len(words) - need + 1])]
    index = F.broadcast(spark.createDataFrame(rows, "word string, template int, label string, of_template array<string>, need int, at int, sooner array<string>, rarer array<string>"))
    common = lambda other: F.size(F.array_intersect("words", other))
    pairs = probes.join(index, "word").where(common("sooner") == 0)  # the first common word alone speaks for the pair
    own, rank = common(F.array(*map(F.lit, vocabulary))), common("rarer")
    pairs = pairs.where((own >= F.col("need")) & (1 + F.least(F.size("of_template") - F.col("at") - 1, own - rank - 1) >= F.col("need")))
    held = pairs.withColumn("shared", common("of_template")).where("shared >= need")
    found = held.select("id", "h", "block_no", "template", "label", (F.col("shared") / F.size("of_template")).alias("containment"))
    return found.unionByName(runs(texts, templates, threshold, counts)) if wrapped else found


def runs(texts: DataFrame, templates: tuple[Template, ...], threshold: float, counts: dict[str, int]) -> DataFrame:
    """The columns of ``matches`` for runs of words in ``promising`` texts of several lines, a row for each word that led to one. ``counts``: how frequent words are."""
    rows = []
    for no, t in enumerate(templates):
        words, n = sorted(template_words(t), key=lambda w: (len(w) < 4, counts.get(w, 0), w)), len(re.findall(WORD, t.text.lower()))
        need = len(words) if len(words) <= SHORT else needed(words, threshold)
        rows += [(w, no, t.label, words, list(t.must), need, n + n // 4) for w in words[: len(words) - need + 1]]
    leads, reach = sorted({r[0] for r in rows}), max((r[-1] for r in rows), default=1)
    index = F.broadcast(texts.sparkSession.createDataFrame(rows, "word string, template int, label string, of_template array<string>, must array<string>, need int, length int"))
    some = F.lit(False)
    for w in leads:
        some = some | F.contains("text", F.lit(w))
    texts = texts.where(F.contains("text", F.lit("\n")) & some).select("id", "h", words_of(F.col("text")).alias("words"))
    led = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("i"))), lambda x: x["word"].isin(leads))
    around = F.transform(led, lambda x: F.struct(x["word"].alias("word"), F.slice("words", F.greatest(x["i"] - reach + 2, F.lit(1)), 2 * reach - 1).alias("near")))
    spots = texts.select("id", "h", F.explode(around).alias("spot")).select("id", "h", "spot.word", "spot.near")
    both = lambda words: F.when(F.size(F.array_intersect(words, "must")) == F.size("must"), F.size(F.array_intersect(words, "of_template"))).otherwise(0)
    held = spots.join(index, "word").where(both(F.col("near")) >= F.col("need"))
    held = held.withColumn("shared", F.array_max(F.transform(F.sequence(F.lit(1), F.size("near")), lambda k: both(F.slice("near", k, F.col("length")))))).where("shared >= need")
    return held.select("id", "h", F.lit(None).cast("int").alias("block_no"), "template", "label", (F.col("shared") / F.size("of_template")).alias("containment"))


def phrase_places(words: F.Column, phrase: str) -> F.Column:
    """Every index where the words of ``phrase`` stand consecutively."""
    parts = phrase.split(" ")

    def here(i):
        ok = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            ok = ok & (F.get(words, i + k) == part)
        return ok

    return F.when(F.size(words) >= len(parts), F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), here)).otherwise(F.array().cast("array<int>"))


def phrases(docs: DataFrame, wanted: tuple[tuple[str, str], ...] = PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, h, n_words, places (of all phrases), base (their labels). Word lists are searched only in texts that contain the longest word of a phrase."""
    rows = id_and_text(docs, id_col, text_col).select("id", F.xxhash64("text").alias("h"), folded(F.col("text")).alias("text"))
    rows = rows.withColumn("words", words_of(F.col("text")))
    none = F.array().cast("array<int>")
    gated = [F.when(F.contains("text", F.lit(max(p.split(" "), key=len))), phrase_places(F.col("words"), p)).otherwise(none) for p, _ in wanted]
    rows = rows.select("id", "h", F.size("words").cast("bigint").alias("n_words"), F.array(*gated).alias("by_phrase"))
    labels = F.array(*[F.when(F.size(F.get("by_phrase", F.lit(i))) > 0, F.lit(label)) for i, (_, label) in enumerate(wanted)])
    return rows.select("id", "h", "n_words", F.flatten("by_phrase").alias("places"), F.array_sort(F.array_distinct(F.array_compact(labels))).alias("base"))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, threshold: float = 0.8, wanted: tuple[tuple[str, str], ...] = PHRASES, id_col: str = "doc_id", text_col: str = "text", wrapped: bool = False) -> DataFrame:
    """One row for each document: n_words, n_base, first_word, last_word, base, labels (phrases' and templates'), score."""
    held = matches(docs, templates, threshold, id_col, text_col, wrapped).groupBy("id", "h").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    out = phrases(docs, wanted, id_col, text_col).alias("p").join(held.alias("m"), F.col("p.id").eqNullSafe(F.col("m.id")) & (F.col("p.h") == F.col("m.h")), "left")
    more = F.coalesce("more", F.array().cast("array<string>"))
    return out.select(
        F.col("p.id").alias(id_col), "n_words", F.size("places").cast("bigint").alias("n_base"), F.array_min("places").cast("bigint").alias("first_word"), F.array_max("places").cast("bigint").alias("last_word"),
        "base", F.array_sort(F.array_distinct(F.concat("base", more))).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))
