"""License scans with DataFrame functions alone.

Two layers: places where a known phrase's words stand one after another, and an exact set-similarity join that finds
every block (a line, or a run of lines over which a notice may be wrapped) that holds at least a given share of a template's distinct words. The join orders words by how many
blocks hold them, posts each template under its rarest words only (prefix filter), and drops pairs that the block's
number of words (length filter) or the matched word's place in both orders (positional filter) rules out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The phrases of the contract and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


@dataclass(frozen=True)
class Template:
    name: str
    label: str
    text: str

    @property
    def words(self) -> list[str]:
        return sorted(set(self.text.split()))


#: Lines of at most WRAPPED characters are held against the templates with the RUN - 1 lines after them too.
WRAPPED, RUN = 100, 6

#: Opening notices of public licenses, as words.
TEMPLATES = (
    Template("mit-notice", "mit", "released under the mit license"),
    Template("mit-grant", "mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    Template("apache-notice", "apache-2", "licensed under the apache license version 2 0"),
    Template("apache-terms", "apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("cc-by-nc-notice", "cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-nc-name", "cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    Template("gpl-notice", "gpl-3", "this work is licensed under the gnu general public license version 3"),
    Template("gpl-terms", "gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    Template("bsd-terms", "bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("reserved", "all-rights-reserved", "all rights reserved"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAPS = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"
_ANY_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _lowered(text: str) -> Column:
    return F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER)


def _spaces(c: Column) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))).cast("long")


def scan_phrases(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with n_words, n_base, first_word, last_word and _base (an array of labels). Row by row."""
    words = F.trim(F.regexp_replace(_lowered(text), _ANY_GAP, " "))
    rows = docs.select(*[F.col(c) for c in docs.columns if c != text], words.alias("_words"))
    padded = F.concat(F.lit(" "), F.col("_words"), F.lit(" "))
    any_phrase = "(?:" + "|".join(PHRASES) + ")(?= )"
    held = [F.contains(padded, F.lit(f" {p} ")) for p in PHRASES]
    some = held[0]
    for one in held[1:]:
        some = some | one
    labels = F.filter(F.array(*[F.when(h, F.lit(label)) for h, label in zip(held, PHRASES.values(), strict=True)]), lambda x: x.isNotNull())
    before_last = F.regexp_extract(padded, f"^(.*) {any_phrase}", 1)
    pieces = F.split(padded, f" {any_phrase}")
    return rows.select(
        *[c for c in rows.columns if c != "_words"],
        F.when(F.col("_words") == "", F.lit(0)).otherwise(_spaces(F.col("_words")) + 1).cast("long").alias("n_words"),
        F.when(some, F.size(pieces) - 1).otherwise(0).cast("long").alias("n_base"),
        F.when(some, _spaces(pieces[0])).alias("first_word"),
        F.when(some, _spaces(before_last)).alias("last_word"),
        F.when(some, labels).otherwise(F.array().cast("array<string>")).alias("_base"),
    )


def blocks(docs: DataFrame, vocabulary: list[str], key: str = "doc_id", text: str = "text", least: int = 1) -> DataFrame:
    """(key, n_words, held): each line's number of distinct words, and which words of the vocabulary it holds. Lines that
    hold fewer than `least` of them are left out."""
    lines = docs.select(F.col(key).alias("key"), F.explode(F.split(F.regexp_replace(_lowered(text), _GAPS, " "), "\n")).alias("line"))
    words = F.array_remove(F.split("line", " "), "")
    lines = lines.select("key", words.alias("words")).filter(F.size("words") >= least)
    held = lines.select("key", F.array_intersect("words", F.lit(vocabulary)).alias("held"), "words").filter(F.size("held") >= least)
    return held.select("key", F.size(F.array_distinct("words")).alias("n_words"), "held")


def wrapped_blocks(docs: DataFrame, vocabulary: list[str], key: str = "doc_id", text: str = "text", least: int = 1) -> DataFrame:
    """(key, n_words, held) of each run of RUN consecutive lines, fewer at the text's end; lines longer than WRAPPED add no word. n_words
    counts the vocabulary's words, as the others match nothing. Runs of fewer than `least` of them, or of one line's alone, are left out."""
    lines = F.split(F.regexp_replace(_lowered(text), _GAPS, " "), "\n")
    of_line = lambda x: F.when(F.length(x) <= WRAPPED, F.array_intersect(F.split(x, " "), F.lit(vocabulary))).otherwise(F.array().cast("array<string>"))
    rows = docs.filter(F.contains(F.col(text), F.lit("\n"))).select(F.col(key).alias("key"), F.explode(F.array(F.transform(lines, of_line))).alias("lines"))  # a generator, so that the lines are made once
    run = F.transform(F.sequence(F.lit(1), F.size("lines") - 1), lambda i: F.struct(F.get("lines", i - 1).alias("one"), F.array_distinct(F.flatten(F.slice("lines", i, RUN))).alias("held")))
    runs = rows.select("key", F.explode(run).alias("r")).select("key", "r.*").filter((F.size("held") >= least) & (F.size("held") > F.size("one")))
    return runs.select("key", F.size("held").alias("n_words"), "held")


def containment_join(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, template, label, containment) for every block and template with |block ∩ template| >= threshold * |template|,
    over distinct words. Blocks are lines and runs of wrapped lines; each stands once for each template it meets; null and empty texts meet none.

    The templates are a fixed list, so their words, posted prefixes and order are bounded and broadcast.
    """
    spark = docs.sparkSession
    vocabulary = sorted({w for t in templates for w in t.words})
    need = {t.name: math.ceil(threshold * len(t.words) - 1e-9) for t in templates}
    least = min(need.values())
    common = blocks(docs, vocabulary, key, text).select(F.explode("held").alias("word")).groupBy("word").count()
    counts = {r["word"]: r["count"] for r in common.collect()}  # at most a row for each word of the templates
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    posted = []
    for t in templates:
        by_rank = sorted(t.words, key=rank.get)
        for place, word in enumerate(by_rank[: len(by_rank) - need[t.name] + 1]):
            posted.append((word, t.name, t.label, place, len(by_rank), need[t.name], by_rank))
    index = spark.createDataFrame(posted, "word string, template string, label string, place int, size int, need int, words array<string>")
    # Of a line's words the vocabulary's alone can match, so `held` in global order is its side of the join.
    sides = blocks(docs, order, key, text, least).unionByName(wrapped_blocks(docs, order, key, text, least))
    in_order = F.array_intersect(F.lit(order), F.col("held"))
    probes = sides.select("key", "n_words", in_order.alias("held")).select("key", "n_words", "held", F.posexplode("held").alias("at", "word"))
    pairs = probes.join(F.broadcast(index), "word")
    pairs = pairs.filter((F.col("n_words") >= F.col("need")) & (F.size("held") >= F.col("need")))
    rest = F.least(F.col("size") - F.col("place"), F.size("held") - F.col("at"))
    pairs = pairs.withColumn("_earlier", F.size(F.array_intersect(F.slice("held", F.lit(1), F.col("at")), F.slice("words", F.lit(1), F.col("place")))))
    pairs = pairs.filter((F.col("_earlier") == 0) & (rest >= F.col("need")))  # only the first shared word of a pair goes on
    overlap = F.size(F.array_intersect("held", "words"))
    return pairs.withColumn("_overlap", overlap).filter(F.col("_overlap") >= F.col("need")).select(
        "key", "template", "label", (F.col("_overlap") / F.col("size")).alias("containment"),
    )


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is 1 where a phrase stands in the text, else the largest containment of a template that meets the threshold,
    else 0. A null text counts as empty. Rows that share a key share the labels that the join finds; a null key is a
    key like any other.
    """
    base = scan_phrases(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "text")
    found = containment_join(docs, templates, threshold, key, text).groupBy(F.col("key").alias("_key")).agg(
        F.collect_set("label").alias("_found"), F.max("containment").alias("_best"),
    )
    out = base.join(found, F.col("key").eqNullSafe(F.col("_key")), "left")
    joined = lambda labels: F.concat_ws(",", F.array_sort(labels))
    return out.select(
        F.col("key").alias(key), "n_words", "n_base", "first_word", "last_word", joined(F.col("_base")).alias("base_labels"),
        joined(F.array_union("_base", F.coalesce("_found", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"),
    )
