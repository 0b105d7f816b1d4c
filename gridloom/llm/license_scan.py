"""License scan: exact containment join of text blocks with notice templates, in DataFrame functions only.

A run is a stretch of consecutive words of a text, over line ends too, of at most |words of T| / threshold words, that
begins with a word of the template T. A run meets T if it holds need = ceil(threshold * |different words of T|) of its different
words; as a run is hardly longer than the template, words scattered over a long line or text don't count.

Blocks of twice the longest run, one starting at every run's length, hold each run whole. Which blocks can hold one is an
exact set-similarity join: all words of the templates are ordered by their frequency over all blocks, rarest first.
Candidates come from an equi join of the first |T| - need + 1 words of T with the first |B| - need + 1 template words of the
block B (prefix filter); blocks with fewer template words than any need fall out (length filter), and so do pairs whose
remaining words, counted from the matching positions, can't reach the need (positional filter). In the pairs that are left
every run is counted exactly.

Phrases (the base) are found word by word in the whole text. Defined results: a null text is empty, an empty text has
no words, no labels and score 0; texts of any length are read whole; repeated rows give equal rows; of runs that overlap
the fullest is the notice, of equals the first; only the id and the text are read, whatever other columns are called.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm import common

# Phrases with their labels, and notices with theirs.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OTHER_CASE = r"[\p{Lu}\p{Lt}\p{Nl}\p{So}&&[^\x00-\x7F]]"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain(text: Column) -> Column:
    """The words of a text, A-Z lower-cased, with one blank between.

    Where no other letter has a lower case, the faster F.lower does the same as translate.
    """
    low = F.when(text.rlike(_OTHER_CASE), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))
    return F.trim(F.regexp_replace(low, _GAP, " "))


def _ints(values: list[int]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def _list(words: list[str]) -> Column:
    return F.array(*(F.lit(w) for w in words))


def phrase_starts(words: Column, phrase: str) -> Column:
    """Word positions, from 0, at which the phrase stands."""
    parts = phrase.split()
    at = F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), lambda i: F.slice(words, i + 1, len(parts)) == _list(parts))
    return F.when(F.size(words) >= len(parts), at).otherwise(F.array().cast("array<int>"))


def base(docs: DataFrame, phrases: dict[str, str]) -> DataFrame:
    """docs (id, text) with key, n_words, starts (of all phrases) and base_labels."""
    norm = docs.select("id", common.row_key("id", "text").alias("key"), plain(F.col("text")).alias("_plain"))
    # a cheap test for the longest word of any phrase (a phrase of short words stands whole) leaves few texts to take apart
    anchors = {max(p.split(), key=len) if len(max(p.split(), key=len)) > 4 else p for p in phrases}
    maybe = F.lit(False)
    for anchor in sorted(anchors):
        maybe = maybe | F.col("_plain").contains(anchor)
    blanks = F.octet_length("_plain") - F.octet_length(F.replace("_plain", F.lit(" "), F.lit("")))
    norm = norm.select("id", "key", F.when(F.col("_plain") == "", F.lit(0)).otherwise(blanks + 1).cast("long").alias("n_words"), F.when(maybe, F.split("_plain", " ")).alias("_words"))
    found = {p: F.when(F.col("_words").isNotNull(), phrase_starts(F.col("_words"), p)).otherwise(F.array().cast("array<int>")) for p in phrases}
    norm = norm.select("id", "key", "n_words", *(x.alias(f"_p{k}") for k, x in enumerate(found.values())))
    labels = [F.when(F.size(f"_p{k}") > 0, F.lit(label)) for k, label in enumerate(phrases.values())]
    return norm.select(
        "id", "key", "n_words", F.array_sort(F.concat(*(f"_p{k}" for k in range(len(phrases))))).alias("starts"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))).alias("base_labels"),
    )


def _sets(templates: list[tuple[str, str]], threshold: float) -> tuple[list[tuple[int, str, list[str]]], dict[int, int], list[str]]:
    """The templates' word sets, the words each needs, and all words."""
    sets = [(k, label, sorted(set(text.split()))) for k, (label, text) in enumerate(templates)]
    need = {k: math.ceil(threshold * len(words) - 1e-9) for k, _, words in sets}
    return sets, need, sorted({w for _, _, words in sets for w in words})


def _met(blocks: DataFrame, carried: list[str], templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """(carried..., template, label, own, n, both): every block with carried columns and words (of templates, each once) that holds enough of a template's."""
    spark = blocks.sparkSession
    sets, need, vocabulary = _sets(templates, threshold)
    least = min(need.values())
    blocks = blocks.where(F.size("words") >= least)
    # the frequency of each template word over the blocks: at most as many rows as the templates have words
    seen = {r["word"]: r["count"] for r in blocks.select(F.explode("words").alias("word")).groupBy("word").count().collect()}
    order = sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for k, label, words in sets:
        ordered = sorted(words, key=rank.__getitem__)
        rows += [(k, label, w, i, len(words), need[k], ordered) for i, w in enumerate(ordered[: len(words) - need[k] + 1])]
    small = F.broadcast(spark.createDataFrame(rows, "template int, label string, token string, i int, n int, need int, own array<string>"))
    ordered = F.array_intersect(_list(order), F.col("words"))
    prefix = F.slice(F.col("ordered"), F.lit(1), F.size("ordered") - least + 1)
    tokens = blocks.withColumn("ordered", ordered).select(*carried, "ordered", F.posexplode(prefix).alias("j", "token"))
    pairs = tokens.join(small, "token").where((F.size("ordered") >= F.col("need")) & (F.least(F.col("n") - F.col("i"), F.size("ordered") - F.col("j")) >= F.col("need")))
    counted = pairs.withColumn("both", F.size(F.array_intersect("ordered", "own"))).where("both >= need")
    return counted.select(*carried, "template", "label", "own", "n", "both").distinct()


def runs(templates: list[tuple[str, str]], threshold: float) -> list[int]:
    """The words that a run of each template has at most."""
    return [math.ceil(len(text.split()) / threshold - 1e-9) for _, text in templates]


def containment(docs: DataFrame, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """(key, word, template, label, containment): every notice of docs (id, words array<string>), by its first word (from 0)."""
    sets, need, vocabulary = _sets(templates, threshold)
    reach = runs(templates, threshold)
    step = max(reach)
    texts = docs.select("key", "words").dropDuplicates(["key"]).where(F.size("words") > 0)
    blocks = texts.select("key", "words", F.explode(F.sequence(F.lit(0), F.size("words") - 1, F.lit(step))).alias("at")).select("key", "at", F.slice("words", F.col("at") + 1, F.lit(2 * step)).alias("run"))
    blocks = blocks.withColumn("words", F.array_intersect("run", _list(vocabulary)))
    found = _met(blocks, ["key", "at", "run"], templates, threshold).withColumns({"reach": F.element_at(_ints(reach), F.col("template") + 1), "need": F.element_at(_ints([need[k] for k in range(len(sets))]), F.col("template") + 1)})
    # runs that begin in the block's first half; the next block has the others
    starts = F.filter(F.sequence(F.lit(0), F.least(F.lit(step), F.size("run")) - 1), lambda i: F.array_contains("own", F.get("run", i)))
    met = F.transform(starts, lambda i: F.struct(F.size(F.array_intersect(F.slice("run", i + 1, F.col("reach")), F.col("own"))).alias("both"), i.alias("i")))
    found = found.select("key", "template", "label", "n", "at", F.explode(F.filter(met, lambda r: r["both"] >= F.col("need"))).alias("r"))
    found = found.select("key", "template", "label", "n", "r.both", (F.col("at") + F.col("r.i")).alias("word"))
    around = Window.partitionBy("key", "template").orderBy("word").rangeBetween(-step, step)
    one = F.struct(F.col("both"), -F.col("word"))
    return found.withColumn("most", F.max(one).over(around)).where(F.col("most") == one).select("key", "word", "template", "label", (F.col("both") / F.col("n")).alias("containment"))


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, starts, base_labels, labels, score, notices) for every row.

    score is 1 if a phrase stands in the text, else the largest containment found, else 0; notices are the (word,
    template, containment) found.
    """
    slim = docs.select(F.col(id_col).alias("id"), common.text_of(text_col).alias("text"))
    templates = templates or TEMPLATES
    # only texts that hold enough words of a template at all can hold a run that does
    sets, need, vocabulary = _sets(templates, threshold)
    split = slim.select(common.row_key("id", "text").alias("key"), F.split(plain(F.col("text")), " ").alias("words"))
    enough = lambda some: F.exists(F.array(*(F.size(F.array_intersect(some, _list(words))) >= need[k] for k, _, words in sets)), lambda x: x)
    # as the argument of a function the texts' template words are found once, though many conditions use them
    one = F.transform(F.array(F.array_intersect("words", _list(vocabulary))), enough)
    few = common.durable(split.where(F.element_at(one, 1)))
    found = containment(few, templates, threshold).groupBy("key").agg(F.array_sort(F.collect_set("label")).alias("more"), F.max("containment").alias("most"), F.array_sort(F.collect_list(F.struct("word", "template", "containment"))).alias("notices"))
    out = base(slim, phrases or PHRASES).join(found, "key", "left")
    return out.select(
        F.col("id").alias(id_col), "n_words", "starts", "base_labels",
        F.array_sort(F.array_union("base_labels", F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size("base_labels") > 0, 1.0).otherwise(F.coalesce("most", F.lit(0.0))).alias("score"), "notices",
    )
