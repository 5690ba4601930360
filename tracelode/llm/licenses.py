"""License scan by a positional rare-token index, with DataFrame functions only.

Templates are word sequences. For each template the places of its rarest words (highest IDF
over the corpus) are its anchors. Where a file has a template's leading anchor, the rarest word
of its key phrases, the posting's place gives the start that it implies; the template's other
postings are intersected with the file's at that start, and starts on which enough anchors agree
are verified on the file's words. How many have to agree follows from IDF: a match of the
template's share can't have fewer, so none is lost. A template either has to stand in full (a
phrase), or in part, by IDF weight, with its mandatory key phrases in full.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """words: lower case, separated by blanks. keys: phrases of it that must stand in full; none: all of it."""

    label: str
    words: str
    base: bool = False
    keys: tuple[str, ...] = ()
    share: float = 0.8


# The phrases every caller gets, and openings of well-known licence notices.
TEMPLATES = (
    Template("mit", "under the mit license", base=True),
    Template("apache-2", "apache license version 2", base=True),
    Template("cc-by-nc", "cc by nc", base=True),
    Template("gpl-3", "gnu general public license version 3"),
    Template("gpl-2", "gnu general public license version 2"),
    Template("lgpl-3", "gnu lesser general public license version 3"),
    Template("agpl-3", "gnu affero general public license version 3"),
    Template("mpl-2", "mozilla public license version 2"),
    Template("cc-by-sa", "cc by sa"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", keys=("permission is hereby granted free of charge",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", keys=("permission to use copy modify",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", keys=("redistribution and use in source and binary forms",)),
    Template("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at", keys=("in compliance with the license",)),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", keys=("free software", "gnu general public license")),
    Template("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", keys=("unencumbered software",)),
)
ANCHORS = 6
#: Starts are numbered k * SPAN + start; a text has fewer words.
SPAN = 1 << 40


def word_array(text: Column) -> Column:
    """Words of a text after A-Z are lower-cased: runs of letters, digits and non-ASCII characters."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, SEPARATORS), lambda w: w != "")


def document_frequencies(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> tuple[dict[str, int], int]:
    """In how many of all documents each template word stands, and the number of documents.

    One row for each task and one in the end, as wide as the templates' vocabulary, which bounds it.
    """
    vocabulary = sorted({w for t in templates for w in t.words.split()})
    found = docs.select(F.array_distinct(F.filter(word_array(F.col("text")), lambda w: w.isin(vocabulary))).alias("w"))
    row = found.agg(F.count("*").alias("n"), *(F.count_if(F.array_contains("w", w)).alias(f"w{i}") for i, w in enumerate(vocabulary))).first()
    return {w: row[f"w{i}"] for i, w in enumerate(vocabulary)}, row["n"]


def anchored(template: Template, idf: dict[str, float], anchors: int = ANCHORS) -> tuple[list[int], int]:
    """A template's anchor places, and how many of them stand in every match. The first stands in each.

    Half of the anchors are the rarest words of the key phrases, which no match lacks, the others
    the rarest words besides; ties go to the word, then the place. A match may lack words of
    1 - share of the template's weight, so as many of the others as the lightest of them fit into that.
    """
    words, must = template.words.split(), mandatory_places(template)
    rarest = sorted(range(len(words)), key=lambda i: (-idf[words[i]], words[i], i))
    sure = [i for i in rarest if i in must][: (anchors + 1) // 2]
    others = [i for i in rarest if i not in must][: anchors - len(sure)]
    spare, lacking = (1 - template.share) * sum(idf[w] for w in words) + 1e-9, 0
    for light in sorted(idf[words[i]] for i in others):
        spare -= light
        if spare < 0:
            break
        lacking += 1
    return sure + others, len(sure) + len(others) - lacking


def mandatory_places(template: Template) -> set[int]:
    """The places of the words that have to stand: of the key phrases, or of the whole template without any."""
    sequence = template.words.split()
    return {at + i for key in template.keys or (template.words,) for at in (key_place(sequence, key),) for i in range(len(key.split()))}


def key_place(sequence: list[str], key: str) -> int:
    part = key.split()
    return next(i for i in range(len(sequence)) if sequence[i : i + len(part)] == part)


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, anchors: int = ANCHORS) -> DataFrame:
    """For each document its words, the places of base phrases, labels and the best match's score.

    Takes columns doc_id and text; others are ignored, whatever their names. Null and empty
    texts have no words, no labels and score 0. Repeated rows and null ids each give a row; an
    empty table gives none. Places that overlap all count. The score is the greatest share of
    a template's IDF weight that stands in place, 0 without a match. The table is read twice:
    once for IDF, once to match. Ties of IDF go to the word first in code-point order.
    """
    df, n = document_frequencies(docs, templates)
    idf = {w: math.log((n + 1) / (k + 1)) + 1 for w, k in df.items()}
    postings: dict[str, list[tuple[int, int]]] = {}
    agreed: list[tuple[list[int], int]] = []
    words = F.col("_words")
    start_of = lambda c: F.pmod(c, F.lit(SPAN)).cast("int")
    template_of = lambda c: F.shiftright(c, 40).cast("int")
    word_at = lambda c, at: F.try_element_at(words, start_of(c) + F.lit(at + 1))
    for k, t in enumerate(templates):
        sequence = t.words.split()
        places, needed = anchored(t, idf, anchors)
        postings.setdefault(sequence[places[0]], []).append((k, places[0]))
        agreed.append((places, needed))

    def struct(k: int, at: int) -> Column:
        return F.struct(F.lit(k).alias("k"), F.lit(at).alias("at"))

    index = F.create_map(*(x for w, p in sorted(postings.items()) for x in (F.lit(w), F.array(*(struct(*y) for y in p)))))
    hits = F.filter(F.transform(words, lambda w, i: F.when(w.isin(sorted(postings)), F.struct(i.alias("i"), w.alias("w")))), lambda h: h.isNotNull())
    code = lambda h, p: p["k"].cast("long") * F.lit(SPAN) + (h["i"] - p["at"])
    starts = F.flatten(F.transform(F.col("_hits"), lambda h: F.transform(F.filter(F.element_at(index, h["w"]), lambda p: p["at"] <= h["i"]), lambda p: code(h, p))))

    def agrees(c: Column) -> Column:
        """Whether enough of the template's anchors stand at the places that the start implies."""
        out = F.lit(False)
        for k, (places, needed) in enumerate(agreed):
            sequence = templates[k].words.split()
            there = sum((F.coalesce((word_at(c, at) == sequence[at]).cast("int"), F.lit(0)) for at in places), F.lit(0))
            out = F.when(template_of(c) == k, there >= needed).otherwise(out)
        return out

    def verified(c: Column) -> Column:
        out = F.lit(None).cast("double")
        for k, t in enumerate(templates):
            sequence = t.words.split()
            stands = lambda part, at: F.slice(words, start_of(c) + F.lit(1 + at), len(part)) == F.array(*map(F.lit, part))
            if not t.keys:
                score = F.when(stands(sequence, 0), 1.0)
            else:
                total = sum(idf[w] for w in sequence)
                weight = sum((F.when(word_at(c, i) == w, idf[w]).otherwise(0.0) for i, w in enumerate(sequence)), F.lit(0.0)) / total
                mandatory = F.lit(True)
                for key in t.keys:
                    mandatory = mandatory & stands(key.split(), key_place(sequence, key))
                score = F.when(mandatory, F.when(weight >= t.share, weight))
            out = F.when(template_of(c) == k, score).otherwise(out)
        return F.struct(template_of(c).alias("k"), start_of(c).alias("start"), F.when(out > 1, 1.0).otherwise(out).alias("score"))

    matches = F.filter(F.transform(F.filter(F.array_distinct(F.col("_starts")), agrees), verified), lambda m: m["score"].isNotNull())
    label = F.array(*(F.lit(t.label) for t in templates))
    base_ids = [k for k, t in enumerate(templates) if t.base]
    named = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda m: F.element_at(label, m["k"] + 1)))), ",")
    base = F.filter(F.col("_matches"), lambda m: m["k"].isin(base_ids))
    ends = F.transform(base, lambda m: m["start"].cast("long"))
    none = F.array().cast("array<struct<k:int,start:int,score:double>>")
    rows = docs.select("doc_id", word_array(F.col("text")).alias("_words"))
    rows = rows.withColumn("_hits", hits).withColumn("_starts", starts)
    rows = rows.withColumn("_matches", F.when(F.size("_hits") > 0, matches).otherwise(none))
    return rows.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(ends).alias("first_word"),
        F.array_max(ends).alias("last_word"),
        named(base).alias("base_labels"),
        named(F.col("_matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("_matches", lambda m: m["score"])), F.lit(0.0)).alias("score"),
    )
