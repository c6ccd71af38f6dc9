"""Licence scans: lines compared with licence notices by the Dice coefficient of word bigrams.

A line and a template are normalised (A-Z lower-cased, everything but letters and digits of
ASCII a blank) and become sets of word bigrams. A Dice coefficient of at least ``least``
bounds the sizes: the smaller set has at least least / (2 - least) times the larger, so only
templates within these bounds are compared. The same bound says how many bigrams a line must
share with a template, hence a few bigrams of which every match holds one; a unit without any
of them needs no comparison at all. The result is one projection of built-in functions without a shuffle.

Every line of a text is a unit, and so is the whole text. Defined cases: null and blank texts
match nothing; a line of one word has no bigram; of equally close templates the first by name
counts; repeated rows are scanned each; columns of the input that carry an output's name are
replaced. Templates are a parameter and become part of the plan, so keep them to some hundreds.

``scan`` compares lines and whole texts, ``notices`` finds a notice anywhere: wrapped over lines
or inside a longer line. Its units are runs of consecutive bigrams of the text, across line
feeds, of every length that the size bound allows a template. A run whose ends are not in the
template is never closer than the run without them, so only runs between two bigrams of the
template are compared, and only where enough of those lie together. Of runs that share a bigram
the closest stays (then the one that shares most, the first, the shortest, the first name).
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let

LEAST = (7, 10)  # the least coefficient, as a fraction


class Template(NamedTuple):
    name: str
    text: str

    def bigrams(self) -> list[str]:
        words = re.findall("[a-z0-9]+", self.text.lower())
        return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


# Notices in use, by SPDX name.
TEMPLATES = tuple(
    Template(name, text)
    for name, text in (
        ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
        ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
        (
            "Apache-2.0",
            'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        ),
        (
            "BSD",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        ),
        ("CC-BY-4.0", "Licensed under CC BY 4.0."),
        ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
        ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
        ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
        ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
        ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
        (
            "CC0-1.0",
            "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        ),
        ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
        ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
        (
            "GPL-3.0",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        ),
        (
            "ISC",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        ),
        ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
        ("MIT", "Released under the MIT License."),
        ("MIT", "This project is licensed under the MIT License."),
        (
            "MIT",
            'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.',
        ),
        ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
        ("Proprietary", "All rights reserved."),
        ("Unlicense", "This is free and unencumbered software released into the public domain."),
    )
)


def anchor_bigrams(templates: Sequence[Template], least: tuple[int, int] = LEAST) -> list[str]:
    """Bigrams of which every matching unit holds at least one.

    A match shares at least ``least / (2 - least)`` of a template's bigrams, so it shares one of any
    choice of the remaining number plus one. Those with the longest words are chosen, as the
    rarest.
    """
    p, q = least
    chosen = set()
    for t in templates:
        grams = sorted(t.bigrams(), key=lambda g: (-len(g), g))
        shared = math.ceil(p * len(grams) / (2 * q - p))
        chosen.update(grams[: len(grams) - shared + 1])
    return sorted(chosen)


def _bigrams(line: Column) -> Column:
    words = F.array_remove(F.split(ascii_lower(line), "[^a-z0-9]+"), "")

    def pairs(w: Column) -> Column:
        some = F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda k: F.concat_ws(" ", F.get(w, k), F.get(w, k + 1)))
        return F.when(F.size(w) > 1, F.array_distinct(some)).otherwise(F.array().cast("array<string>"))

    return let(words, pairs)


def scan(
    docs: DataFrame, text_col: str = "text", templates: Sequence[Template] = TEMPLATES, least: tuple[int, int] = LEAST
) -> DataFrame:
    """``docs`` with ``matches``: for every matching unit its line number (0 is the whole text),
    licence, shared bigrams, and the sizes of both sets; and with ``licences``, their names."""
    p, q = least
    text = F.coalesce(F.col(text_col), F.lit(""))
    anchors = "|".join(g.replace(" ", "[^a-z0-9]+") for g in anchor_bigrams(templates, least))
    hint = rf"(?i)(?<![a-z0-9])(?:{anchors})(?![a-z0-9])"
    table = F.array(
        *[
            F.struct(F.lit(t.name).alias("name"), F.array(*map(F.lit, t.bigrams())).alias("grams"))
            for t in sorted(templates, key=lambda t: (t.name, t.text))
            if t.bigrams()
        ]
    )

    def closest(unit: Column) -> Column:
        """The best template of a unit: by coefficient, then by name; null if none is close enough."""

        def compared(grams: Column) -> Column:
            n = F.size(grams)
            bounded = F.filter(
                table,
                lambda t: ((2 * q - p) * F.least(n, F.size(t["grams"])) >= p * F.greatest(n, F.size(t["grams"]))) & (n > 0),
            )
            scored = F.transform(
                bounded,
                lambda t: F.struct(
                    t["name"].alias("licence"),
                    F.size(F.array_intersect(grams, t["grams"])).alias("shared"),
                    n.alias("size"),
                    F.size(t["grams"]).alias("template_size"),
                ),
            )
            close = F.filter(scored, lambda s: 2 * q * s["shared"] >= p * (s["size"] + s["template_size"]))
            dice = lambda s: s["shared"] / (s["size"] + s["template_size"])
            order = lambda a, b: F.when(dice(a) > dice(b), -1).when(dice(a) < dice(b), 1).otherwise(
                F.when(a["licence"] < b["licence"], -1).when(a["licence"] > b["licence"], 1).otherwise(0)
            )
            best = F.get(F.array_sort(close, order), F.lit(0))
            return F.when(
                best.isNotNull(),
                F.struct(unit["line"].alias("line"), *[best[c].alias(c) for c in ("licence", "shared", "size", "template_size")]),
            )

        return let(_bigrams(unit["text"]), compared)

    lines = F.transform(F.split(text, "\n"), lambda t, k: F.struct((k + 1).alias("line"), t.alias("text")))
    hinted = F.filter(lines, lambda u: u["text"].rlike(hint))
    # A text of one line is not compared twice.
    whole = F.when(F.contains(text, F.lit("\n")), F.array(F.struct(F.lit(0).alias("line"), text.alias("text"))))
    units = F.concat(hinted, F.coalesce(whole, F.array().cast("array<struct<line:int,text:string>>")))
    matches = F.when(text.rlike(hint), F.array_compact(F.transform(units, closest))).otherwise(
        F.array().cast("array<struct<line:int,licence:string,shared:int,size:int,template_size:int>>")
    )
    return docs.withColumn("matches", matches).withColumn(
        "licences", F.sort_array(F.array_distinct(F.transform("matches", lambda m: m["licence"])))
    )


def notices(
    docs: DataFrame, text_col: str = "text", templates: Sequence[Template] = TEMPLATES, least: tuple[int, int] = LEAST
) -> DataFrame:
    """``docs`` with ``notices``: for every licence notice in the text, by place, the number of its
    first word and of its words, licence, shared bigrams, and the sizes of both sets."""
    p, q = least
    kinds = sorted((t for t in templates if t.bigrams()), key=lambda t: (t.name, t.text))
    anchors = "|".join(g.replace(" ", "[^a-z0-9]+") for g in anchor_bigrams(templates, least))
    hint = rf"(?i)(?<![a-z0-9])(?:{anchors})(?![a-z0-9])"
    known = sorted({g for t in kinds for g in t.bigrams()})
    table = F.array(
        *[
            F.struct(
                F.lit(t.name).alias("name"),
                F.array(*map(F.lit, grams)).alias("grams"),
                F.lit(math.ceil(p * len(grams) / (2 * q - p))).alias("least"),
                F.lit((2 * q - p) * len(grams) // p).alias("reach"),
            )
            for t in kinds
            for grams in [t.bigrams()]
        ]
    )
    kind = "array<struct<far:double,less:int,first:int,last:int,licence:string,shared:int,size:int,template_size:int>>"

    def span(low: Column, high: Column) -> Column:
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    def runs(grams: Column, hits: Column, t: Column) -> Column:
        """All runs close to one template; ``hits`` are the places of its bigrams."""
        at = lambda k: F.get(hits, k)
        n, b = F.size(hits), F.size(t["grams"])
        starts = F.filter(span(F.lit(0), n - t["least"]), lambda i: at(i + t["least"] - 1) - at(i) < t["reach"])

        def from_start(i: Column) -> Column:
            ends = F.filter(span(i + t["least"] - 1, F.least(n, i + t["reach"]) - 1), lambda e: at(e) - at(i) < t["reach"])

            def run(e: Column) -> Column:
                def compared(own: Column) -> Column:
                    shared, size = F.size(F.array_intersect(own, t["grams"])), F.size(own)
                    return F.struct(
                        (-shared / (size + b)).alias("far"),
                        (-shared).alias("less"),
                        at(i).alias("first"),
                        at(e).alias("last"),
                        t["name"].alias("licence"),
                        shared.alias("shared"),
                        size.alias("size"),
                        b.alias("template_size"),
                    )

                return let(F.array_distinct(F.slice(grams, at(i) + 1, at(e) - at(i) + 1)), compared)

            return F.filter(F.transform(ends, run), lambda s: 2 * q * s["shared"] >= p * (s["size"] + s["template_size"]))

        return F.flatten(F.transform(starts, from_start))

    def found(grams: Column) -> Column:
        places = F.filter(F.transform(grams, lambda g, k: F.struct(k.alias("at"), g.alias("gram"))), lambda s: s["gram"].isin(known))

        def of(t: Column, seen: Column) -> Column:
            own = F.transform(F.filter(seen, lambda s: F.array_contains(t["grams"], s["gram"])), lambda s: s["at"])
            return let(own, lambda hits: runs(grams, hits, t))

        return F.flatten(let(places, lambda seen: F.transform(table, lambda t: of(t, seen))))

    def apart(close: Column) -> Column:
        """The runs that share no bigram with a closer one that stays."""
        meets = lambda kept, s: F.exists(kept, lambda k: (k["first"] <= s["last"]) & (k["last"] >= s["first"]))
        return F.aggregate(
            F.sort_array(close), F.array().cast(kind), lambda kept, s: F.when(meets(kept, s), kept).otherwise(F.concat(kept, F.array(s)).cast(kind))
        )

    words = F.array_remove(F.split(ascii_lower(F.col(text_col)), "[^a-z0-9]+"), "")
    pairs = lambda w: F.transform(span(F.lit(0), F.size(w) - 2), lambda k: F.concat_ws(" ", F.get(w, k), F.get(w, k + 1)))
    shown = F.transform(
        apart(let(let(words, pairs), found).cast(kind)),
        lambda s: F.struct(
            (s["first"] + 1).alias("first_word"),
            (s["last"] - s["first"] + 2).alias("words"),
            *[s[c].alias(c) for c in ("licence", "shared", "size", "template_size")],
        ),
    )
    none = F.array().cast("array<struct<first_word:int,words:int,licence:string,shared:int,size:int,template_size:int>>")
    return docs.withColumn("notices", F.when(F.col(text_col).rlike(hint), F.sort_array(shown)).otherwise(none))
