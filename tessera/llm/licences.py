"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

The classifier is a sparse logistic regression over a paragraph's word n-grams (one to three words), one against the
rest for each licence family. It is trained here, on paragraphs made from the templates and on ordinary ones; training is
a fixed amount of work whatever the corpus. Its scores are calibrated on paragraphs that training leaves out, and what
stays below the threshold is `unknown`. Scans use DataFrame functions only: n-grams are exploded and joined with the
table of weights and with that of the templates' n-grams, both of a size that the model fixes.
"""

from __future__ import annotations

import json
import math
import random
from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Short notices of each family (fixed values).
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "This software is distributed under the terms of the Apache License 2.0.",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Released under the GPL version 2.",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Released under the LGPL version 3.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Released under the Mozilla Public License 2.0.",
    ],
}
#: Ordinary paragraphs that share words with licences (fixed values).
ORDINARY = [
    "The driver lost his license after the accident.",
    "A license to fish is issued by the local authority each year.",
    "She was granted permission to use the building free of charge.",
    "The general public was invited to the opening of the new library.",
    "The software was released in version 3 and distributed to schools.",
    "All rights of the tenants are protected under the terms of the contract.",
    "Attribution of the painting to the master remains disputed.",
    "He works for a public foundation that gives free courses.",
    "The conditions were met and the copy was sent to the office.",
    "The bar obtained a liquor license under the new law.",
    "Creative people and common sense make good work.",
    "The source of the river was found in binary star charts of old.",
    "Ordinary text goes on about the weather and the sea.",
    "The committee published the terms of the agreement in the file.",
]
#: Notices that are of none of the families (fixed values). The model learns from every second one, and is calibrated on the others.
NEAR_MISSES = [
    "Licensed under the Eclipse Public License, Version 2.0.",
    "Released under the ISC License.",
    "Licensed under the zlib license.",
    "Released under the Artistic License 2.0.",
    "This software is distributed under the terms of the Boost Software License, Version 1.0.",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "This is free and unencumbered software released into the public domain.",
    "Permission is granted to copy and distribute verbatim copies of this document, but changing it is not allowed.",
    "Use of this software is subject to the terms of the enclosed end user agreement.",
    "Redistribution of this file in any form is not permitted without prior written permission.",
    "This program is licensed under the Common Development and Distribution License, version 1.0.",
    "Licensed under the Open Software License 3.0; see the file for the terms.",
    "This Source Code Form is governed by the license of your order.",
    "All rights reserved. No part of this work may be copied without permission.",
]
NONE, UNKNOWN = "none", "unknown"
GRAM = 3
#: Made paragraphs of each family and of ordinary text, and the words that they are padded with.
EXAMPLES, PADDING = 160, 14
EPOCHS, RATE, SPARSE = 30, 0.4, 0.002
#: Share of the made paragraphs of each other family, and of each wording left out, that may pass the threshold, and the template's n-grams a prediction needs.
FALSE_PASS, CONFIRMED = 0.01, 0.6
SEED = 5
#: Lines with one of these words give a row even if they aren't confirmed.
ANCHOR = r"(?i)licen[sc]e|permission|redistribution|public\s+licen|\bgpl\b|\blgpl\b|\bcc\s+by|mozilla|apache"
#: What is in every text that ANCHOR matches, in lower case.
ANCHORED = ["licen", "permission", "redistribution", "gpl", "cc", "mozilla", "apache"]
#: Words that ordinary texts often have.
COMMON = frozenset("following general international program provided public source subject under version work".split())
#: Words are runs of letters and digits, with inner dots and hyphens.
WORD = r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"


def words(text: str) -> list[str]:
    import regex

    return regex.findall(WORD, text.lower())


def grams(found: list[str]) -> list[str]:
    return [" ".join(found[k : k + n]) for n in range(1, GRAM + 1) for k in range(len(found) - n + 1)]


def made(rng: random.Random, text: str, filler: list[str]) -> list[str]:
    """A variant of a paragraph: a few words lost or changed, others around it."""
    found = [w for w in words(text) if rng.random() > 0.05]
    found = [rng.choice(filler) if rng.random() < 0.03 else w for w in found]
    if rng.random() < 0.4:
        found = [rng.choice(filler) for _ in range(rng.randint(1, PADDING))] + found
    if rng.random() < 0.4:
        found += [rng.choice(filler) for _ in range(rng.randint(1, PADDING))]
    return found


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


@cache
def model() -> tuple[dict[str, dict[str, float]], dict[str, float], dict[str, float]]:
    """(family -> n-gram -> weight, family -> intercept, family -> threshold), by stochastic gradient descent with decay towards zero."""
    rng = random.Random(SEED)
    filler = sorted({w for t in ORDINARY for w in words(t)})
    examples = [(family, made(rng, rng.choice(texts), filler)) for family, texts in TEMPLATES.items() for _ in range(EXAMPLES)]
    examples += [(NONE, made(rng, rng.choice(ORDINARY), filler)) for _ in range(EXAMPLES * 3)]
    examples += [(NONE, made(rng, text, filler)) for text in NEAR_MISSES[::2] for _ in range(EXAMPLES // 4)]
    rng.shuffle(examples)
    data = [(family, sorted(set(grams(found)))) for family, found in examples]
    apart, train = data[: len(data) // 5], data[len(data) // 5 :]
    # Wordings that training never sees: the calibration is to hold for notices of unknown kinds.
    apart += [(text, sorted(set(grams(made(rng, text, filler))))) for text in NEAR_MISSES[1::2] for _ in range(EXAMPLES // 4)]
    weights, intercepts, thresholds = {}, {}, {}
    for family in sorted(TEMPLATES):
        own: dict[str, float] = {}
        intercept = 0.0
        for epoch in range(EPOCHS):
            rate = RATE / (1 + epoch / 3)
            for label, features in train:
                scale = 1 / math.sqrt(len(features) or 1)
                error = (label == family) - sigmoid(intercept + scale * sum(own.get(g, 0.0) for g in features))
                if abs(error) < 0.01:
                    continue
                intercept += rate * error * 0.1
                for g in features:
                    own[g] = own.get(g, 0.0) + rate * error * scale
            own = {g: w - math.copysign(SPARSE * rate, w) for g, w in own.items() if abs(w) > SPARSE * rate}
        own = {g: round(w, 6) for g, w in own.items() if abs(w) >= 0.02}
        weights[family], intercepts[family] = own, round(intercept, 6)
        thresholds[family] = 0.0
        for label in sorted({label for label, _ in apart} - {family}):
            others = sorted((score(own, intercept, f) for kind, f in apart if kind == label), reverse=True)
            thresholds[family] = max(thresholds[family], round(others[int(len(others) * FALSE_PASS)], 6))
    return weights, intercepts, thresholds


def score(own: dict[str, float], intercept: float, features: list[str]) -> float:
    return sigmoid(intercept + sum(own.get(g, 0.0) for g in features) / math.sqrt(len(features) or 1))


def table_of(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """Rows that the model fixes, as a table made of a literal."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("x")).select("x.*")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph, family, probability, similarity, predicted, lines for each paragraph that may be a licence notice.

    A paragraph is a line, or a run of lines without a blank one between; `paragraph` is the number of its first line,
    from 0, and `lines` how many it has. `predicted` is the family of highest probability among those that pass their
    threshold, ties to the first in order, else `unknown`; `family` is the same if the paragraph holds CONFIRMED of the
    n-grams of one of the family's templates at least, else `unknown`. similarity is the largest such share. Long texts are
    scanned whole; only those are whose words can make a notice. Lines with
    an ANCHOR word give a row each. Other lines give one if their family is confirmed, and so do runs of up to longest()
    lines that are tight(); of runs of a family that overlap, the most similar wins, then the shortest, then the first. Runs
    don't go across lines that are notices by themselves. Null and empty texts give no row. Rows with equal doc_id and text give their paragraphs once. Other columns are ignored; an empty table
    gives no row.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(common.whole_text()).alias("mark"), "text")
    # Only texts whose words together can make a notice have lines or runs that can. Plain searches go first.
    rows = rows.where(F.expr(f"{holds(ANCHORED)} OR ({holds(needed())} AND {possible().replace('lower(part)', 'lower(text)')})"))
    rows = common.written(rows.dropDuplicates(["doc_id", "mark"]), "licence-texts")
    split = F.split("text", "\n", -1)
    each = rows.select("doc_id", "mark", F.posexplode(split).alias("paragraph", "part")).withColumn("anchor", F.col("part").rlike(ANCHOR))
    each = common.written(each.where(F.col("anchor") | F.expr(possible())), "licence-parts")
    single = common.written(judge(each.select("doc_id", "mark", "paragraph", F.lit(1).alias("lines"), "part", "anchor")), "licence-lines")
    notices = single.where(F.col("family") != UNKNOWN)
    gone = notices.groupBy("doc_id", "mark").agg(F.collect_set("paragraph").alias("gone"))
    left = rows.alias("r").join(gone.alias("g"), F.col("r.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("r.mark") == F.col("g.mark")), "left")
    # Blocks are what lies between blank lines and lines that are notices. The one-element array binds all lines and ends
    # to a name; only blocks leave the row, since a copy of all lines beside each would grow with the square of a text.
    blank = F.filter(F.transform("lines", lambda x, k: F.when(F.trim(x) == "", k)), lambda k: k.isNotNull())
    at = F.sort_array(F.array_distinct(F.concat(blank, F.coalesce("gone", F.array().cast("array<int>")))))
    ends = F.concat(F.array(F.lit(-1)), at, F.array(F.size("lines")))

    def between(x):
        pairs = F.transform(F.sequence(F.lit(1), F.size(x["ends"]) - 1), lambda k: F.struct((F.get(x["ends"], k - 1) + 1).alias("first"), (F.get(x["ends"], k) - F.get(x["ends"], k - 1) - 1).alias("n")))
        return F.transform(F.filter(pairs, lambda p: p["n"] >= 2), lambda p: F.struct(p["first"].alias("first"), F.slice(x["lines"], p["first"] + 1, p["n"]).alias("own")))

    left = left.select("r.doc_id", "r.mark", split.alias("lines"), "gone").select("doc_id", "mark", F.struct("lines", ends.alias("ends")).alias("x"))
    blocks = left.select("doc_id", "mark", F.explode(F.get(F.transform(F.array("x"), between), F.lit(0))).alias("b")).select("doc_id", "mark", "b.*")
    # A run lies in the window in whose first half it begins: windows are twice as long as runs may be. Most hold no notice.
    half = longest()
    cut = F.transform(F.sequence(F.lit(0), F.ceil(F.size("own") / half).cast("int") - 1), lambda k: F.struct((F.col("first") + k * half).alias("first"), F.slice("own", k * half + 1, F.lit(2 * half)).alias("own")))
    found = able(blocks).select("doc_id", "mark", F.explode(cut).alias("w")).select("doc_id", "mark", "w.*")
    found = common.written(able(found), "licence-windows")
    runs = common.written(tight(found), "licence-runs")
    same = F.col("t.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("t.mark") == F.col("w.mark")) & (F.col("t.first") == F.col("w.first"))
    part = F.array_join(F.slice("w.own", F.col("t.start") + 1, F.col("t.lines")), " ")
    runs = runs.alias("t").join(found.alias("w"), same).select("t.doc_id", "t.mark", (F.col("t.first") + F.col("t.start")).alias("paragraph"), "t.lines", part.alias("part"), F.lit(False).alias("anchor"))
    runs = best_apart(judge(common.written(runs, "licence-judged")).where(F.col("family") != UNKNOWN))
    out = ["doc_id", "paragraph", "family", "probability", "similarity", "predicted", "lines"]
    return single.where(F.col("anchor") | (F.col("family") != UNKNOWN)).select(*out).unionByName(runs.select(*out))


def able(blocks: DataFrame) -> DataFrame:
    """Of blocks of lines (doc_id, mark, first, own) those whose words can make a notice: of others no run can."""
    return blocks.withColumn("part", F.array_join("own", " ")).where(F.expr(possible())).drop("part")


def tight(found: DataFrame) -> DataFrame:
    """doc_id, mark, first, start, lines of the tight runs in windows (doc_id, mark, first, own).

    A run is tight if it holds CONFIRMED of a template's n-grams and would lose some without its first line, and without
    its last. An n-gram counts from the line that it begins in to the line that it ends in; of those of one n-gram from one
    line the nearest end is enough, so that a group has at most as many rows as a window's lines times a template's n-grams.
    """
    key = ["doc_id", "mark", "first", "template"]
    templates = sorted((f, t) for f in TEMPLATES for t in TEMPLATES[f])
    rows = [{"gram": g, "id": i, "template": k, "need": math.ceil(CONFIRMED * len(own) - 1e-9)} for k, own in enumerate(sorted(set(grams(words(t)))) for _, t in templates) for i, g in enumerate(own)]
    known = table_of(found.sparkSession, rows, "gram:string,id:int,template:int,need:int")
    each = F.transform("own", lambda x, k: F.transform(F.regexp_extract_all(F.lower(x), F.lit(WORD), F.lit(0)), lambda w: F.struct(w.alias("w"), k.alias("at"))))
    spans = found.select("doc_id", "mark", "first", F.flatten(each).alias("w"))
    spans = spans.select("doc_id", "mark", "first", F.explode(F.flatten(F.array(*[spanned(n) for n in range(1, GRAM + 1)]))).alias("s")).select("doc_id", "mark", "first", "s.*")
    spans = spans.join(F.broadcast(known), "gram").groupBy(*key, "need", "id", "begin").agg(F.min("end").alias("end"))
    groups = spans.groupBy(*key, "need").agg(F.sort_array(F.collect_list(F.struct("id", "end", "begin"))).alias("all"))
    groups = groups.where(F.size(F.array_distinct("all.id")) >= F.col("need"))

    def ends(i):
        """From line i on, the first end of each n-gram, in order."""
        after = F.filter("all", lambda x: x["begin"] >= i)
        nearest = F.transform(F.array(after), lambda a: F.filter(a, lambda x, k: (k == 0) | (F.get(a, k - 1)["id"] != x["id"])))
        return F.array_sort(F.transform(F.get(nearest, F.lit(0)), lambda x: x["end"]))

    starts = F.transform(F.array_distinct("all.begin"), lambda i: F.struct(i.alias("start"), ends(i).alias("ends")))
    rows = groups.select(*key, "need", F.explode(starts).alias("s")).select(*key, "need", "s.*")
    # The last of the n-grams that end in one line tells how many there are up to it.
    rows = rows.select(*key, "need", "start", "ends", F.posexplode("ends").alias("k", "end"))
    rows = rows.where((F.col("k") + 1 >= F.col("need")) & (F.coalesce(F.get("ends", F.col("k") + 1), F.lit(-1)) != F.col("end")) & (F.col("end") - F.col("start") < longest()))
    rows = rows.groupBy(*key, "end", "k").agg(F.max("start").alias("start")).where((F.col("start") < longest()) & (F.col("end") > F.col("start")))
    return rows.select("doc_id", "mark", "first", "start", (F.col("end") - F.col("start") + 1).alias("lines")).distinct()


def best_apart(runs: DataFrame) -> DataFrame:
    """Of judged runs those that win: the most similar, then the shortest, then the first, and so on among those apart from it.

    Runs are chosen family by family in clusters, which end where no run goes on.
    """
    key = ["doc_id", "mark", "family"]
    order = Window.partitionBy(*key).orderBy("paragraph", "lines")
    reach = F.max(F.col("paragraph") + F.col("lines")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("opens", (F.col("paragraph") >= F.coalesce(reach, F.lit(0))).cast("int"))
    runs = runs.withColumn("cluster", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    item = F.struct((-F.col("similarity")).alias("unlike"), "lines", "paragraph", "probability", "similarity", "predicted")
    runs = runs.groupBy(*key, "cluster").agg(F.sort_array(F.collect_list(item)).alias("all"))
    meets = lambda x, y: (x["paragraph"] < y["paragraph"] + y["lines"]) & (y["paragraph"] < x["paragraph"] + x["lines"])
    apart = F.aggregate("all", F.filter("all", lambda x: F.lit(False)), lambda kept, x: F.when(F.exists(kept, lambda y: meets(x, y)), kept).otherwise(F.concat(kept, F.array(x))))
    return runs.select("doc_id", "family", F.explode(apart).alias("x")).select("doc_id", "family", "x.*")


def holds(parts: list[str]) -> str:
    """SQL for whether `text` holds one of the parts, in any case."""
    return "exists(array(lower(text)), t -> " + " OR ".join(f"contains(t, '{p}')" for p in parts) + ")"


@cache
def needed() -> list[str]:
    """Words, one of which is in every text with CONFIRMED of a template's n-grams.

    Of each template they are so many, the longest first and COMMON ones last, that the n-grams without any of them are
    too few.
    """
    chosen = set()
    for t in (t for texts in TEMPLATES.values() for t in texts):
        own, out = set(grams(words(t))), set()
        order = sorted(set(words(t)), key=lambda w: (w in COMMON, -len(w), w))
        while sum(not out & set(g.split()) for g in own) >= CONFIRMED * len(own) - 1e-9:
            out.add(order.pop(0))
        chosen |= out
    return sorted(chosen)


@cache
def possible() -> str:
    """SQL for whether the words of `part` can hold CONFIRMED of a template's n-grams, in whatever order they stand.

    Counted first: an n-gram has GRAM words at most, so that the missing words' n-grams, added up and divided by GRAM,
    bound from below how many are missing. Then exactly, by the n-grams whose words are all there.
    """
    quoted = lambda w: "'" + w.replace("'", "\\'") + "'"
    listed = lambda ws: "array(" + ", ".join(map(quoted, ws)) + ")"
    tests = []
    for t in (t for texts in TEMPLATES.values() for t in texts):
        own, found = sorted(set(words(t))), sorted(set(grams(words(t))))
        need = math.ceil(CONFIRMED * len(found) - 1e-9)
        room, most = GRAM * (len(found) - need), 0
        for size in sorted(sum(w in g.split() for g in found) for w in own):
            if size > room:
                break
            room, most = room - size, most + 1
        held = f"size(filter(array({', '.join(listed(g.split()) for g in found)}), g -> size(array_except(g, ws)) = 0)) >= {need}"
        tests.append(f"(size(array_intersect(ws, {listed(own)})) >= {len(own) - most} AND {held})")
    return f"get(transform(array({template_words('part')}), ws -> {' OR '.join(tests)}), 0)"


@cache
def template_words(column: str) -> str:
    """SQL for the distinct words of a text that templates have."""
    pattern = WORD.replace("\\", "\\\\")
    every = sorted({w for texts in TEMPLATES.values() for t in texts for w in words(t)})
    return f"filter(array_distinct(regexp_extract_all(lower({column}), '{pattern}', 0)), w -> w IN ({', '.join(repr(w) for w in every)}))"


@cache
def longest() -> int:
    """Lines of the longest runs: as many as the longest template has words."""
    return max(len(words(t)) for texts in TEMPLATES.values() for t in texts)


def exploded(parts: DataFrame) -> DataFrame:
    """doc_id, mark, paragraph, lines, size, gram for each n-gram of parts."""
    key = ["doc_id", "mark", "paragraph", "lines"]
    found = parts.select(*key, F.regexp_extract_all(F.lower("part"), F.lit(WORD), F.lit(0)).alias("w"))
    found = found.select(*key, F.array_distinct(F.flatten(F.array(*[windows(n) for n in range(1, GRAM + 1)]))).alias("grams"))
    return found.select(*key, F.size("grams").alias("size"), F.explode("grams").alias("gram"))


def held(each: DataFrame) -> DataFrame:
    """The share of a template's n-grams that each part holds, the largest for each family."""
    key = ["doc_id", "mark", "paragraph", "lines"]
    templates = [(f, k, sorted(set(grams(words(t))))) for f in sorted(TEMPLATES) for k, t in enumerate(TEMPLATES[f])]
    known = table_of(each.sparkSession, [{"gram": g, "family": f, "template": k, "whole": len(own)} for f, k, own in templates for g in own], "gram:string,family:string,template:int,whole:int")
    shared = each.join(F.broadcast(known), "gram").groupBy(*key, "family", "template").agg((F.count("*") / F.max("whole")).alias("share"))
    return shared.groupBy(*key, "family").agg(F.max("share").alias("share"))


def judge(found: DataFrame) -> DataFrame:
    """found (doc_id, mark, paragraph, lines, part, anchor) with what scan() says of each part, but for `part`."""
    spark = found.sparkSession
    weights, intercepts, thresholds = model()
    key = ["doc_id", "mark", "paragraph", "lines"]
    each = exploded(found)
    table = table_of(spark, [{"gram": g, "family": f, "weight": w} for f in sorted(weights) for g, w in sorted(weights[f].items())], "gram:string,family:string,weight:double")
    families = table_of(spark, [{"family": f, "intercept": intercepts[f], "threshold": thresholds[f]} for f in sorted(weights)], "family:string,intercept:double,threshold:double")
    # The model's own tables: some thousands of weights, a row for each family, some hundreds of template n-grams.
    sums = each.join(F.broadcast(table), "gram").groupBy(*key, "size", "family").agg(F.sum("weight").alias("sum"))
    p = 1 / (1 + F.exp(-(F.col("intercept") + F.col("sum") / F.sqrt("size"))))
    sums = sums.join(F.broadcast(families), "family").withColumn("p", p)
    passed = F.when(F.col("p") > F.col("threshold"), F.struct(F.col("p").alias("p"), F.col("family").alias("family")))
    best = sums.groupBy(*key).agg(F.max("p").alias("p"), F.max_by("family", F.struct(passed.isNotNull(), F.col("p"))).alias("top"), F.max(passed.isNotNull()).alias("any"))

    shared = held(each)

    judged = found.select(*key, "anchor").alias("f")
    judged = judged.join(best.alias("b"), same_key("f", "b"), "left").select("f.*", "b.p", F.when(F.col("b.any"), F.col("b.top")).otherwise(UNKNOWN).alias("predicted"))
    judged = judged.alias("f").join(shared.alias("s"), same_key("f", "s") & (F.col("s.family") == F.col("f.predicted")), "left")
    similarity = F.coalesce(F.col("s.share"), F.lit(0.0))
    family = F.when(similarity >= CONFIRMED, F.col("f.predicted")).otherwise(UNKNOWN)
    return judged.select("f.doc_id", "f.mark", "f.paragraph", "f.lines", "f.anchor", family.alias("family"), F.coalesce("f.p", F.lit(0.0)).alias("probability"), similarity.alias("similarity"), "f.predicted")


def same_key(a: str, b: str):
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.mark") == F.col(f"{b}.mark")) & (F.col(f"{a}.paragraph") == F.col(f"{b}.paragraph")) & (F.col(f"{a}.lines") == F.col(f"{b}.lines"))


def spanned(n: int):
    """The n-grams of n words of the column w (w, at), with the lines that they begin and end in."""
    at = F.sequence(F.lit(1), F.size("w") - (n - 1))
    one = lambda k: F.struct(F.array_join(F.slice("w.w", k, n), " ").alias("gram"), F.get("w.at", k - 1).alias("begin"), F.get("w.at", k + (n - 2)).alias("end"))
    return F.when(F.size("w") >= n, F.transform(at, one)).otherwise(F.array().cast("array<struct<gram:string,begin:int,end:int>>"))


def windows(n: int):
    """Runs of n words of the column w, joined by spaces."""
    at = F.sequence(F.lit(1), F.size("w") - (n - 1))
    return F.when(F.size("w") >= n, F.transform(at, lambda k: F.array_join(F.slice("w", k, n), " "))).otherwise(F.array().cast("array<string>"))
