"""Licence scans: sparse TF-IDF cosine to templates, then directory inheritance.

Units of a text are its lines and the whole text.  A unit is a sparse vector of
terms: counts times inverse document frequencies, which come from all texts for
the terms of the templates; any other term weighs as one that no text holds.
The best line is the licence header of its file; a text that as a whole is close
to a template is a licence file and covers its directory.  A file without a
header inherits from the nearest ancestor directory that is covered.

Only lines that can reach the threshold are expanded into terms: by the
inequality of Cauchy and Schwarz a unit needs one of a few cue terms.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.text import written

#: Short notices of public licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, "
                    "are permitted provided that the following conditions are met.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 "
                    "International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-2.1": "This library is free software; you can redistribute it under the GNU Lesser General "
                "Public License, version 2.1.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Proprietary": "All rights reserved.",
}
#: Terms are runs of small letters and digits.
SPLIT = "[^a-z0-9]+"


def terms_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SPLIT), lambda w: w != "")


def template_terms(templates: dict[str, str]) -> dict[str, dict[str, int]]:
    out: dict[str, dict[str, int]] = {}
    for name, text in sorted(templates.items()):
        words = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()
        out[name] = {w: words.count(w) for w in words}
    return out


def _idf(df: float, n: int) -> float:
    return math.log((1 + n) / (1 + df)) + 1


def term_weights(texts: DataFrame, templates: dict[str, str]) -> tuple[dict[str, float], int]:
    """Inverse document frequency of each template term over all texts (column
    ``_t``), and the number of texts; the driver gets a row a template term."""
    terms = sorted({w for t in template_terms(templates).values() for w in t})
    held = F.array_intersect(terms_of(F.col("_t")), F.array(*map(F.lit, terms)))
    rows = (texts.select(F.explode(F.concat(held, F.array(F.lit("")))).alias("term"))
            .groupBy("term").count().collect())
    df = dict(map(tuple, rows))
    n = df.get("", 0)
    return {t: _idf(df.get(t, 0), n) for t in terms}, n


def cue_terms(weights: dict[str, float], templates: dict[str, str], least: float) -> list[str]:
    """The heaviest terms: without any of them a unit's cosine stays below ``least``
    for every template, whatever else it holds."""
    cues: set[str] = set()
    for counts in template_terms(templates).values():
        square = {w: (c * weights[w]) ** 2 for w, c in counts.items()}
        rest, total = sum(square.values()), sum(square.values())
        for w in sorted(square, key=lambda w: (-square[w], w)):
            if rest < (0.999 * least) ** 2 * total:
                break
            cues.add(w)
            rest -= square[w]
    return sorted(cues)


def licences(files: DataFrame, file_id: Column, path: Column, text: Column,
             templates: dict[str, str] = TEMPLATES, header_at_least: float = 0.8,
             file_at_least: float = 0.6) -> DataFrame:
    """One row for each file: ``id``, ``path``, ``header`` (template of the best
    line) and ``header_score``; ``covers`` (template of the whole text, if it is a
    licence file); ``inherited`` and ``inherited_from``, the licence of the nearest
    covered directory on the way up; ``licence``, the header or else the inherited.

    Ties go to the earlier template by name.  Several licence files of a directory:
    the greatest score counts, then the name.  Null texts have no header, null
    paths no directory; ids and paths need not be unique.  A file in a directory
    that it covers itself inherits from there as well.
    """
    src = files.select(file_id.alias("id"), path.cast("string").alias("path"),
                       F.coalesce(text, F.lit("")).alias("_t"))
    weights, n = term_weights(src, templates)
    unseen = _idf(0, n)
    vectors = {name: {w: c * weights[w] for w, c in counts.items()}
               for name, counts in template_terms(templates).items()}
    norms = {k: math.sqrt(sum(x * x for x in v.values())) for k, v in vectors.items()}
    lowest = min(header_at_least, file_at_least)
    cue = "(?:^|[^a-z0-9])(?:" + "|".join(cue_terms(weights, templates, lowest)) + ")(?:[^a-z0-9]|$)"

    # Row numbers tell apart files that share an id; the table is written, so they stay.
    lines = F.filter(F.split(F.lower("_t"), "\n"), lambda x: x.rlike(cue))
    has_cue = F.lower("_t").rlike(cue)
    rows = written(src.select(
        F.monotonically_increasing_id().alias("row"), "id", "path",
        F.when(has_cue, F.concat(F.array("_t"), lines)).alias("units")), "licence-units")
    units = rows.where("units is not null").select("row", F.posexplode("units").alias("unit", "u"))
    counts = (units.select("row", "unit", F.explode(terms_of(F.col("u"))).alias("term"))
              .groupBy("row", "unit", "term").count())
    by_term = F.create_map(*[F.lit(x) for kv in sorted(weights.items()) for x in kv])
    weight = F.coalesce(F.element_at(by_term, F.col("term")), F.lit(unseen))
    vector = {k: F.create_map(*[F.lit(x) for kv in sorted(v.items()) for x in kv]) for k, v in vectors.items()}
    value = F.col("count") * F.col("idf")
    scored = (counts.withColumn("idf", weight).groupBy("row", "unit").agg(
        F.sqrt(F.sum(value * value)).alias("_norm"),
        *[F.sum(value * F.coalesce(F.element_at(vector[k], F.col("term")), F.lit(0.0))).alias(f"_dot_{i}")
          for i, k in enumerate(vectors)]))
    cosines = F.array(*[F.struct(F.round(F.col(f"_dot_{i}") / (F.col("_norm") * norms[k]), 6).alias("score"),
                                 F.lit(-i).alias("rank"), F.lit(k).alias("name"))
                        for i, k in enumerate(vectors)])
    best = scored.select("row", "unit", F.array_max(cosines).alias("best"))
    whole = F.col("unit") == 0
    per_file = best.groupBy("row").agg(
        F.max(F.when(~whole & (F.col("best.score") >= header_at_least), F.col("best"))).alias("header"),
        F.max(F.when(whole & (F.col("best.score") >= file_at_least), F.col("best"))).alias("covers"))
    table = written(rows.drop("units").join(per_file, "row", "left")
                    .withColumn("dir", parent(F.col("path"))), "licence-files")

    covered = (table.where("covers is not null and dir is not null").groupBy("dir")
               .agg(F.max("covers").alias("best")).select(F.col("dir").alias("up"), "best.name"))
    dirs = table.where("dir is not null").select("dir").distinct()
    nearest = (dirs.select("dir", F.explode(ancestors(F.col("dir"))).alias("up")).join(covered, "up")
               .groupBy("dir").agg(F.max_by(F.struct("up", "name"), F.length("up")).alias("near")))
    # Written, so that the join can split a directory that holds most files.
    return table.join(written(nearest, "nearest"), "dir", "left").select(
        "id", "path", F.col("header.name").alias("header"), F.col("header.score").alias("header_score"),
        F.col("covers.name").alias("covers"), F.col("near.name").alias("inherited"),
        F.col("near.up").alias("inherited_from"),
        F.coalesce("header.name", "near.name").alias("licence"))


def parent(path: Column) -> Column:
    """Directory of a path: what stands before the last slash ("" at the top)."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).when(path.isNotNull(), "")


def ancestors(directory: Column) -> Column:
    """The directory and all above it, up to the top ("")."""
    parts = F.split(directory, "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.array_distinct(F.concat(F.array(F.lit("")), up))
