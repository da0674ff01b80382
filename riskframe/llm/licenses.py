"""Licence scan: sparse TF-IDF cosine of licence lines and files to templates, then inheritance along directories.

A term weighs by how few templates have it and by the share of the corpus's
documents that lack it, so that common words of the corpus weigh little. Lines
with a term that any match of a template needs are cut into terms; each
distinct line is compared once with the templates by a join on terms. The best
template is taken if its cosine reaches the bound and the line covers enough
of the template's weight. Whole files are compared with whole licence texts in
the same way. A file that is such a text or is named as a licence speaks for
its directory; a file without a licence of its own takes that of the nearest
directory above it that has one: directories are resolved once each, by joins
of path prefixes.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.session import materialise

# licences' usual notices and the openings of their texts, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0", "Apache License Version 2.0, January 2004"),
    "MIT": (
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
    ),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3",),
    "GPL-2.0": ("This program is licensed under the GNU General Public License, version 2",),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3",),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0", "Creative Commons Attribution ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "Creative Commons Attribution NonCommercial 4.0 International License"),
    "CC0-1.0": ("CC0 1.0 Universal", "No rights reserved, dedicated to the public domain"),
    "Unlicense": ("This is free and unencumbered software released into the public domain",),
    "Proprietary": ("All rights reserved", "Unauthorized copying of this file is strictly prohibited"),
}
#: Least cosine, and least share of a template's squared length that a line must cover.
COSINE, COVER = 0.5, 0.5
#: Whole texts of licences, one file each; a file with this cosine to one of them is that licence.
TEXTS = Path(__file__).resolve().parent / "license_texts"
WHOLE = 0.8
#: Distinct licence lines or files whose digests are broadcast (about 100 bytes each).
MANY = 10_000
#: Tasks over which rows of one digest are dealt beyond that.
SALT = 16
#: Terms of templates: runs of letters and digits.
_WORD = re.compile(r"[^\W_]+")


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda t: t != "")


def counted_terms(templates: dict[str, tuple[str, ...]] = TEMPLATES) -> list[tuple[str, str, Counter]]:
    """(license, template, count of each term) of every template."""
    return [(name, f"{name} {i}", Counter(_WORD.findall(text.lower()))) for name, texts in templates.items() for i, text in enumerate(texts)]


def shares(texts: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> dict[str, float]:
    """For each term of the templates the texts (column ``text``, nulls left out) that have it, as a share of all and one more."""
    listed = sorted({t for *_, c in counted_terms(templates) for t in c})
    known = texts.where("text IS NOT NULL").select(F.array_intersect(F.array_distinct(terms(F.col("text"))), F.array(*map(F.lit, listed))).alias("own"))
    # a row for each text besides those for its terms, so that one scan counts both
    found = known.select(F.explode(F.concat(F.array(F.lit("")), F.col("own"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    n = {r["term"]: r["n"] for r in found.collect()}
    return {t: n.get(t, 0) / (n.get("", 0) + 1) for t in listed}


def weights(share: dict[str, float], templates: dict[str, tuple[str, ...]] = TEMPLATES) -> dict[str, float]:
    """ln(1 + templates / templates with the term) * (1 - share of documents with it)."""
    counts = [c for *_, c in counted_terms(templates)]
    df = Counter(t for c in counts for t in c)
    return {t: math.log(1 + len(counts) / n) * (1 - share.get(t, 0.0)) for t, n in df.items()}


def needed(weight: dict[str, float], cover: float = COVER, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> str:
    """A pattern that lower-case text contains if it covers the share ``cover`` of any template.

    The lightest terms of each template are left out as long as they are too
    light together: a text with none of the others stays below the share.
    """
    asked: set[str] = set()
    for *_, c in counted_terms(templates):
        squares = {t: (n * weight[t]) ** 2 for t, n in c.items()}
        room = max(cover - 1e-5, 0) * sum(squares.values())
        for t in sorted(squares, key=lambda t: (squares[t], t)):
            if squares[t] < room:
                room -= squares[t]
            else:
                asked.add(t)
    return rf"(?:^|[^\p{{L}}\p{{N}}])(?:{'|'.join(sorted(map(re.escape, asked)))})(?:$|[^\p{{L}}\p{{N}}])"


def matched(
    lines: DataFrame, weight: dict[str, float], cosine: float = COSINE, cover: float = COVER, templates: dict[str, tuple[str, ...]] = TEMPLATES
) -> DataFrame:
    """(digest, license, score) of each line of ``lines`` (digest, line; distinct) that matches its best template.

    A term that no template has weighs like one that a single template and no
    document has; equal scores go to the first identifier.
    """
    rare = math.log(1 + sum(map(len, templates.values())))
    kinds = [(name, {t: n * weight[t] for t, n in c.items()}) for name, _, c in counted_terms(templates)]
    counts = lines.select("digest", F.explode(terms(F.col("line"))).alias("term")).groupBy("digest", "term").agg(F.count(F.lit(1)).alias("tf"))
    return best_of(counts, weight, rare, kinds, cosine, cover)


def best_of(counts: DataFrame, idf: dict[str, float], rare: float, kinds: list[tuple[str, dict[str, float]]], cosine: float, cover: float) -> DataFrame:
    """(digest, license, score) of the best of ``kinds`` (license, weight of each term) for each digest of ``counts`` (digest, term, tf).

    A term is listed once, with its weights in all kinds, so the join makes no
    more rows than there are counts; what a digest gathers is bounded by the
    kinds' terms. A term without ``idf`` has ``rare``; a kind below ``cosine``,
    or of whose squared length less than ``cover`` is shared, is out.
    """
    kinds = [(name, own) for name, own in kinds if any(own.values())]
    listed: dict[str, list] = {t: [] for t in idf}
    for i, (_, own) in enumerate(kinds):
        for t, x in own.items():
            listed[t].append({"kind": i, "x": x})
    weights = pa.list_(pa.struct([("kind", pa.int32()), ("x", pa.float64())]))
    table = pa.table({"term": pa.array(listed, pa.string()), "idf": pa.array(idf.values(), pa.float64()), "own": pa.array(listed.values(), weights)})
    weighed = counts.join(F.broadcast(counts.sparkSession.createDataFrame(table)), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(rare)))
    products = F.transform("own", lambda o: F.struct(o.kind.alias("kind"), (F.col("w") * o.x).alias("dot"), (o.x * o.x).alias("covered")))
    gathered = weighed.groupBy("digest").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("own_norm"), F.collect_list(products).alias("shared"))
    gathered = gathered.where(F.size("shared") > 0).select("digest", "own_norm", F.flatten("shared").alias("shared"))
    norms = [math.sqrt(sum(x * x for x in own.values())) for _, own in kinds]
    all_kinds = F.array(*[F.struct(F.lit(i).alias("kind"), F.lit(name).alias("license"), F.lit(n).alias("norm")) for i, ((name, _), n) in enumerate(zip(kinds, norms))])

    def scored(k: Column) -> Column:
        own = F.filter("shared", lambda s: s.kind == k.kind)
        total = lambda column: F.aggregate(own, F.lit(0.0), lambda a, s: a + s[column])
        score, part = F.round(total("dot") / (k.norm * F.col("own_norm")), 6), F.round(total("covered") / (k.norm * k.norm), 6)
        return F.struct((-score).alias("minus"), k.license.alias("license"), part.alias("part"))

    fits = F.filter(F.transform(all_kinds, scored), lambda s: (-s.minus >= cosine) & (s.part >= cover))
    best = gathered.select("digest", F.array_min(fits).alias("best")).where("best IS NOT NULL")
    return best.select("digest", F.col("best.license").alias("license"), (-F.col("best.minus")).alias("score"))


def whole_texts() -> dict[str, dict[str, float]]:
    """Per licence the weight of each term of its whole text: (1 + ln of its count) * ln(1 + texts / texts with it)."""
    counts = {p.stem: Counter(_WORD.findall(p.read_text().lower())) for p in sorted(TEXTS.glob("*.txt"))}
    df = Counter(t for c in counts.values() for t in c)
    return {name: {t: (1 + math.log(n)) * math.log(1 + len(counts) / df[t]) for t, n in c.items()} for name, c in counts.items()}


def guards(texts: dict[str, dict[str, float]], bound: float = WHOLE) -> list[str]:
    """Terms of which every text that reaches ``bound`` with a whole licence has at least one.

    The terms shared hold at least the square of the bound of the licence's
    squared length, so of its heaviest terms that hold more than the rest one
    at least is shared.
    """
    out: set[str] = set()
    for own in texts.values():
        room = (1 - (bound - 1e-5) ** 2) * sum(w * w for w in own.values())
        for t in sorted(own, key=lambda t: (-own[t], -len(t), t)):
            out.add(t)
            room -= own[t] ** 2
            if room < 0:
                break
    return sorted(out)


def whole_licenses(plain: DataFrame, bound: float = WHOLE) -> DataFrame:
    """(digest, license, score) of the distinct texts of ``plain`` (text) whose best whole licence text reaches ``bound``.

    Only texts with a guard term and as many of a licence's terms as its
    heaviest that make up the square of the bound are weighed. A term that no
    licence has counts as one of a single licence.
    """
    texts = whole_texts()
    enough = F.lit(False)
    for own in texts.values():
        squares = sorted((w * w for w in own.values()), reverse=True)
        total, least = 0.0, 0
        while least < len(squares) and total < (bound - 1e-5) ** 2 * sum(squares):
            total += squares[least]
            least += 1
        shared = F.array_intersect(F.col("own"), F.array(*map(F.lit, sorted(own))))
        enough = enough | ((F.size("own") >= least) & (F.size(shared) >= least))
    guarded = F.arrays_overlap(F.col("own"), F.array(*map(F.lit, guards(texts, bound))))
    near = plain.where("text IS NOT NULL").select("text", F.array_distinct(terms(F.col("text"))).alias("own"))
    # by explode, as a filter would be pushed below the column and cut the texts into terms for every condition
    near = near.select(F.explode(F.when(guarded & enough, F.array("text"))).alias("text"))
    near = near.select(F.sha2("text", 256).alias("digest"), "text").dropDuplicates(["digest"])
    counts = near.select("digest", F.explode(terms(F.col("text"))).alias("term")).groupBy("digest", "term").agg((1 + F.log(F.count(F.lit(1)))).alias("tf"))
    df = Counter(t for own in texts.values() for t in own)
    idf = {t: math.log(1 + len(texts) / n) for t, n in df.items()}
    return best_of(counts, idf, math.log(1 + len(texts)), list(texts.items()), bound, 0.0)


def _best(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(id, license, score): the best of ``found`` (digest, license, score) for each id of ``rows`` (id, digest).

    What was found is broadcast up to ``MANY`` rows. Beyond that rows of one
    digest are dealt over several tasks, so a digest that a third of all rows
    bear is no hot key.
    """
    found = materialise(found)
    if found.count() <= MANY:
        joined = rows.join(F.broadcast(found), "digest")
    else:
        copies = found.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int")).join(copies, ["digest", "salt"])
    top = joined.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("top"))
    return top.select("id", F.col("top.license").alias("license"), (-F.col("top.minus")).alias("score"))


def ancestors(path: Column) -> Column:
    """The directories above a path, nearest first, "" (the root) last."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    depth = F.greatest(F.size(parts) - 1, F.lit(0))
    return F.transform(F.sequence(depth, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def scan(
    docs: DataFrame,
    path: Column,
    text: str = "text",
    id_col: str = "doc_id",
    cosine: float = COSINE,
    cover: float = COVER,
    templates: dict[str, tuple[str, ...]] = TEMPLATES,
) -> DataFrame:
    """(id, path, own_license, score, license, licensed_by, is_license_file) for every row of ``docs``.

    ``own_license`` is the licence whose whole text a document is, else the best
    of its lines, ``license`` that or the one inherited; ``licensed_by`` is the
    path of the document or directory it comes from. A licence file is a whole
    licence text, or a file named as one with a licence of its own; of several
    in a directory the one with the highest score speaks, then the first
    identifier. Null and empty texts have no licence of their own; a null path
    lies in the root; ids name rows, so rows that repeat an id share the best
    line of all of them; a null id has no licence of its own. Further columns
    are left out, so none can clash; an empty table gives an empty result.
    """
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(path, F.lit("")).alias("path"), F.col(text).cast("string").alias("text"))
    weight = weights(shares(plain, templates), templates)
    pattern = needed(weight, cover, templates)
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: F.lower(x).rlike(pattern))
    found = plain.where(F.lower("text").rlike(pattern)).select("id", F.explode(F.array_distinct(lines)).alias("line"))
    found = materialise(found.select("id", F.sha2("line", 256).alias("digest"), "line"))
    best = matched(found.select("digest", "line").dropDuplicates(["digest"]), weight, cosine, cover, templates)
    own = _best(found.select("id", "digest"), best).withColumnsRenamed({"license": "line_license", "score": "line_score"})
    files = materialise(whole_licenses(plain))
    digests = plain.select("id", F.sha2("text", 256).alias("digest")) if not files.isEmpty() else plain.select("id", F.lit("").alias("digest")).limit(0)
    whole = _best(digests, files).withColumnsRenamed({"license": "text_license", "score": "text_score"})
    named = F.coalesce(F.element_at(F.split("path", "/"), -1), F.lit("")).rlike(r"(?i)^(licen[sc]e|copying|notice)([._-].*)?$")
    marked = plain.select("id", "path").join(own, "id", "left").join(whole, "id", "left")
    marked = marked.select(
        "id",
        "path",
        F.coalesce("text_license", "line_license").alias("own_license"),
        F.coalesce("text_score", "line_score").alias("score"),
        (F.col("text_license").isNotNull() | (named & F.col("line_license").isNotNull())).alias("is_license_file"),
        F.element_at(ancestors(F.col("path")), 1).alias("folder"),
    )
    marked = materialise(marked)
    speaks = (
        marked.where("is_license_file").groupBy("folder").agg(F.min(F.struct((-F.col("score")).alias("minus"), "own_license")).alias("top"))
    ).select(F.col("folder").alias("above"), F.col("top.own_license").alias("folder_license"))
    folders = marked.select("folder").distinct()
    steps = folders.select("folder", F.posexplode(F.concat(F.array("folder"), ancestors(F.col("folder")))).alias("far", "above"))
    nearest = steps.join(speaks, "above").groupBy("folder").agg(F.min(F.struct("far", "above", "folder_license")).alias("near"))
    nearest = materialise(nearest)  # one row per directory
    whole = marked.join(F.broadcast(nearest) if nearest.count() <= MANY else nearest, "folder", "left")
    taken = F.coalesce("own_license", "near.folder_license")
    by = F.when(F.col("own_license").isNotNull(), F.col("path")).otherwise(F.col("near.above"))
    return whole.select(F.col("id").alias(id_col), "path", "own_license", "score", taken.alias("license"), by.alias("licensed_by"), "is_license_file")
