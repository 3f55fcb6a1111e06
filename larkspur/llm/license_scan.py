"""Licence scan: sparse TF-IDF cosine of lines to licence templates, then inheritance from the nearest directory.

Texts are looked at line by line, and in windows of up to ``MAX_LINES`` lines that follow each other, lines without a
letter or digit (blank ones, bare comment marks) not counted, as notices may be wrapped.  A vector has the terms of the templates (without stop words) that a line holds,
weighted by how few documents have the term; a line without any has no vector.  A document's licence is that of the
template nearest to one of its lines or windows, if near enough; a window must also hold half of the template's terms.
A directory's licence file is the licensed document with the
smallest id directly in it; documents without a licence of their own take that of the nearest directory above them
that has one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import text_or_empty
from larkspur.session import written

MIN_COSINE = 0.6
MAX_LINES = 8  # the longest template has 5 lines at 40 columns, 8 at 24

# fixed values: (licence, header or one-line notice)
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3, as published by the Free Software Foundation."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
STOP_WORDS = ("a", "an", "and", "any", "are", "as", "by", "for", "form", "in", "into", "is", "it", "met", "not", "of", "or", "that", "the", "this", "to", "under", "use", "with", "without", "work", "you", "can", "may", "except", "following", "forms", "person", "purpose")
TERM = r"[^a-z0-9.]+"


def terms(line: str) -> list[str]:
    """Terms of a template, as ``_terms`` finds those of a line."""
    low = "".join(c if c.isascii() and c.isalnum() or c == "." else " " for c in line.lower())
    return [t for t in (w.strip(".") for w in low.split()) if t and t not in STOP_WORDS]


def vocabulary() -> list[str]:
    return sorted({t for _, text in TEMPLATES for t in terms(text)})


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _term_pattern(words: list[str]) -> str:
    return "(?i)(?<![a-z0-9.])[.]*(?:" + "|".join(w.replace(".", "[.]") for w in words) + ")[.]*(?![a-z0-9.])"


def candidate_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_name, line, place, terms): every line that holds a term of the templates, and those terms with repeats.

    ``place`` counts the lines that have a letter or digit.
    """
    pattern = _term_pattern(vocabulary())
    full = F.filter(F.transform(F.split("text", "\n", -1), lambda l, i: F.struct(i.alias("line"), l.alias("text"))), lambda l: l["text"].rlike(r"[\p{L}\p{N}]"))
    lines = F.filter(F.transform(full, lambda l, i: F.struct(l["line"].alias("line"), i.alias("place"), F.regexp_extract_all(l["text"], F.lit(pattern), F.lit(0)).alias("found"))), lambda l: F.size(l["found"]) > 0)
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).select("doc_id", F.xxhash64("text").alias("text_name"), F.explode(lines).alias("l"))
    return rows.select("doc_id", "text_name", "l.line", "l.place", F.transform("l.found", lambda t: F.btrim(F.lower(t), F.lit("."))).alias("terms"))


def windows(lines: DataFrame) -> DataFrame:
    """(doc_id, text_name, line, span, terms): windows of 2 to MAX_LINES lines that begin and end with a line of ``lines``."""
    once = lines.dropDuplicates(["doc_id", "text_name", "line"])  # rows that repeat id and text have the same windows
    starts = once.select(F.col("doc_id").alias("_id"), F.col("text_name").alias("_name"), F.col("place").alias("_start"), F.col("line").alias("_line"))
    parts = once.select("doc_id", "text_name", "place", "terms", F.explode(F.expr(f"sequence(greatest(place - {MAX_LINES - 1}, 0), place)")).alias("start"))
    joined = parts.join(starts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_name") == F.col("_name")) & (F.col("start") == F.col("_start")))
    spans = joined.groupBy("doc_id", "text_name", F.col("_line").alias("line")).agg(F.collect_list(F.struct((F.col("place") - F.col("start") + 1).alias("span"), "terms")).alias("parts"))  # MAX_LINES at most
    ends = spans.where(F.size("parts") > 1).select("*", F.explode("parts.span").alias("span")).where("span > 1")
    return ends.select("doc_id", "text_name", "line", "span", F.expr("flatten(transform(filter(parts, p -> p.span <= span), p -> p.terms))").alias("terms"))


def weights(lines: DataFrame, n_docs: int) -> DataFrame:
    """(term, idf): rarity over all documents of each template term."""
    per_doc = lines.select("doc_id", "text_name", F.explode("terms").alias("term")).distinct()
    known = lines.sparkSession.createDataFrame([(t,) for t in vocabulary()], "term string")
    return known.join(per_doc.groupBy("term").agg(F.count("*").alias("df")), "term", "left").select("term", (F.log(F.lit((1.0 + n_docs)) / (1.0 + F.coalesce("df", F.lit(0)))) + 1).alias("idf"))


def template_vectors(idf: DataFrame) -> DataFrame:
    """(template, license, term, size, share): unit vectors of the templates, and how many terms each has."""
    spark = idf.sparkSession
    rows = [(i, name, t, text_terms.count(t)) for i, (name, text) in enumerate(TEMPLATES) for text_terms in [terms(text)] for t in sorted(set(text_terms))]
    weighted = spark.createDataFrame(rows, "template int, license string, term string, n int").join(idf, "term").withColumn("w", F.col("n") * F.col("idf"))
    norms = weighted.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.count("*").alias("size"))
    return weighted.join(norms, "template").select("template", "license", "term", "size", (F.col("w") / F.col("norm")).alias("share"))


def own_licenses(docs: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(doc_id, text_name, license, cosine, line) of the documents with a licence: nearest template, then fewest lines, then first."""
    lines = written(candidate_lines(docs))
    idf = written(weights(lines, docs.count()))
    vectors = template_vectors(idf)
    pieces = lines.select("doc_id", "text_name", "line", F.lit(1).alias("span"), "terms").union(windows(lines))
    counted = pieces.select("doc_id", "text_name", "line", "span", F.explode("terms").alias("term")).groupBy("doc_id", "text_name", "line", "span", "term").agg(F.count("*").alias("n"))
    # both sides are as large as the templates make them: some hundred rows
    weighted = counted.join(F.broadcast(idf), "term").withColumn("w", F.col("n") * F.col("idf"))
    norms = weighted.groupBy("doc_id", "text_name", "line", "span").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighted.join(F.broadcast(vectors), "term").groupBy("doc_id", "text_name", "line", "span", "template", "license", "size").agg(F.sum(F.col("w") * F.col("share")).alias("dot"), F.count("*").alias("shared"))
    dots = dots.where("span = 1 or 2 * shared >= size")
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_name"] == b["text_name"]) & (a["line"] == b["line"]) & (a["span"] == b["span"])
    near = dots.join(norms, same(dots, norms)).select(dots["doc_id"], dots["text_name"], dots["line"], dots["span"], "template", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("cosine")).where(F.col("cosine") >= min_cosine)
    best = near.groupBy("doc_id", "text_name").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "span", "line", "template", "license")).alias("b"))
    return best.select("doc_id", "text_name", "b.license", (-F.col("b.c")).alias("cosine"), "b.line")


def inherited(directories: DataFrame, licensed: DataFrame) -> DataFrame:
    """(directory, license, from_directory) of each distinct directory that has a licence file or one above it.

    ``licensed``: (directory, license).  Only distinct directories are taken apart into those above them.
    """
    above = directories.select("directory").distinct().withColumn("_parts", F.split("directory", "/", -1))
    above = above.select("directory", F.explode(F.expr("transform(sequence(1, size(_parts)), n -> struct(n as depth, array_join(slice(_parts, 1, n), '/') as path))")).alias("a"))
    found = above.join(licensed.select(F.col("directory").alias("_path"), "license"), F.col("a.path") == F.col("_path"))
    return found.groupBy("directory").agg(F.max(F.struct("a.depth", "_path", "license")).alias("m")).select("directory", "m.license", F.col("m._path").alias("from_directory"))


def license_scan(docs: DataFrame, directory: Column, min_cosine: float = MIN_COSINE) -> DataFrame:
    """Per document: doc_id, directory, license, cosine, line, from_directory; ``directory`` gives its path from the docs.

    Own licences have a cosine and the number of the line, of a window its first; inherited ones have the directory they come from; documents
    with neither have nulls.  A null text has no lines, a null directory is the root, ''.  A null doc_id is a document,
    but no licence file.  Rows that repeat id and text share their licence.  Ties go to single lines, shorter windows,
    the first line, then the first template.  Other columns are ignored; an empty table gives no rows.
    """
    own = written(own_licenses(docs, min_cosine).withColumnRenamed("doc_id", "_id").withColumnRenamed("text_name", "_name"))
    placed = written(docs.select(F.col("doc_id").cast("long"), F.xxhash64(text_or_empty()).alias("_n"), F.coalesce(directory, F.lit("")).alias("directory")))
    joined = placed.join(own, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_n") == F.col("_name")), "left").drop("_id", "_n", "_name")
    files = joined.where("license is not null and doc_id is not null").groupBy("directory").agg(F.min(F.struct("doc_id", "license")).alias("f")).select("directory", "f.license")
    taken = inherited(placed, files).withColumnRenamed("license", "_license").withColumnRenamed("from_directory", "_from")
    return joined.join(taken, "directory", "left").select(
        "doc_id", "directory", F.coalesce("license", "_license").alias("license"), "cosine", "line", F.when(F.col("license").isNull(), F.col("_from")).alias("from_directory")
    )


def _directory() -> Column:
    """Documents lie one to three directories deep: source, language, hundred."""
    parts = F.concat(F.lit("/"), "source"), F.concat(F.lit("/"), "lang"), F.concat(F.lit("/"), (F.col("doc_id") / 100).cast("long").cast("string"))
    return F.concat(parts[0], F.when(F.col("doc_id") % 3 > 0, parts[1]).otherwise(""), F.when(F.col("doc_id") % 3 > 1, parts[2]).otherwise(""))


QUERY = {"op7_license_scan": lambda spark, sf_dir: license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), _directory())}


def _oracle() -> str:
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    vectors = ", ".join(f"({i}, {quoted(name)}, {quoted(t)}, {terms(text).count(t)})" for i, (name, text) in enumerate(TEMPLATES) for t in sorted(set(terms(text))))
    known = ", ".join(f"({quoted(t)})" for t in vocabulary())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines,
      '/' || source || CASE WHEN doc_id % 3 > 0 THEN '/' || lang ELSE '' END || CASE WHEN doc_id % 3 > 1 THEN '/' || (doc_id // 100) ELSE '' END AS path FROM documents),
v(term) AS (VALUES {known}),
l AS (SELECT row, unnest(lines) AS text, unnest(range(len(lines))) AS line FROM d),
w AS (SELECT row, line, trim(unnest(regexp_split_to_array(lower(text), '[^a-z0-9.]+')), '.') AS term FROM l),
c AS (SELECT row, line, term, count(*) AS n FROM w JOIN v USING (term) GROUP BY ALL),
idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM documents))::DOUBLE / (1.0 + coalesce(df, 0))) + 1 AS idf FROM v LEFT JOIN (SELECT term, count(DISTINCT row) AS df FROM c GROUP BY term) USING (term)),
t(template, license, term, n) AS (VALUES {vectors}),
tw AS (SELECT template, license, term, n * idf AS w, sqrt(sum(n * idf * n * idf) OVER (PARTITION BY template)) AS norm FROM t JOIN idf USING (term)),
cw AS (SELECT row, line, term, n * idf AS w FROM c JOIN idf USING (term)),
norms AS (SELECT row, line, sqrt(sum(w * w)) AS norm FROM cw GROUP BY ALL),
near AS (SELECT row, line, template, license, round(sum(cw.w * tw.w / tw.norm) / any_value(norms.norm), 6) AS cosine FROM cw JOIN tw USING (term) JOIN norms USING (row, line) GROUP BY row, line, template, license),
own AS (SELECT * FROM near WHERE cosine >= {MIN_COSINE} QUALIFY row_number() OVER (PARTITION BY row ORDER BY cosine DESC, line, template) = 1),
f AS (SELECT path, arg_min(license, doc_id) AS license FROM d JOIN own USING (row) GROUP BY path),
up AS (SELECT d.row, f.path, f.license FROM d JOIN f ON d.path = f.path OR starts_with(d.path, f.path || '/') QUALIFY row_number() OVER (PARTITION BY d.row ORDER BY len(f.path) DESC) = 1)
SELECT doc_id, d.path AS directory, coalesce(own.license, up.license) AS license, cosine, line::INT AS line, CASE WHEN own.license IS NULL THEN up.path END AS from_directory
FROM d LEFT JOIN own USING (row) LEFT JOIN up USING (row)
"""


ORACLE = {"op7_license_scan": _oracle()}
