"""License scan: sparse TF-IDF cosine to templates, then inheritance along the path.

Every sentence or line of a file is compared with the license templates by the cosine of
their TF-IDF vectors; inverse document frequencies of the template words come from all
files, a word of no template weighs like one that was never seen. A file's own license is
that of its best sentence. A file that as a whole is close to a template is a license file;
files without a license inherit from the license file in the nearest directory above.

Only sentences that can reach the threshold are compared: a template's lightest words whose
weights together stay below the threshold cannot do it alone, so a sentence must hold one of
the other words.

DataFrame operations only. A null or empty text has no license of its own; a null path has
no directory and inherits nothing. Ties go to the smaller template name, then the smaller
path. Repeated rows are reported once each with equal results; an empty table gives an
empty result; other columns are not used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm import common as C
from tracefold.sources.sinks import stored

#: Scores are whole millionths, so that they do not depend on the order of sums.
SCALE = 1_000_000
HEADER_SCORE, FILE_SCORE = 600_000, 300_000

# How common licenses are named in headers and notices.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Redistributed under the BSD 3-Clause License"),
    ("CC-BY-4.0", "Licensed under the Creative Commons Attribution 4.0 license, CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, version 2.0"),
    ("Proprietary", "Copyright, all rights reserved"),
]

_WORD = r"[a-z]+|[0-9]+(?:\.[0-9]+)*"
_BREAK = r"[.!?]\s+|\n+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({_WORD})"), F.lit(1))


def _idf(n: Column, total: int) -> Column:
    return F.round(F.log(F.lit(float(total + 1)) / (n + 1)) + 1, 6)


def template_weights(files: DataFrame, templates: list[tuple[str, str]]) -> DataFrame:
    """tid, license, term, tf, idf of the template words; a small table."""
    spark = files.sparkSession
    rows = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(templates)],
                                 "tid int, license string, template string")
    terms = rows.select("tid", "license", F.explode(words(F.col("template"))).alias("term")
                        ).groupBy("tid", "license", "term").agg(F.count("*").alias("tf"))
    used = terms.select("term").distinct()
    # a doc's distinct words meet the few template words before anything is shuffled
    seen = files.select(F.explode(F.array_distinct(words(F.col("text")))).alias("term")).join(
        F.broadcast(used), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    return terms.join(seen, "term", "left").select(
        "tid", "license", "term", "tf", F.coalesce("df", F.lit(0)).alias("df"))


def needed_words(weights: list, threshold: float) -> list[str]:
    """Words of which a text must hold one to reach the threshold with some template."""
    by_template: dict[int, list[tuple[float, str]]] = {}
    for r in weights:
        by_template.setdefault(r["tid"], []).append((r["tf"] * r["idf"], r["term"]))
    out: set[str] = set()
    for entries in by_template.values():
        norm = math.sqrt(sum(w * w for w, _ in entries))
        rest = 0.0
        for w, term in sorted(entries):
            rest += w * w
            if math.sqrt(rest) >= 0.999 * threshold * norm:
                out.add(term)
    return sorted(out)


def holds(needed: list[str]) -> str:
    """Pattern of the lower-case texts with one of the words, parted as ``words`` does: letters
    end at a digit and the other way round."""
    letters = "|".join(w for w in needed if w[0].isalpha())
    numbers = "|".join(w.replace(".", r"\.") for w in needed if w[0].isdigit())
    return "|".join([f"(?<![a-z])(?:{letters})(?![a-z])"] * bool(letters) + [
        rf"(?<![0-9])(?<![0-9]\.)(?:{numbers})(?![0-9])(?!\.[0-9])"] * bool(numbers))


def cosine(parts: DataFrame, weights: DataFrame, unseen: Column) -> DataFrame:
    """Best template of every part (key, part, text): key, part, license, score."""
    counts = parts.select("key", "part", F.explode(words(F.col("text"))).alias("term")).groupBy(
        "key", "part", "term").agg(F.count("*").alias("n"))
    idf = weights.select("term", "idf").distinct()
    # the norm and the template words of a part from one reading of its words
    read = counts.join(F.broadcast(idf), "term", "left").groupBy("key", "part").agg(
        F.sum(F.pow(F.col("n") * F.coalesce("idf", unseen), 2)).alias("norm"),
        F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("term", "n"))).alias("known"))
    template_norm = weights.groupBy("tid").agg(
        F.sum(F.pow(F.col("tf") * F.col("idf"), 2)).alias("tnorm"))
    dots = read.select("key", "part", "norm", F.explode("known").alias("k")).select(
        "key", "part", "norm", "k.*").join(F.broadcast(weights), "term").groupBy(
        "key", "part", "tid", "license").agg(
        F.sum(F.col("n") * F.col("tf") * F.pow("idf", 2)).alias("dot"), F.max("norm").alias("norm"))
    score = F.round(SCALE * F.col("dot") / F.sqrt(F.col("norm") * F.col("tnorm"))).cast("long")
    best = dots.join(F.broadcast(template_norm), "tid").select(
        "key", "part", score.alias("score"), "license")
    return best.groupBy("key", "part").agg(
        F.max("score").alias("score"),
        F.min_by("license", F.struct(-F.col("score"), "license")).alias("license"))


def directories(path: Column) -> Column:
    """The directories above a path, nearest first: ``a/b`` and ``a`` for ``a/b/c.txt``."""
    names = F.split(path, "/")
    return F.transform(F.sequence(F.size(names) - 1, F.lit(0), F.lit(-1)),
                       lambda n: F.array_join(F.slice(names, 1, n), "/"))


def scan_licenses(files: DataFrame, templates: list[tuple[str, str]] | None = None,
                  header_score: int = HEADER_SCORE, file_score: int = FILE_SCORE) -> DataFrame:
    """``files`` (id, path, text): id, path, own_license, own_score, license_file, license,
    inherited_from (path of the license file, null for an own license)."""
    files = files.select("id", "path", "text")
    total = files.count()
    weights = stored(template_weights(files, templates or TEMPLATES).withColumn(
        "idf", _idf(F.col("df"), total)), "license-weights")
    unseen = F.lit(round(math.log(total + 1) + 1, 6))
    rows = weights.collect()

    def may(threshold: int) -> Column:
        """Whether a text holds a word that it needs to reach the threshold."""
        return F.lower("text").rlike(holds(needed_words(rows, threshold / SCALE)))

    # repeated rows share a key: their counts are multiples, their cosines the same
    key = F.xxhash64("id", "path", "text")
    sentences = files.where(may(header_score)).select(key.alias("key"), F.posexplode(F.split(
        "text", _BREAK)).alias("part", "text")).where(may(header_score))
    likely = files.where(may(file_score)).select(key.alias("key"), "text")
    headers = cosine(sentences, weights, unseen).where(F.col("score") >= header_score).groupBy(
        "key").agg(F.max("score").alias("own_score"), F.min_by("license", F.struct(
            -F.col("score"), "license")).alias("own_license"))
    whole = cosine(likely.withColumn("part", F.lit(0)), weights, unseen).where(
        F.col("score") >= file_score).select(
        "key", F.col("score").alias("file_score"), F.col("license").alias("file_license"))
    found = headers.join(whole, "key", "full_outer").select(
        "key", F.coalesce("own_license", "file_license").alias("own_license"),
        F.coalesce("own_score", "file_score").alias("own_score"),
        F.col("file_license").isNotNull().alias("license_file"))
    names = files.select("id", "path", key.alias("key"))
    marked = stored(names.join(found, "key", "left"), "license-marks")
    # one license file per directory; every directory meets those above it, nearest first
    parent = directories(F.col("path"))[0]
    holders = marked.where(F.col("license_file") & F.col("path").isNotNull()).groupBy(
        parent.alias("above")).agg(
        F.min("path").alias("from_path"), F.min_by("own_license", F.struct(
            "path", "own_license")).alias("from_license"))
    places = marked.where(F.col("path").isNotNull()).select(
        parent.alias("directory")).distinct().select(
        "directory", F.posexplode(F.concat(F.array("directory"), F.when(
            F.col("directory") != "", directories(F.col("directory"))).otherwise(
            F.array().cast("array<string>")))).alias("steps", "above"))
    near = places.join(holders, "above").groupBy("directory").agg(
        F.min_by(F.struct("from_path", "from_license"), "steps").alias("near"))
    return marked.withColumn("directory", parent).join(near, "directory", "left").select(
        "id", "path", "own_license", "own_score",
        F.coalesce("license_file", F.lit(False)).alias("license_file"),
        F.coalesce("own_license", "near.from_license").alias("license"),
        F.when(F.col("own_license").isNull(), F.col("near.from_path")).alias("inherited_from"))


_PATH = "source || '/' || lang || '/' || CAST(doc_id // 40 AS VARCHAR) || '/' || CAST(doc_id AS VARCHAR) || '.txt'"
_LIST = ", ".join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate(TEMPLATES))
_SQL = f"""
WITH files AS (
  SELECT doc_id AS id, {_PATH} AS path, text FROM documents),
total AS (SELECT count(*) AS n FROM files),
templates(tid, license, template) AS (VALUES {_LIST}),
terms AS (
  SELECT tid, license, term, count(*) AS tf FROM (
    SELECT tid, license, unnest(regexp_extract_all(lower(template), '{_WORD}')) AS term
    FROM templates) GROUP BY ALL),
seen AS (
  SELECT term, count(*) AS df FROM (
    SELECT unnest(list_distinct(regexp_extract_all(lower(text), '{_WORD}'))) AS term FROM files)
  WHERE term IN (SELECT term FROM terms) GROUP BY term),
weights AS MATERIALIZED (
  SELECT tid, license, term, tf,
    round(ln((total.n + 1)::DOUBLE / (coalesce(df, 0) + 1)) + 1, 6) AS idf
  FROM terms LEFT JOIN seen USING (term), total),
tnorms AS (SELECT tid, sum((tf * idf) ** 2) AS tnorm FROM weights GROUP BY tid),
parts AS (
  SELECT id, 0 AS part, text FROM files UNION ALL
  SELECT id, row_number() OVER () AS part, text FROM (
    SELECT id, unnest(regexp_split_to_array(text, '{_BREAK}')) AS text FROM files)),
counts AS MATERIALIZED (
  SELECT id, part, term, count(*) AS n FROM (
    SELECT id, part, unnest(regexp_extract_all(lower(text), '{_WORD}')) AS term FROM parts)
  GROUP BY ALL),
norms AS (
  SELECT id, part, sum((n * coalesce(idf, (SELECT round(ln(n + 1) + 1, 6) FROM total))) ** 2)
    AS norm FROM counts LEFT JOIN (SELECT DISTINCT term, idf FROM weights) USING (term)
  GROUP BY ALL),
scored AS (
  SELECT id, part, license, CAST(round({SCALE} * dot / sqrt(norm * tnorm)) AS BIGINT) AS score
  FROM (SELECT id, part, tid, license, sum(n * tf * idf ** 2) AS dot
        FROM counts JOIN weights USING (term) GROUP BY ALL)
  JOIN tnorms USING (tid) JOIN norms USING (id, part)),
headers AS (
  SELECT id, max(score) AS own_score, arg_min(license, (-score, license)) AS own_license
  FROM scored WHERE part > 0 AND score >= {HEADER_SCORE} GROUP BY id),
whole AS (
  SELECT id, max(score) AS file_score, arg_min(license, (-score, license)) AS file_license
  FROM scored WHERE part = 0 AND score >= {FILE_SCORE} GROUP BY id),
marked AS MATERIALIZED (
  SELECT f.id, f.path, coalesce(own_license, file_license) AS own_license,
    coalesce(own_score, file_score) AS own_score, file_license IS NOT NULL AS license_file,
    array_to_string(string_split(path, '/')[:-2], '/') AS directory
  FROM files f LEFT JOIN headers USING (id) LEFT JOIN whole USING (id)),
holders AS (
  SELECT directory AS above, min(path) AS from_path, arg_min(own_license, path) AS from_license
  FROM marked WHERE license_file GROUP BY directory),
near AS (
  SELECT m.directory, arg_max(h.from_path, length(h.above)) AS from_path,
    arg_max(h.from_license, length(h.above)) AS from_license
  FROM (SELECT DISTINCT directory FROM marked) m JOIN holders h
    ON m.directory = h.above OR starts_with(m.directory, h.above || '/') OR h.above = ''
  GROUP BY m.directory)
SELECT id AS doc_id, path, own_license, own_score, license_file,
  coalesce(own_license, from_license) AS license,
  CASE WHEN own_license IS NULL THEN from_path END AS inherited_from
FROM marked LEFT JOIN near USING (directory)"""


@C.query("op8_licenses", _SQL)
def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: source / language / shelf of forty ids / id."""
    doc_id = F.col("doc_id").cast("string")
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 40).cast("string"),
                       F.concat(doc_id, F.lit(".txt")))
    files = C.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), path.alias("path"), "text")
    return scan_licenses(files).withColumnRenamed("id", "doc_id")
