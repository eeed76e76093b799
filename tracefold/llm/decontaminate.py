"""Benchmark decontamination by template canonicalisation.

Texts become tokens; numbers, names (capitalised words, wherever they stand) and units (after
a number) turn into typed placeholders. Windows of eight tokens are hash-joined with those of
the benchmark items in two forms: as templates, and as plain lower-case words, so that a copy
in other case is found too. A window of which most tokens are placeholders says little as a
template; it has the plain form only.

An item is found where half of its windows lie in one band of a document: matches may drift by
up to ``DRIFT`` tokens against each other, so inserted or deleted words cost only the windows
they stand in. Names must be consistent: each name of the item stands for the name that most
of the band's windows give it (of equals the largest), and windows that say otherwise do not
count. Numbers and units are free at every place, and a window equal in all values counts
always. A question asked again with other numbers or names is therefore found, a chance
likeness of templates is not.

Items of 12 to 23 tokens have windows of five, so that one inserted word leaves half of them;
an item of fewer than eight tokens is one shorter window. Documents are first narrowed,
without loss, to those that hold the longest word of enough windows of one item, and their
windows to those around such words.

DataFrame operations only. Null or empty texts and items match nothing. Repeated rows of a
document are reported once; a null doc_id is kept as such; an empty table gives an empty
result; other columns are not used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm import common as C
from tracefold.sources.sinks import stored

WINDOW = 8
SHORT_WINDOW = 5
#: Items of this many tokens have short windows.
SHORT_ITEMS = (12, 23)
MIN_COVERAGE = 0.5
DRIFT = 8
#: Texts that hold more of the items' words have all their windows hashed, not those around them.
ANCHOR_WORDS = 128

# Units, as they stand after a number.
UNITS = ["km", "m", "cm", "mm", "mile", "miles", "meter", "meters", "metre", "metres", "foot",
         "feet", "inch", "inches", "kg", "g", "mg", "gram", "grams", "pound", "pounds", "ton",
         "tons", "l", "ml", "liter", "liters", "litre", "litres", "second", "seconds", "s",
         "minute", "minutes", "min", "hour", "hours", "h", "day", "days", "week", "weeks",
         "month", "months", "year", "years", "dollar", "dollars", "euro", "euros", "cent",
         "cents", "percent", "degree", "degrees", "kmh", "mph", "volt", "volts", "watt", "watts"]

_NUMBER = r"\p{N}+(?:[.,]\p{N}+)*"
_WORD = r"\p{L}+(?:['’-]\p{L}+)*"
_TOKEN = rf"({_NUMBER}|{_WORD}|[.!?:\n])"


def plain_tokens(text: Column) -> Column:
    """Lower-cased words, numbers and sentence ends."""
    return F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(1))


def _is_end(token: Column) -> Column:
    return token.rlike(r"^[.!?:\n]$")


def typed_tokens(text: Column) -> Column:
    """array<struct<kind, value>>: kind is the word itself or '<num>', '<name>', '<unit>'."""
    def typed(p: Column) -> Column:
        token, value = p["t"], F.lower(p["t"])
        kind = F.when(token.rlike(r"^\p{N}"), F.lit("<num>")).when(
            p["b"].rlike(r"^\p{N}") & value.isin(UNITS), F.lit("<unit>")).when(
            token.rlike(r"^\p{Lu}"), F.lit("<name>")).otherwise(value)
        return F.struct(kind.alias("kind"), value.alias("value"))

    def of(raw: Column) -> Column:
        # every token with the one before it
        pairs = F.zip_with(raw, F.concat(F.array(F.lit(".")), raw), lambda t, b: F.struct(
            t.alias("t"), b.alias("b")))
        return F.transform(F.filter(pairs, lambda p: p["t"].isNotNull() & ~_is_end(p["t"])), typed)

    return _bound(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(1)), of)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` (an array) with the value computed once a row, not once a use."""
    return F.flatten(F.transform(F.array(value), use))


def _is_slot(token: Column) -> Column:
    return token["kind"] != token["value"]


def window_size(tokens: Column, window: int = WINDOW) -> Column:
    """The window size of an item of so many tokens."""
    return F.when(tokens.between(*SHORT_ITEMS), F.lit(min(window, SHORT_WINDOW))).otherwise(
        F.least(F.lit(window), tokens))


def windows(rows: DataFrame, *keep: str, longest: bool = False) -> DataFrame:
    """One or two rows per window of ``tokens``: at, n, hash of its plain or template form, slots.

    ``sizes`` is an array of window sizes; sizes beyond the number of tokens give no row.
    ``words`` holds hashes of words of which a window must hold one (null: all windows stay).
    Plain forms have no slots. ``longest`` adds the longest word that both forms imply.
    Windows are cut inside the row, so that a long text is not copied to each of them.
    """
    def starts(text: Column, n: Column) -> Column:
        last = F.size(text["tokens"]) - n + 1
        around = F.array_distinct(F.flatten(F.transform(text["places"], lambda p: F.sequence(
            F.greatest(F.lit(1), p - n + 1), F.least(p, last)))))
        return F.when(last < 1, F.array().cast("array<int>")).otherwise(
            F.coalesce(around, F.sequence(F.lit(1), last)))

    def cut(text: Column) -> Column:
        return F.flatten(F.transform("sizes", lambda n: F.transform(
            starts(text, n), lambda i: F.struct(
                i.alias("at"), n.alias("n"), F.slice(text["values"], i, n).alias("values"),
                F.slice(text["kinds"], i, n).alias("kinds"),
                F.filter(F.slice(text["tokens"], i, n), _is_slot).alias("slots"),
                *([F.slice(text["tokens"], i, n).alias("part")] if longest else [])))))

    def placed(text: Column) -> Column:
        places = F.array_compact(F.transform(text["values"], lambda v, i: F.when(
            F.array_contains(text["held"], v), i + 1)))
        return F.struct(*(text[c].alias(c) for c in ("tokens", "kinds", "values")), F.when(
            F.size(text["held"]) <= ANCHOR_WORDS, places).alias("places"))

    hashed = F.transform(F.array("tokens"), lambda t: F.struct(
        t.alias("tokens"), F.transform(t, lambda x: F.xxhash64(x["kind"])).alias("kinds"),
        F.transform(t, lambda x: F.xxhash64(x["value"])).alias("values")))
    held = F.transform(hashed, lambda t: F.struct(
        *(t[c].alias(c) for c in ("tokens", "kinds", "values")),
        F.array_intersect("words", t["values"]).alias("held")))
    one = rows.select(*keep, F.explode(F.flatten(F.transform(
        F.transform(held, placed), cut))).alias("w")).select(*keep, "w.*")
    is_template = F.size("slots").between(1, F.floor(F.col("n") / 2))
    slots = F.transform("slots", lambda t: F.struct(
        (t["kind"] == "<name>").alias("name"), t["value"].alias("value")))
    plain = F.struct(F.xxhash64("values").alias("hash"), F.array().cast(
        "array<struct<name:boolean,value:string>>").alias("slots"))
    template = F.struct(F.xxhash64("kinds").alias("hash"), slots.alias("slots"))
    extra = []
    if longest:
        words = F.when(is_template, F.filter("part", lambda t: ~_is_slot(t))).otherwise(
            F.col("part"))
        extra = [F.array_max(F.transform(words, lambda t: F.struct(
            F.length(t["value"]).alias("n"), t["value"].alias("value"))))["value"].alias("longest")]
    return one.select(*keep, "at", "n", *extra, F.explode(F.when(is_template, F.array(
        plain, template)).otherwise(F.array(plain))).alias("form")).select(
        *keep, "at", "n", "form.*", *(["longest"] if longest else []))


def text_key() -> Column:
    return F.xxhash64("doc_id", "text")


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                 min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """doc_id, key (of id and text), item_id, matched, item_windows, coverage, slot_pairs."""
    items = benchmark.select("item_id", typed_tokens(F.col("text")).alias("tokens")).where(
        F.size("tokens") > 0)
    item_windows = stored(windows(items.select(
        "item_id", "tokens", F.array(window_size(F.size("tokens"), window)).alias("sizes"),
        F.lit(None).cast("array<bigint>").alias("words")), "item_id", longest=True).distinct(),
        "item-windows")
    totals = item_windows.groupBy("item_id").agg(F.count_distinct("at").alias("item_windows"))
    # documents with the longest words of enough windows of an item
    anchors = item_windows.groupBy("item_id", "longest").agg(F.count_distinct("at").alias("n"))
    held = docs.select(text_key().alias("key"), F.explode(F.array_distinct(
        plain_tokens(F.col("text")))).alias("longest")).join(anchors, "longest").groupBy(
        "key", "item_id").agg(F.sum("n").alias("n"))
    wanted = item_windows.groupBy("item_id").agg(
        F.collect_set(F.xxhash64("longest")).alias("words"), F.collect_set("n").alias("sizes"))
    likely = held.join(totals, "item_id").where(
        F.col("n") >= min_coverage * F.col("item_windows")).join(wanted, "item_id").groupBy(
        "key").agg(*(F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
                     for c in ("words", "sizes")))
    some = stored(docs.select("doc_id", "text", text_key().alias("key")).join(
        likely, "key").dropDuplicates(["key"]), "likely-documents")
    doc_windows = windows(some.select("doc_id", "key", "sizes", "words", typed_tokens(
        F.col("text")).alias("tokens")), "doc_id", "key").drop("n")
    diagonal = F.col("doc_at") - F.col("at")
    hits = stored(doc_windows.withColumnsRenamed({"at": "doc_at", "slots": "doc_slots"}).join(
        item_windows.select("item_id", "hash", "at", "slots"), "hash").select(
        "doc_id", "key", "item_id", "at", diagonal.alias("diagonal"), F.zip_with(
            "slots", "doc_slots", lambda a, b: F.struct(
                a["name"].alias("name"), a["value"].alias("item_value"),
                b["value"].alias("doc_value"))).alias("pairs")), "item-hits")
    return _found(hits, totals, min_coverage)


def _found(hits: DataFrame, totals: DataFrame, min_coverage: float) -> DataFrame:
    """Items whose consistent windows in one band of a document are enough.

    Bands are 2 * DRIFT diagonals wide in two layouts, half a band apart, so that matches at
    most DRIFT apart share one. A group (document, item, band) has at most the item's own
    windows times the width of the band.
    """
    wide = 2 * DRIFT
    cells = hits.withColumn("cell", F.explode(F.array(
        2 * F.floor(F.col("diagonal") / wide), 2 * F.floor(
            (F.col("diagonal") + DRIFT) / wide) + 1))).drop("diagonal").distinct()
    band = ["key", "item_id", "cell"]
    votes = cells.select(*band, "at", F.explode(F.filter("pairs", lambda p: p["name"])).alias(
        "p")).groupBy(*band, "p.item_value", "p.doc_value").agg(
        F.count_distinct("at").alias("n"))
    agreed = votes.groupBy(*band, "item_value").agg(F.max(F.struct("n", "doc_value")).alias(
        "best")).groupBy(*band).agg(F.map_from_entries(F.collect_list(F.struct(
            "item_value", "best.doc_value"))).alias("agreed"))
    fits = F.forall("pairs", lambda p: ~p["name"] | (
        F.col("agreed")[p["item_value"]] == p["doc_value"]))
    placed = cells.join(agreed, band, "left").where(fits).groupBy(*band).agg(
        F.max("doc_id").alias("doc_id"), F.count_distinct("at").alias("matched"),
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    changed = F.size(F.filter("pairs", lambda p: p["item_value"] != p["doc_value"]))
    best = placed.join(totals, "item_id").where(
        F.col("matched") >= min_coverage * F.col("item_windows")).groupBy("key", "item_id").agg(
        F.max("doc_id").alias("doc_id"), F.max("item_windows").alias("item_windows"),
        F.max(F.struct("matched", (-changed).alias("same"))).alias("best"))
    return best.select(
        "doc_id", "key", "item_id", "best.matched", "item_windows",
        F.round(F.col("best.matched") / F.col("item_windows"), 6).alias("coverage"),
        (-F.col("best.same")).cast("long").alias("changed_slots"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents in which an item is found; all columns stay."""
    found = contaminated(docs, benchmark).select("key").distinct()
    return docs.withColumn("_key", text_key()).join(
        found.withColumnRenamed("key", "_key"), "_key", "left_anti").select(docs.columns)


_UNIT_LIST = ", ".join(f"'{u}'" for u in UNITS)
_TOKEN_SQL = _TOKEN.replace("'", "''")


def _tokens_sql(source: str, key: str) -> str:
    """Tokens of a table in order: key, i, kind, value."""
    return f"""
  SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY i) AS i, kind, value, n FROM (
    SELECT *, CASE WHEN regexp_matches(t, '^\\p{{N}}') THEN '<num>'
        WHEN regexp_matches(b, '^\\p{{N}}') AND lower(t) IN ({_UNIT_LIST}) THEN '<unit>'
        WHEN regexp_matches(t, '^\\p{{Lu}}') THEN '<name>'
        ELSE lower(t) END AS kind, lower(t) AS value,
      count(*) OVER (PARTITION BY {key}) AS n
    FROM (SELECT {key}, i, t, coalesce(lag(t) OVER (PARTITION BY {key} ORDER BY i), '.') AS b
      FROM (SELECT {key}, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM (
        SELECT {key}, regexp_extract_all(text, '{_TOKEN_SQL}') AS l FROM {source})))
    WHERE NOT regexp_matches(t, '^[.!?:\\n]$'))"""


def _windows_sql(tokens: str, key: str, size: int) -> str:
    """Whole windows of a token table, in their plain and their template form."""
    return f"""
  SELECT {key}, pos, n, {size} AS size, unnest(CASE WHEN len(slots) BETWEEN 1 AND {size // 2}
      THEN [{{hash: array_to_string(vals, ' '), slots: []}},
            {{hash: array_to_string(kinds, ' '), slots: slots}}]
      ELSE [{{hash: array_to_string(vals, ' '), slots: []}}] END) AS form
  FROM (SELECT {key}, i AS pos, n, list(kind) OVER w AS kinds, list(value) OVER w AS vals,
      coalesce(list({{name: kind = '<name>', value: value}}) FILTER (kind <> value) OVER w,
        []) AS slots
    FROM {tokens} WINDOW w AS (PARTITION BY {key} ORDER BY i
      ROWS BETWEEN CURRENT ROW AND {size - 1} FOLLOWING))
  WHERE pos + {size} - 1 <= n"""


# The benchmark items all have eight tokens or more, so two window sizes do for the SQL.
_SQL = f"""
WITH texts AS (SELECT DISTINCT doc_id, text FROM documents),
dt AS MATERIALIZED ({_tokens_sql("texts", "doc_id")}),
bt AS MATERIALIZED ({_tokens_sql("benchmark", "item_id")}),
dw AS ({_windows_sql("dt", "doc_id", WINDOW)}
  UNION ALL {_windows_sql("dt", "doc_id", SHORT_WINDOW)}),
bw AS MATERIALIZED (SELECT * FROM ({_windows_sql("bt", "item_id", WINDOW)}
  UNION ALL {_windows_sql("bt", "item_id", SHORT_WINDOW)})
  WHERE size = CASE WHEN n BETWEEN {SHORT_ITEMS[0]} AND {SHORT_ITEMS[1]} THEN {SHORT_WINDOW}
    ELSE {WINDOW} END),
totals AS (SELECT item_id, count(DISTINCT pos) AS item_windows FROM bw GROUP BY item_id),
hits AS MATERIALIZED (
  SELECT doc_id, item_id, bw.pos, dw.pos - bw.pos AS diagonal,
    list_zip(bw.form.slots, dw.form.slots) AS pairs
  FROM dw JOIN bw ON dw.form.hash = bw.form.hash),
cells AS MATERIALIZED (SELECT DISTINCT * FROM (
  SELECT doc_id, item_id, pos, pairs, unnest([2 * floor(diagonal / {2 * DRIFT}.0)::BIGINT,
    2 * floor((diagonal + {DRIFT}) / {2 * DRIFT}.0)::BIGINT + 1]) AS cell FROM hits)),
names AS MATERIALIZED (
  SELECT doc_id, item_id, cell, pos, pairs, p[1].value AS item_value, p[2].value AS doc_value
  FROM (SELECT *, unnest(pairs) AS p FROM cells) WHERE p[1].name),
agreed AS (
  SELECT DISTINCT ON (doc_id, item_id, cell, item_value) * FROM (
    SELECT doc_id, item_id, cell, item_value, doc_value, count(DISTINCT pos) AS n
    FROM names GROUP BY ALL)
  ORDER BY n DESC, doc_value DESC),
good AS (
  SELECT * FROM cells ANTI JOIN (
    SELECT names.* FROM names JOIN agreed USING (doc_id, item_id, cell, item_value)
    WHERE names.doc_value <> agreed.doc_value) USING (doc_id, item_id, cell, pos, pairs)),
counted AS (
  SELECT doc_id, item_id, cell, count(DISTINCT pos) AS matched,
    len(list_filter(list_distinct(flatten(list(pairs))),
      lambda p: p[1].value <> p[2].value)) AS changed
  FROM good GROUP BY ALL)
SELECT DISTINCT ON (doc_id, item_id) doc_id, item_id, matched, item_windows,
  round(matched / item_windows, 6) AS coverage, changed AS changed_slots
FROM counted JOIN totals USING (item_id) WHERE matched >= {MIN_COVERAGE} * item_windows
ORDER BY doc_id, item_id, matched DESC, changed"""


@C.query("op7_decontamination", _SQL)
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(C.table(spark, sf_dir, "documents"),
                        C.table(spark, sf_dir, "benchmark")).drop("key")
