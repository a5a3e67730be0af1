"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions alone."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import table, written

#: ASCII characters that are neither digits nor letters part words.
PARTING = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
WINDOW_WORDS = 10
SHINGLE_WORDS = 3


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", window: int = WINDOW_WORDS, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """Per row of docs: (id_col, n_words, n_hit, n_items, items_sha256, contaminated).

    A window is `window` consecutive words of an item, or the whole of a shorter item. As
    a set of word shingles a window is contained in a text only with all of them, so one
    of them is a sufficient prefix: the one rarest in the corpus. A text position that
    holds it is a candidate if the window fits into the text around it; candidates are
    compared word by word.

    Null text has no words; an item without words, or a null one, has no window; an empty
    benchmark leaves every row clean. Repeated windows and items count once, a repeated or
    null id keeps a row for each given row. Windows of an item without an id hit like others; only
    the number and the digest of item ids leave it out. Other columns are not read.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    items = (benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(F.col("text")).alias("words"))
             .filter("size(words) > 0"))
    windows = written(_windows(items, window))
    lengths = [r.k for r in windows.select(F.least(F.lit(shingle), "length").alias("k")).distinct().collect()]
    keys = written(_prefixes(windows, texts, lengths, shingle))
    return _verified(texts, _candidates(texts, keys, lengths), windows, id_col)


def words_of(text: Column) -> Column:
    """Lower-cased words, as an array; null text has none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), ascii_uppercase + PARTING, ascii_lowercase + " " * len(PARTING))
    return F.array_remove(F.split(spaced, " "), "")


def _windows(items: DataFrame, window: int) -> DataFrame:
    """(window, length, item): the distinct windows of every item, their words joined by spaces."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))
    spans = items.select("item", F.explode(F.transform(starts, lambda s: F.slice("words", s + 1, window))).alias("w"))
    return spans.select(F.array_join("w", " ").alias("window"), F.size("w").alias("length"), "item").distinct()


def _shingles(words: Column, lengths: list[int]) -> Column:
    """Hashes of all shingles of the given lengths, as an array of (k, at, key)."""
    def of(k: int) -> Column:
        last = F.size(words) - k
        hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(
            i.alias("at"), F.xxhash64(F.lit(k), *[F.get(words, i + j) for j in range(k)]).alias("key")))
        return F.when(last >= 0, hashes)
    return F.concat(*[F.coalesce(of(k), F.array().cast("array<struct<at:int,key:bigint>>")) for k in lengths])


def _exploded(texts: DataFrame, lengths: list[int]) -> DataFrame:
    """(id, n_words, at, key) of every shingle of the texts; empty if no length is asked for."""
    words = texts.select("id", words_of(F.col("text")).alias("words"))
    if not lengths:
        return words.select("id", F.size("words").alias("n_words"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("key")).filter("false")
    return words.select("id", F.size("words").alias("n_words"), F.explode(_shingles(F.col("words"), lengths)).alias("s")).select("id", "n_words", "s.*")


def _prefixes(windows: DataFrame, texts: DataFrame, lengths: list[int], shingle: int) -> DataFrame:
    """(key, offset, length, window): per window its rarest shingle, by number in the texts.

    A window with a shingle that no text holds occurs nowhere and is left out.
    """
    distinct = windows.select("window", "length").distinct()
    words = F.split("window", " ")
    parts = F.lit(None).cast("array<struct<at:int,key:bigint>>")
    for k in lengths:
        parts = F.when(F.least(F.lit(shingle), "length") == k, _shingles(words, [k])).otherwise(parts)
    tokens = written(distinct.select("window", "length", F.explode(parts).alias("s")).select("window", "length", "s.*"))
    wanted = tokens.select("key").distinct()
    counts = _exploded(texts, lengths).select("key").join(wanted, "key").groupBy("key").agg(F.count("*").alias("n"))
    ranked = tokens.join(counts, "key", "left").select("window", "length", "at", "key", F.coalesce("n", F.lit(0)).alias("n"))
    first = ranked.groupBy("window", "length").agg(F.min(F.struct("n", "key", "at")).alias("rarest"))
    return first.filter("rarest.n > 0").select("rarest.key", F.col("rarest.at").alias("offset"), "length", "window")


def _candidates(texts: DataFrame, keys: DataFrame, lengths: list[int]) -> DataFrame:
    """(id, found): the windows that may start at a word of a text, by their rarest shingle and by position and length."""
    near = _exploded(texts, lengths).join(keys, "key").withColumn("start", F.col("at") - F.col("offset"))
    near = near.filter((F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.col("n_words")))
    return near.groupBy("id").agg(F.collect_set(F.struct("start", "length", "window")).alias("found"))


def _verified(texts: DataFrame, candidates: DataFrame, windows: DataFrame, id_col: str) -> DataFrame:
    """Candidates compared with the words of each text; then hits, items and their digest."""
    rows = texts.join(candidates.withColumnRenamed("id", "of"), F.col("id").eqNullSafe(F.col("of")), "left")
    rows = rows.select("id", words_of(F.col("text")).alias("words"), "found")
    same = F.filter("found", lambda c: (c["start"] + c["length"] <= F.size("words"))
                    & (F.array_join(F.slice("words", c["start"] + 1, c["length"]), " ") == c["window"]))
    rows = rows.select("id", F.size("words").alias("n_words"), same.alias("hits"))
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["length"] - 1))))
    rows = written(rows.select(
        "id", F.monotonically_increasing_id().alias("row"), F.col("n_words").cast("long").alias("n_words"),
        F.coalesce(F.size(covered).cast("long"), F.lit(0).cast("long")).alias("n_hit"),
        F.array_distinct(F.transform("hits", lambda h: h["window"])).alias("hit")))
    named = (rows.select("row", F.explode("hit").alias("window")).join(windows.filter("item is not null").select("window", "item"), "window")
             .select("row", "item").distinct().groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items")))
    found = F.coalesce("items", F.array().cast("array<string>"))
    return rows.join(named, "row", "left").select(
        F.col("id").alias(id_col), "n_words", F.when(F.size("hit") > 0, F.col("n_hit")).otherwise(F.lit(0).cast("long")).alias("n_hit"),
        F.size(found).cast("long").alias("n_items"), F.sha2(F.array_join(found, ","), 256).alias("items_sha256"),
        (F.coalesce(F.size("hit"), F.lit(0)) > 0).alias("contaminated"))


def keep_clean(spark, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline stage: the documents that hold no window of a benchmark item.

    Rows that share an id are one document: if one of them holds a window, all go. Rows
    without an id are judged together in the same way.
    """
    hit = contamination(docs.select("doc_id", "text"), table(spark, folder, "benchmark")).filter("contaminated")
    # written, so that its size is known: texts are not shuffled for a few hits
    hit = written(hit.select(F.col("doc_id").alias("gone")).distinct())
    return docs.join(hit, docs.doc_id.eqNullSafe(hit.gone), "left_anti")


SQL = r"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
              FROM benchmark WHERE text IS NOT NULL),
grams AS (SELECT DISTINCT item, array_to_string(w[s + 1 : s + 10], ' ') AS gram, least(len(w), 10) AS size
          FROM item, unnest(range(greatest(len(w) - 10, 0) + 1)) AS u(s) WHERE len(w) > 0),
doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM grams),
places AS (SELECT doc_id, s, size, array_to_string(w[s + 1 : s + size], ' ') AS gram
           FROM doc, sizes, unnest(range(greatest(len(w) - size + 1, 0))) AS u(s)),
hits AS (SELECT p.doc_id, p.s, p.size, g.item FROM places p JOIN grams g ON p.gram = g.gram AND p.size = g.size),
covered AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS place FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
