"""Spelling variants: frequent words one edit apart, by dense comparison of common prefixes and suffixes."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm.common import raw_texts, text_of, written

#: A word form counts as the usual one if it is so many times as frequent.
RATIO = 5
#: One of so many runs loses a letter, by a hash of its document and its letters.
THINNED = 199
#: Words of a tile's side; a larger block is dealt to pairs of chunks of about this size.
CHUNK = 4096
#: Distinct words a task counts before it hands them on, code units of a text looked at together, cells compared together.
HELD_WORDS = 300_000
PIECE = 1 << 20
CELLS = 1 << 24

RUNS = re.compile("[a-zÀ-ÿ]+")


def count_words(docs: DataFrame, min_length: int = 6, min_count: int = 5, id_col: str = "doc_id", text_col: str = "text",
                thinned: int = THINNED) -> DataFrame:
    """(word, n): the runs of letters of all texts, lower-cased in A-Z, that are long and frequent enough.

    One of `thinned` runs, by the crc32 of document id, colon and run, loses one code point. A null
    text has no run, a null id reads as empty text, repeated rows count each time. Whole texts are
    read in pieces; counts are added up in the tasks before the shuffle, so a frequent word gathers
    one row per task. No other column is read.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), text_of(text_col).alias("text"))
    counted = rows.mapInArrow(partial(_count_runs, min_length=min_length, thinned=thinned), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _count_runs(batches: Iterator[pa.RecordBatch], min_length: int, thinned: int) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()
    for batch in batches:
        for key, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1))):
            base = zlib.crc32(f"{key}:".encode())
            for piece in pieces(raw.lower().decode()):
                runs = Counter(run for run in RUNS.findall(piece) if len(run) >= min_length)
                counts.update(runs)
                for run, times in runs.items():
                    value = zlib.crc32(run.encode(), base)
                    if value % thinned == 0:
                        counts[run] -= times
                        at = value % len(run)
                        if len(run) > min_length:
                            counts[run[:at] + run[at + 1:]] += times
            if len(counts) > HELD_WORDS:
                yield _counted(counts)
                counts.clear()
    yield _counted(counts)


def _counted(counts: Counter[str]) -> pa.RecordBatch:
    kept = [(w, n) for w, n in counts.items() if n]
    return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])


def pieces(text: str) -> Iterator[str]:
    """A text in pieces of about PIECE characters that cut no run."""
    at = 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        if end < len(text) and (rest := RUNS.match(text, end)):
            end = rest.end()
        yield text[at:end]
        at = end


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n) of every word (word, n) that another word is one edit away from.

    n_near counts those words, form is the most frequent of them (ties: the least in code-point
    order) and form_n its n. Words must differ from each other and have three code points or more.

    Let L be the longer length of two words one edit apart: their common prefix and suffix reach
    L - 1. Cut [0, L) in three: the edit spares two parts, so the words agree on the first two, on
    the last two, or on both ends. Each word enters three blocks as one of length L and three as one
    of length L - 1. A block's words become a matrix of padded code points that is compared with
    itself, diagonal by diagonal; larger blocks are dealt to pairs of chunks. A pair counts in the first
    block kind it shares alone, so nothing has to be removed later and no pair leaves a task.
    """
    blocks = words.select("word", F.col("n").cast("long").alias("n"), F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("longer"))
    third = F.floor(F.col("longer") / 3).cast("int")
    back = F.col("longer") - third
    keys = [F.expr("left(word, back)"), F.expr("right(word, back)"), F.concat(F.expr("left(word, third)"), F.lit(" "), F.expr("right(word, third)"))]
    blocks = blocks.withColumn("third", third).withColumn("back", back).select(
        "word", "n", "longer", F.posexplode(F.array(*keys)).alias("kind", "part"))
    blocks = blocks.select("word", "n", "longer", "kind", F.xxhash64("longer", "kind", "part").alias("block"))
    large = blocks.groupBy("block").count().filter(F.col("count") > CHUNK).select("block", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks"))
    dealt = blocks.join(large, "block", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("word"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("longer", "block", "kind", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "word", "n")
    tiles = dealt.repartition("block", "low", "high").sortWithinPartitions("longer", "block", "kind", "low", "high")
    found = tiles.mapInArrow(_compare_tiles, T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType()), T.StructField("n_near", T.LongType()),
                                                           T.StructField("form", T.StringType()), T.StructField("form_n", T.LongType())]))
    best = F.min(F.struct((-F.col("form_n")).alias("order"), F.col("form")))
    return found.groupBy("word").agg(F.first("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n", "n_near", F.col("best.form").alias("form"), (-F.col("best.order")).alias("form_n"))


def _compare_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare whole tiles; a tile that a batch's end cuts waits for the rest."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        begin = _tile_starts(rows)
        cut = int(begin[-1])
        if cut or (held and not _same_tile(held[-1], rows)):
            done = pa.concat_tables([*held, rows.slice(0, cut)])
            held = [rows.slice(cut)]
            yield from _compare(done)
        else:
            held.append(rows)
    if held:
        yield from _compare(pa.concat_tables(held))


TILE = ("longer", "block", "kind", "low", "high")


def _tile_starts(rows: pa.Table) -> np.ndarray:
    changed = np.zeros(len(rows), bool)
    changed[:1] = True
    for name in TILE:
        value = rows.column(name).to_numpy()
        changed[1:] |= value[1:] != value[:-1]
    return np.flatnonzero(changed)


def _same_tile(before: pa.Table, after: pa.Table) -> bool:
    return all(before.column(name)[-1].as_py() == after.column(name)[0].as_py() for name in TILE)


def _compare(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Compare the tiles of a table; lengths are taken one by one, so that matrices are as wide as their words."""
    begin = _tile_starts(rows)
    size = np.diff(np.r_[begin, len(rows)])
    row_size = np.repeat(size, size)
    rows = rows.filter(pa.array(row_size > 1))
    if not len(rows):
        return
    longer = rows.column("longer").to_numpy()
    edges = np.r_[0, np.flatnonzero(np.diff(longer)) + 1, len(rows)]
    for first, last in zip(edges[:-1], edges[1:]):
        yield from _compare_length(rows.slice(first, last - first), int(longer[first]))


def code_points(words: list[str], width: int) -> np.ndarray:
    """Words as rows of code points, padded by zeros."""
    points = np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width)
    return points.astype(np.uint8) if points.max(initial=0) < 256 else points


def _compare_length(rows: pa.Table, longer: int) -> Iterator[pa.RecordBatch]:
    words, n = rows.column("word").to_pylist(), rows.column("n").to_numpy()
    kind, chunk, low, high = (rows.column(name).to_numpy() for name in ("kind", "chunk", "low", "high"))
    begin = _tile_starts(rows)
    size = np.diff(np.r_[begin, len(rows)])
    end = np.repeat(begin + size, size)
    length = np.array([len(word) for word in words])
    ahead = code_points(words, longer)
    behind = code_points([word[::-1] for word in words], longer)
    third = longer // 3
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    n_near, best = np.zeros(len(words), np.int64), np.full(len(words), len(words))
    open_rows, step = np.arange(len(words)), 0
    slice_rows = max(1, CELLS // longer)
    while True:
        step += 1
        open_rows = open_rows[end[open_rows] > open_rows + step]
        if not len(open_rows):
            break
        for first in range(0, len(open_rows), slice_rows):
            a = open_rows[first:first + slice_rows]
            b = a + step
            wanted = (np.maximum(length[a], length[b]) == longer) & ((low[a] == high[a]) | (chunk[a] != chunk[b]))
            a, b = a[wanted], b[wanted]
            prefix, suffix = _common(ahead[a], ahead[b]), _common(behind[a], behind[b])
            first_kind = np.where(prefix >= longer - third, 0, np.where(suffix >= longer - third, 1, 2))
            near = (prefix + suffix >= longer - 1) & (prefix < longer) & (first_kind == kind[a])
            a, b = a[near], b[near]
            n_near[a] += 1
            n_near[b] += 1
            best[a] = np.minimum(best[a], rank[b])
            best[b] = np.minimum(best[b], rank[a])
    hit = np.flatnonzero(n_near)
    if len(hit):
        form = [order[i] for i in best[hit]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([words[i] for i in hit], pa.string()), pa.array(n[hit], pa.int64()), pa.array(n_near[hit], pa.int64()),
             pa.array([words[i] for i in form], pa.string()), pa.array(n[form], pa.int64())], names=["word", "n", "n_near", "form", "form_n"])


def _common(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Length of the common start of each row; padding beyond the shorter word differs."""
    differ = left != right
    return np.where(differ.any(axis=1), differ.argmax(axis=1), left.shape[1])


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every distinct word of (word, n).

    form: the near word of largest n if that is at least ratio times the word's; root: the last
    word that forms lead to. A chain of forms grows by that ratio, so its length is bounded by a
    logarithm of the largest n, and pointers that double find its end in a logarithm of that.
    An empty table gives an empty one.
    """
    words = written(words)
    near = near_words(words)
    usual = F.col("form_n") >= ratio * F.col("n")
    near = written(near.withColumn("form", F.when(usual, F.col("form"))).withColumn("form_n", F.when(usual, F.col("form_n"))))
    least, most = words.agg(F.min("n"), F.max("n")).first()
    chain = 0 if not most else int(log(most / max(least, 1), ratio) + 1e-9)
    ends = near.filter("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(ceil(log2(chain)) if chain > 1 else 0):
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ends = written(ends.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    result = words.join(near.select("word", "form", "n_near", "form_n"), "word", "left").join(ends, "word", "left")
    return result.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def group_variants(docs: DataFrame) -> DataFrame:
    """The variants among the words of whole texts, with the default lengths and counts."""
    return variants(count_words(docs))


#: The same in SQL: crc32 by its table, near words by the patterns that one edit leaves.
SQL = r"""
with steps as (
  select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, x: xor(c >> 1, (c & 1) * 3988292384))) as t
), runs as (
  select cast(doc_id as varchar) as id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')) as raw from documents
), lowered as (
  select coalesce(id, '') as id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as times
  from runs group by 1, 2
), long_runs as (
  select *, hex(encode(id || ':' || run)) as h from lowered where length(run) >= 6
), crc as (
  select run, times, xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(range(length(h) // 2),
      lambda i: (strpos('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as v
  from long_runs, steps
), thinned as (
  select case when v % 199 = 0 then left(run, cast(v % length(run) as int)) || substr(run, cast(v % length(run) as int) + 2) else run end as word, times from crc
), words as (
  select word, cast(sum(times) as bigint) as n from thinned where length(word) >= 6 group by 1 having sum(times) >= 5
), cuts as (
  select word, n, i, left(word, i) as a, substr(word, i + 2) as b from (select *, unnest(range(cast(length(word) as int))) as i from words)
), pairs as (
  select x.word, x.n, y.word as near, y.n as near_n from cuts x join cuts y on x.a = y.a and x.b = y.b and x.word <> y.word
  union
  select c.word, c.n, w.word, w.n from cuts c join words w on c.a || c.b = w.word
  union
  select w.word, w.n, c.word, c.n from cuts c join words w on c.a || c.b = w.word
), near as (
  select word, n, count(distinct near) as n_near, max(near_n) as top from pairs group by 1, 2
), forms as (
  select near.word, near.n, n_near, min(case when top >= 5 * near.n then p.near end) as form, min(case when top >= 5 * near.n then top end) as form_n
  from near join pairs p on p.word = near.word and p.near_n = top group by 1, 2, 3
), chain as (
  with recursive r(word, root, depth) as (
    select word, word, 0 from words union all select r.word, f.form, depth + 1 from r join forms f on r.root = f.word where f.form is not null
  ) select word, arg_max(root, depth) as root from r group by 1
)
select words.word, form, root, words.n, cast(coalesce(n_near, 0) as bigint) as n_near, cast(form_n as bigint) as form_n
from words left join forms using (word) join chain using (word)
"""
