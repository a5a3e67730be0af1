"""Removal of repeated byte strings by digests at least-hash positions, in place of sparse suffix arrays."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import sha256
from zlib import compress, decompress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm.common import raw_texts, text_of, written

#: Bytes of a string that must start elsewhere too, and of the sampled suffixes' sort prefix.
LENGTH = 200
PREFIX = 32
#: Batches the corpus is added in.
BATCHES = 4
#: Bytes looked at together; a longer text is read in overlapping pieces.
PIECE = 1 << 20
#: Distinct contexts of one prefix that one task resolves; beyond it their strings are counted as rows.
GROUP_LIMIT = 4096
#: Contexts resolved together.
BUFFER = 8192

_MASK = np.uint64(PIECE * 2 - 1)
_RANDOM = np.random.default_rng(20)
_BYTES = _RANDOM.integers(0, 2**64, (2, 256), dtype=np.uint64)
_BASES = [int(b) * 2 + 1 for b in _RANDOM.integers(2**61, 2**62, 2, dtype=np.uint64)]


def _powers(base: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(2 * PIECE - 1, base, np.uint64))])


_UP = [_powers(b) for b in _BASES]
_DOWN = [_powers(pow(b, -1, 2**64)) for b in _BASES]


def _sums(raw: np.ndarray, which: int) -> np.ndarray:
    """Prefix sums of a polynomial in the random numbers of the bytes, modulo 2^64."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[which][raw] * _UP[which][:len(raw)], out=out[1:])
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _digest(sums: np.ndarray, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Digest of bytes start .. end, the same wherever they stand."""
    return _mixed((sums[end] - sums[start]) * _DOWN[which][start])


def sampled_suffixes(raw: np.ndarray, length: int, prefix: int) -> tuple[np.ndarray, ...]:
    """The sparse suffix array's entries of a text: (key, digest, first, place, count).

    Every string of `length` bytes is filed under one of its own positions, the last one
    of least hash over `prefix` bytes, so equal strings are filed alike wherever they
    stand. An entry is a maximal run of strings filed under one position: key is the
    digest of the prefix there, digest that of all bytes of the run, first its start,
    place the position's distance from it, count its strings.
    """
    if len(raw) < length:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    sums = _sums(raw, 0)
    at = np.arange(len(raw) - prefix + 1, dtype=np.int64)
    hashes = _digest(sums, 0, at, at + prefix)
    least = (hashes & ~_MASK) | (_MASK - at.astype(np.uint64))
    span, done = length - prefix + 1, 1
    while done * 2 <= span:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    if span > done:
        least = np.minimum(least[:len(least) - (span - done)], least[span - done:])
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    count = np.diff(np.r_[first, len(least)])
    position = (_MASK - (least[first] & _MASK)).astype(np.int64)
    return hashes[position], _digest(sums, 0, first, first + count - 1 + length), first, position - first, count


def _pieces(raw: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    for start in range(0, max(len(raw) - length + 1, 1), PIECE):
        yield start, raw[start:start + PIECE + length - 1]


ENTRY = ["key", "digest", "shape"]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, prefix: int = PREFIX,
                   batches: int = BATCHES, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Per row: (id_col, n_bytes, n_removed, n_spans, kept_sha256).

    A byte goes if a string of `length` bytes that covers it starts anywhere else, in its
    own text or another; texts are UTF-8 and null is empty. Strings are judged on the
    texts as given. Repeated rows are copies of each other, null ids are rows like any
    other, texts below the length keep all their bytes.

    The corpus is added in batches to a family of tables of prefix digests, which finds the
    prefixes that stand more than once. Entries with such a prefix are compared as wholes; where
    one prefix has several contexts, their strings are compared one by one. Whole texts move compressed.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("check"), "text")
    entries = written(_entries(rows, length, prefix))
    family = Family()
    batch = F.pmod(F.xxhash64("id", "check"), F.lit(batches))
    for number in range(batches):
        family.add(entries.filter(batch == number).select("key"))
    shared = written(entries.join(family.repeated(), "key", "left_semi"))
    kinds = written(shared.groupBy(*ENTRY).agg(F.count("*").alias("copies"), F.min(F.struct("id", "check", "first")).alias("sample")))
    contexts = kinds.groupBy("key").agg(F.count("*").alias("contexts")).filter("contexts > 1")
    whole = shared.join(kinds.filter("copies > 1").select(*ENTRY), ENTRY).select("id", "check", "first", "shape", F.lit(0).alias("contexts"), F.lit(False).alias("single"), "key")
    open_ = kinds.join(contexts, "key").select("sample.*", "shape", F.least("contexts", F.lit(2**31 - 1)).cast("int").alias("contexts"), (F.col("copies") == 1).alias("single"), "key")
    known = whole.union(open_).groupBy("id", "check").agg(F.collect_list(F.struct("first", "shape", "contexts", "single", "key")).alias("runs"))
    known = known.select(F.col("id").alias("of"), F.col("check").alias("of_check"), "runs")
    same = F.col("id").eqNullSafe(F.col("of")) & (F.col("check") == F.col("of_check"))
    packed = rows.mapInArrow(_packed, T.StructType([rows.schema["id"], T.StructField("check", T.LongType()), T.StructField("packed", T.BinaryType())]))
    judged = written(packed.join(known, same, "left").select("id", "check", "packed", "runs").mapInArrow(partial(_judged, length=length), _judged_type(rows)))
    more = _resolved(judged.filter("kind = 'context'"), length, group_limit)
    more = more.groupBy("id", "check").agg(F.collect_list(F.struct("first", "last")).alias("strings")).select(
        F.col("id").alias("of"), F.col("check").alias("of_check"), "strings")
    result = T.StructType([T.StructField("id", rows.schema["id"].dataType), *RESULT])
    late = judged.filter("kind = 'open'").select("id", "check", "raw", "covered").join(more, same, "left")
    late = late.select("id", "raw", "covered", "strings").mapInArrow(partial(_finished, length=length), result)
    names = result.names
    return judged.filter("kind = 'done'").select(names).union(late.select(names)).withColumnRenamed("id", id_col)


RESULT = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
          T.StructField("kept_sha256", T.StringType())]


class Family:
    """Counts of prefix digests in levels of doubling size, as tables.

    Levels of equal rank are merged when the next batch comes; after the last one no join needs it.
    """

    def __init__(self):
        self.levels: list[tuple[int, DataFrame]] = []
        self.found: list[DataFrame] = []

    def add(self, keys: DataFrame) -> None:
        """Merge levels of equal rank, count a batch by digest and join it with every level."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (rank, level), (_, other) = self.levels.pop(), self.levels.pop()
            self.levels.append((rank + 1, written(level.union(other).groupBy("key").agg(F.sum("n").alias("n")).sortWithinPartitions("key"))))
        level = written(keys.groupBy("key").agg(F.count("*").alias("n")).sortWithinPartitions("key"))
        self.found.append(level.filter("n > 1").select("key"))
        self.found += [level.join(other.select("key"), "key").select("key") for _, other in self.levels]
        self.levels.append((0, level))

    def repeated(self) -> DataFrame:
        """Keys that stood more than once, in a batch or across batches."""
        out = self.found[0]
        for more in self.found[1:]:
            out = out.union(more)
        return written(out.distinct())


def _entries(rows: DataFrame, length: int, prefix: int) -> DataFrame:
    schema = T.StructType([rows.schema["id"], T.StructField("check", T.LongType()), T.StructField("key", T.LongType()),
                           T.StructField("digest", T.LongType()), T.StructField("first", T.LongType()), T.StructField("shape", T.IntegerType())])
    return rows.mapInArrow(partial(_entered, length=length, prefix=prefix, names=schema.names), schema)


def _entered(batches: Iterator[pa.RecordBatch], length: int, prefix: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """shape holds place * 65536 + count."""
    for batch in batches:
        held, size = [], 0
        for row, text in enumerate(raw_texts(batch.column(2))):
            for start, piece in _pieces(np.frombuffer(text, np.uint8), length):
                key, digest, first, place, count = sampled_suffixes(piece, length, prefix)
                if len(key):
                    held.append((np.full(len(key), row), key, digest, first + start, place << 16 | count))
                    size += len(key)
            if size > 50_000:
                yield _entry_batch(batch, held, names)
                held, size = [], 0
        if held:
            yield _entry_batch(batch, held, names)


def _entry_batch(batch: pa.RecordBatch, held: list, names: list[str]) -> pa.RecordBatch:
    row, key, digest, first, shape = (np.concatenate(x) for x in zip(*held))
    row = pa.array(row)
    return pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(key.view(np.int64)), pa.array(digest.view(np.int64)),
                                       pa.array(first), pa.array(shape.astype(np.int32))], names=names)


def _judged_type(rows: DataFrame) -> T.StructType:
    """Finished rows, compressed texts that wait for their open contexts, and the contexts, in one table."""
    return T.StructType([
        T.StructField("kind", T.StringType()), rows.schema["id"], T.StructField("check", T.LongType()), *RESULT,
        T.StructField("raw", T.BinaryType()), T.StructField("covered", T.ArrayType(T.LongType())), T.StructField("key", T.LongType()),
        T.StructField("first", T.LongType()), T.StructField("shape", T.IntegerType()), T.StructField("contexts", T.IntegerType()), T.StructField("single", T.BooleanType())])


def cut(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, int, str]:
    """Bytes, removed bytes, maximal removed runs, and the digest of what is left."""
    step = np.zeros(len(raw) + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    gone = np.cumsum(step[:-1]) > 0
    left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
    return len(raw), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(raw) else 0, sha256(left).hexdigest()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, as they are shuffled whole."""
    for batch in batches:
        packed = [compress(text, 1) for text in raw_texts(batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["id", "check", "packed"])


def _judged(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            yield _judged_part(part, length)


def _judged_part(part: pa.RecordBatch, length: int) -> pa.RecordBatch:
    kind, row, result, raw, covered, context = [], [], [], [], [], []
    packed, runs = part.column(2).to_pylist(), part.column(3)
    sizes = np.diff(runs.offsets.to_numpy())
    flat = {f.name: runs.flatten().field(f.name) for f in runs.type.value_type}
    first, shape, contexts, single, key = (flat[c].to_numpy(zero_copy_only=False) for c in ("first", "shape", "contexts", "single", "key"))
    valid = runs.is_valid().to_numpy(zero_copy_only=False)
    cuts = np.r_[0, np.cumsum(np.where(valid, sizes, 0))]
    for i, text in enumerate(map(decompress, packed)):
        own = slice(cuts[i], cuts[i + 1])
        whole = contexts[own] == 0
        start = first[own][whole]
        end = start + (shape[own][whole] & 0xFFFF) - 1 + length
        waits = bool(single[own].any())
        kind.append("open" if waits else "done")
        row.append(i)
        result.append((None,) * 4 if waits else cut(text, start, end))
        raw.append(packed[i] if waits else None)
        covered.append(np.stack([start, end], axis=1).reshape(-1).tolist() if waits else None)
        context.append((None,) * 5)
        for j in np.flatnonzero(~whole) + cuts[i]:
            kind.append("context")
            row.append(i)
            result.append((None,) * 4)
            raw.append(text[first[j]:first[j] + (int(shape[j]) & 0xFFFF) - 1 + length])
            covered.append(None)
            context.append((int(key[j]), int(first[j]), int(shape[j]), int(contexts[j]), bool(single[j])))
    row = pa.array(row, pa.int64())
    results, described = list(zip(*result)), list(zip(*context))
    return pa.RecordBatch.from_arrays([
        pa.array(kind, pa.string()), part.column(0).take(row), part.column(1).take(row), *(pa.array(results[i], pa.int64()) for i in range(3)),
        pa.array(results[3], pa.string()), pa.array(raw, pa.binary()), pa.array(covered, pa.list_(pa.int64())), pa.array(described[0], pa.int64()),
        pa.array(described[1], pa.int64()), pa.array(described[2], pa.int32()), pa.array(described[3], pa.int32()), pa.array(described[4], pa.bool_())],
        names=["kind", "id", "check", "n_bytes", "n_removed", "n_spans", "kept_sha256", "raw", "covered", "key", "first", "shape", "contexts", "single"])


def _resolved(contexts: DataFrame, length: int, group_limit: int) -> DataFrame:
    """(id, check, first, last): runs of strings of single entries that another context holds too.

    Contexts of one prefix meet in a task, which sorts the digests of their strings. A
    prefix with more contexts than the limit has its strings counted as rows instead.
    """
    rows = contexts.select("id", "check", "key", "first", "shape", "contexts", "single", "raw")
    few = rows.filter(F.col("contexts") <= group_limit).repartition("key").sortWithinPartitions("key")
    span = T.StructType([rows.schema["id"], T.StructField("check", T.LongType()), T.StructField("first", T.LongType()), T.StructField("last", T.LongType())])
    near = few.mapInArrow(partial(_resolve_near, length=length), span)
    string = T.StructType([rows.schema["id"], *[T.StructField(c, T.LongType()) for c in ("check", "first", "one", "two")], T.StructField("single", T.BooleanType())])
    strings = rows.filter(F.col("contexts") > group_limit).mapInArrow(partial(_strings, length=length), string)
    twice = strings.groupBy("one", "two").agg(F.count("*").alias("n")).filter("n > 1").select("one", "two")
    far = strings.filter("single").join(twice, ["one", "two"], "left_semi").select("id", "check", "first", F.col("first").alias("last"))
    return near.union(far)


def _string_digests(raws: list[bytes], shapes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two digests of every string of every context, with the number of its context and its offset."""
    whole = np.frombuffer(b"".join(raws), np.uint8)
    counts = shapes & 0xFFFF
    base = np.cumsum([0, *map(len, raws)])[:-1]
    of = np.repeat(np.arange(len(raws)), counts)
    offset = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = base[of] + offset
    one, two = (_digest(_sums(whole, which), which, start, start + length) for which in (0, 1))
    return one, two, of, offset


def _portions(rows: pa.Table) -> Iterator[pa.Table]:
    """Rows in portions whose joined contexts fit the tables of powers."""
    first, size = 0, 0
    for i, n in enumerate(rows.column("raw").combine_chunks().cast(pa.binary()).to_pylist()):
        if size + len(n) > PIECE:
            yield rows.slice(first, i - first)
            first, size = i, 0
        size += len(n)
    yield rows.slice(first)


def _digests_of(rows: pa.Table, length: int) -> tuple[np.ndarray, ...]:
    parts, before = [], 0
    for portion in _portions(rows):
        one, two, of, offset = _string_digests(portion.column("raw").to_pylist(), portion.column("shape").to_numpy().astype(np.int64), length)
        parts.append((one, two, of + before, offset))
        before += portion.num_rows
    return tuple(np.concatenate(x) for x in zip(*parts))


def _resolve_near(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if held.num_rows >= BUFFER:
            key = held.column("key").to_numpy()
            last = int(np.searchsorted(key, key[-1]))
            if last:
                yield from _matched(held.slice(0, last), length)
                held = held.slice(last)
    if held is not None:
        yield from _matched(held, length)


def _matched(rows: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    one, two, of, offset = _digests_of(rows, length)
    order = np.lexsort((two, one))
    alike = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
    repeated = np.zeros(len(one), bool)
    repeated[order[1:]] |= alike
    repeated[order[:-1]] |= alike
    repeated &= rows.column("single").to_numpy(zero_copy_only=False)[of]
    at = np.flatnonzero(repeated)
    if not len(at):
        return
    broken = np.r_[True, (np.diff(at) > 1) | (np.diff(of[at]) != 0)]
    first, last = at[broken], at[np.r_[np.flatnonzero(broken)[1:] - 1, len(at) - 1]]
    begin, row = rows.column("first").to_numpy(), pa.array(of[first])
    yield pa.RecordBatch.from_arrays([rows.column("id").combine_chunks().take(row), rows.column("check").combine_chunks().take(row),
                                      pa.array(begin[of[first]] + offset[first]), pa.array(begin[of[last]] + offset[last])], names=["id", "check", "first", "last"])


def _strings(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            rows = pa.Table.from_batches([batch.slice(at, 1024)])
            one, two, of, offset = _digests_of(rows, length)
            row = pa.array(of)
            yield pa.RecordBatch.from_arrays([rows.column("id").combine_chunks().take(row), rows.column("check").combine_chunks().take(row),
                                              pa.array(rows.column("first").to_numpy()[of] + offset), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                                              rows.column("single").combine_chunks().take(row)], names=["id", "check", "first", "one", "two", "single"])


def _finished(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for raw, covered, strings in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
            pairs = np.array(covered, np.int64).reshape(-1, 2)
            more = np.array([(s["first"], s["last"] + length) for s in strings or ()], np.int64).reshape(-1, 2)
            pairs = np.concatenate([pairs, more])
            out.append(cut(decompress(raw), pairs[:, 0], pairs[:, 1]))
        columns = list(zip(*out))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())],
                                         names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


SQL = """
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, 400)) AS d FROM bytes, unnest(range(length(h) // 2 - 199)) AS u(s)),
twice AS (SELECT d FROM strings GROUP BY d HAVING count(*) > 1),
hit AS (SELECT doc_id, s, coalesce(s - lag(s) OVER w > 200, true) AS fresh FROM strings SEMI JOIN twice USING (d) WINDOW w AS (PARTITION BY doc_id ORDER BY s)),
numbered AS (SELECT doc_id, s, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM hit),
spans AS (SELECT doc_id, span, min(s) AS a, max(s) + 200 AS b FROM numbered GROUP BY doc_id, span),
ordered AS (SELECT doc_id, a, b, coalesce(lag(b) OVER w, 0) AS before, row_number() OVER w = count(*) OVER (PARTITION BY doc_id) AS last
            FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY a)),
kept AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans,
                string_agg(substr(h, 2 * before + 1, 2 * (a - before)) || CASE WHEN last THEN substr(h, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS h
         FROM ordered JOIN bytes USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(bytes.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.h, bytes.h))) AS kept_sha256
FROM bytes LEFT JOIN kept USING (doc_id)
"""
