"""SimHash near-duplicates by a hierarchical index in Gray order."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm.common import WHITE_SPACE, by_record, merge_labels, raw_texts, text_of, written
from tillroll.llm.graph import components

SHINGLE_WORDS = 3
RADIUS = 3
SEED = 42
#: Members of one shared head a task compares; larger heads are cut into chunk pairs.
GROUP_LIMIT = 32_768
#: Children of a node of the index.
FAN = 16
#: Text read at once; the last words of a piece are carried into the next.
PIECE = 1 << 20
#: Node pairs expanded at once.
FRONTIER = 1 << 12
#: Codes under one index, but for whole heads.
TOGETHER = 1 << 14
HEAD = ["field", "head", "low", "high"]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS,
                    radius: int = RADIUS, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Fingerprint and component of every row: (id_col, fingerprint, component_id).

    Texts with one fingerprint form a class; classes within `radius` differing bits link.
    component_id is the smallest id reachable over links. A null or wordless text has
    fingerprint zero and links like any other. A row without an id keeps its fingerprint
    and has no component. Rows repeated under one id appear as often as given. Other
    columns of docs are not read.
    """
    prints = written(fingerprints(docs, id_col, text_col, words))
    classes = written(prints.filter("id is not null").groupBy("fp").agg(F.min("id").alias("rep")))
    member = components(close_classes(classes, radius, group_limit))
    classes = classes.join(member, classes.rep == member.node, "left")
    classes = classes.select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(classes, "fp", "left").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp): the 64 majority bits of the shingle hashes as a signed long; nothing is shuffled."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    work = by_record(lambda ids, texts: [ids, pa.array([fingerprint(t, words) for t in raw_texts(texts)], pa.int64())], ["id", "fp"])
    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInArrow(work, schema)


def fingerprint(raw: bytes, words: int = SHINGLE_WORDS) -> int:
    """Majority fingerprint of a text's word shingles, as a signed 64-bit number."""
    counts, total, carried = np.zeros(64, np.int64), 0, []
    for piece in _pieces(raw):
        tokens = carried + piece.lower().split()
        if len(tokens) >= words:
            n, bits = _shingle_bits(tokens, words)
            total, counts = total + n, counts + bits
            carried = tokens[len(tokens) - words + 1:]
        else:
            carried = tokens
    if not total and carried:
        total, counts = _shingle_bits(carried, len(carried))
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big", signed=True)


def _shingle_bits(tokens: list[bytes], words: int) -> tuple[int, np.ndarray]:
    joined = b" ".join(tokens)
    ends = list(accumulate([len(t) + 1 for t in tokens]))
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b - 1], SEED) for a, b in zip([0, *ends], ends[words - 1:])])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    return len(bits), bits.sum(axis=0, dtype=np.int64)


def _pieces(raw: bytes) -> Iterator[bytes]:
    """The text cut before white space, each piece about PIECE bytes."""
    start = 0
    while len(raw) - start > PIECE:
        end = start + PIECE
        while end < len(raw) and raw[end] not in WHITE_SPACE:
            end += 1
        yield raw[start:end]
        start = end
    yield raw[start:]


def close_classes(classes: DataFrame, radius: int = RADIUS, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Links (a, b) between representatives that span the same components as all pairs within the radius.

    A code is cut into radius + 1 fields; two codes within the radius agree in one of
    them. Each code is entered once per field, rotated so that this field leads: in Gray
    order, codes with one head are neighbours. A task puts one index over all its codes,
    heads of every size, and joins it with itself. The rows of a head above the limit are
    entered by pairs of chunks, dealt by a hash, and compared across the two chunks (and
    within each in its pair with itself), so no task grows with a head. Of the pairs found
    a task reports a spanning forest.
    """
    width = 64 // (radius + 1)
    turned = [F.struct(F.lit(i).alias("field"), _rotated(F.col("fp"), width * i).alias("code")) for i in range(radius + 1)]
    rows = classes.select("rep", F.explode(F.array(*turned)).alias("t")).select("rep", "t.*")
    rows = rows.withColumn("head", F.shiftrightunsigned("code", 64 - width))
    large = (rows.groupBy("field", "head").agg(F.count("*").alias("n")).filter(F.col("n") > group_limit)
             .select("field", "head", F.ceil(F.col("n") / group_limit).alias("chunks")))
    rows = rows.join(large, ["field", "head"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    rows = rows.withColumn("chunk", F.expr("pmod(xxhash64(code, field), chunks)"))
    pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1),
                       lambda other: F.struct(F.least("chunk", other).alias("low"), F.greatest("chunk", other).alias("high")))
    rows = rows.select("field", "head", "rep", "code", F.col("chunk"), F.explode(pair).alias("p"))
    rows = rows.select("field", "head", "p.*", "chunk", "code", "rep")
    rows = rows.repartition(*HEAD).sortWithinPartitions("field", _gray_rank(F.col("head")), "low", "high", "chunk", _gray_rank(F.col("code")), "rep")
    schema = T.StructType([T.StructField(c, classes.schema["rep"].dataType) for c in ("a", "b")])
    return rows.mapInArrow(partial(_search_heads, radius=radius), schema)


def _rotated(code, bits: int):
    return code if not bits else F.shiftleft(code, bits).bitwiseOR(F.shiftrightunsigned(code, 64 - bits))


def _gray_rank(code):
    """Position of a code in Gray order, as a signed long; order among codes with one head is what counts."""
    for step in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, step))
    return code


def _search_heads(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Whole heads, as they arrive in order, many at a time."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in held) >= TOGETHER:
            rows = pa.concat_tables(held)
            last = np.flatnonzero(_changes(rows, HEAD))[-1]
            if last:
                yield from _search_rows(rows.slice(0, last), radius)
            held = [rows.slice(last)]
    if held:
        yield from _search_rows(pa.concat_tables(held), radius)


def _changes(rows: pa.Table, columns: list[str]) -> np.ndarray:
    """Where a row differs from the one before in any of the columns; true for the first."""
    keys = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in columns])
    return np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)]


def _search_rows(rows: pa.Table, radius: int) -> Iterator[pa.RecordBatch]:
    codes = rows.column("code").to_numpy().view(np.uint64)
    cut = rows.column("low").to_numpy() != rows.column("high").to_numpy()
    side = np.where(cut, np.cumsum(_changes(rows, [*HEAD, "chunk"])), -1)
    labels = np.arange(len(codes))
    for x, y in close_pairs(Index(codes, np.cumsum(_changes(rows, HEAD)), side), radius):
        labels = merge_labels(labels, x, y)
    tied = np.flatnonzero(labels != np.arange(len(labels)))
    if len(tied):
        rep = rows.column("rep").combine_chunks()
        yield pa.RecordBatch.from_arrays([rep.take(pa.array(tied)), rep.take(pa.array(labels[tied]))], names=["a", "b"])


class Index:
    """Codes in Gray order under levels of nodes, FAN to a node, up to one root.

    A node holds the bits all codes below it share, as mask and pattern, the first and last
    head below it, and the least and greatest side: the chunk of a head that is cut, else -1.
    Level 0 are the codes, which share all their bits with themselves.
    """

    def __init__(self, codes: np.ndarray, head: np.ndarray, side: np.ndarray):
        level = [codes, codes, head, head, side, side]
        self.levels = [level]
        while len(level[0]) > 1:
            at = np.arange(0, len(level[0]), FAN)
            level = [merge.reduceat(part, at) for merge, part in zip(
                (np.bitwise_and, np.bitwise_or, np.minimum, np.maximum, np.minimum, np.maximum), level)]
            self.levels.append(level)

    def near(self, level: int, x: np.ndarray, y: np.ndarray, radius: int) -> np.ndarray:
        """Which pairs of nodes x <= y may hold codes of one head, on two sides if it is cut, within the radius."""
        every, some, first, last, least, most = self.levels[level]
        shared = ~((every[x] ^ some[x]) | (every[y] ^ some[y]))
        one_side = (least[x] == most[y]) & (most[x] == least[y]) & (least[x] >= 0)
        return (first[y] <= last[x]) & ~one_side & (np.bitwise_count((every[x] ^ every[y]) & shared) <= radius)


def close_pairs(index: Index, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of one head's codes within the radius, as positions x < y: the index joined with itself
    from the root down. Pairs of nodes whose shared bits differ in more than the radius, or that have no
    head in common, are pruned with all below them; one way for heads of every size."""
    if len(index.levels[0][0]) < 2:
        return
    stack, step = [(len(index.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))], np.arange(FAN)
    while stack:
        level, x, y = stack.pop()
        if len(x) > FRONTIER:
            stack += [(level, x[i:i + FRONTIER], y[i:i + FRONTIER]) for i in range(0, len(x), FRONTIER)]
            continue
        keep = index.near(level, x, y, radius)
        x, y = x[keep], y[keep]
        if level == 0:
            if len(x):
                yield x, y
            continue
        x, y = (v.reshape(-1) for v in np.broadcast_arrays((x[:, None] * FAN + step)[:, :, None], (y[:, None] * FAN + step)[:, None, :]))
        n = len(index.levels[level - 1][0])
        inside = (x < n) & (y < n) & (x < y if level == 1 else x <= y)
        stack.append((level - 1, x[inside], y[inside]))


def keep_first(spark, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline stage: of each group of near duplicates the document with the smallest id.

    Rows that share an id are one document and stay or go together; a row without an id
    is in no group and stays.
    """
    groups = near_duplicates(docs.select("doc_id", "text"))
    dropped = groups.filter("component_id <> doc_id").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(dropped, docs.doc_id == dropped.gone, "left_anti")
