"""Best-fit packing of documents into token sequences, under conflicts."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm import tokens
from tillroll.llm.common import text_of, written

#: Ids of a bin, and documents of one source that may share it.
CAPACITY = 4096
PER_SOURCE = 2
#: Documents packed together; a shard is the unit of one task, whatever the size of the corpus.
SHARD_ROWS = 2048


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None,
         capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_rows: int = SHARD_ROWS, vocabulary: str | None = None) -> DataFrame:
    """Where every document goes: (id_col, piece, bin_id, bin_offset, n_tokens).

    A document has the ids of its text and an end id. One longer than the capacity is cut
    into pieces; whole pieces have a bin of their own, the rest is packed like a short
    document. Pieces are placed longest first into the tightest open bin that holds fewer
    than per_source documents of the source and none of the duplicate cluster; a new bin
    is opened if none fits. Without cluster_col, equal texts are one cluster.

    Documents are dealt to shards of about shard_rows by a hash of what is packed: id,
    source, cluster and length. Rows equal in all of these are counted first and their
    number is spread evenly over the shards, so no repeated row, source, cluster or size
    gathers in one task; bins do not cross shards. Only these four are shuffled, whatever
    the length of the text; other columns of docs are not read. A null text is an empty
    document, a null source or cluster conflicts with nothing, null and repeated ids are
    rows of their own. An empty table gives no rows.
    """
    if source_col not in docs.columns:
        docs = docs.withColumn(source_col, F.lit(None).cast("string"))
    text = text_of(text_col)
    cluster = F.xxhash64(text) if cluster_col is None else F.xxhash64(F.col(cluster_col).cast("string"))
    known = F.lit(True) if cluster_col is None else F.col(cluster_col).isNotNull()
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("source", T.LongType()),
                           T.StructField("cluster", T.LongType()), T.StructField("size", T.LongType())])
    rows = docs.select(F.col(id_col).alias("id"), F.when(F.col(source_col).isNotNull(), F.xxhash64(F.col(source_col).cast("string"))).alias("source"),
                       F.when(known, cluster).alias("cluster"), text.alias("text"))
    sized = written(rows.mapInArrow(partial(_sized, vocabulary=vocabulary), schema))
    shards = max(1, -(-sized.count() // shard_rows))
    # n equal rows: n div shards in every shard, one more in the first n mod shards after their hash
    what = ["id", "source", "cluster", "size"]
    equal = sized.groupBy(*what).agg(F.count("*").alias("n")).withColumn(
        "i", F.explode(F.sequence(F.lit(0), F.least("n", F.lit(shards)).cast("int") - 1)))
    dealt = equal.select(*what, (F.floor(F.col("n") / shards) + (F.col("i") < F.col("n") % shards).cast("long")).alias("copies"),
                         F.pmod(F.xxhash64(*what, F.lit(1)) % shards + F.col("i"), F.lit(shards)).alias("shard"))
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", F.desc(F.pmod(F.col("size"), F.lit(capacity))), "id", "source", "cluster", "size")
    placed = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *[
        T.StructField(c, T.LongType()) for c in ("piece", "bin_id", "bin_offset", "n_tokens")]])
    return dealt.mapInArrow(partial(_placed, names=placed.names, capacity=capacity, per_source=per_source), placed)


def _sized(batches: Iterator[pa.RecordBatch], vocabulary: str | None) -> Iterator[pa.RecordBatch]:
    code = tokens.encoder(vocabulary)
    for batch in batches:
        for first in range(0, batch.num_rows, tokens.TOGETHER):
            part = batch.slice(first, tokens.TOGETHER)
            sizes = code.count(part.column(3).to_pylist()) + 1
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(sizes, pa.int64())],
                                             names=["id", "source", "cluster", "size"])


class Bins:
    """Open bins of one shard in the order of their residuals.

    A bin's sources and clusters are bitmaps over the shard's own numbering; one plane of
    the source bitmap per document allowed. Bins of one residual form a class, which knows
    how many of its bins refuse a source or a cluster, so that the successor search passes
    over a class all of whose bins refuse.
    """

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source, self.count = capacity, per_source, 0
        self.residuals: list[int] = []
        self.classes: dict[int, dict[int, None]] = {}
        self.sources: list[list[int]] = []
        self.clusters: list[int] = []
        self.no_source: dict[int, dict[int, int]] = defaultdict(dict)
        self.no_cluster: dict[int, dict[int, int]] = defaultdict(dict)

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin and offset of a piece; source and cluster are bits, or 0 for none."""
        full, has = self.no_source.get(source, {}), self.no_cluster.get(cluster, {})
        for at in range(bisect_left(self.residuals, size), len(self.residuals)):
            residual = self.residuals[at]
            members = self.classes[residual]
            if max(full.get(residual, 0), has.get(residual, 0)) >= len(members):
                continue
            for one in members:
                if not (source & self.sources[one][-1] or cluster & self.clusters[one]):
                    self._move(one, residual, residual - size, source, cluster)
                    return one, self.capacity - residual
        one = self.count
        self.count += 1
        self.sources.append([0] * self.per_source)
        self.clusters.append(0)
        self._move(one, None, self.capacity - size, source, cluster)
        return one, 0

    def _move(self, one: int, old: int | None, new: int, source: int, cluster: int) -> None:
        if old is not None:
            members = self.classes[old]
            del members[one]
            self._refuse(one, old, -1)
            if not members:
                del self.classes[old]
                del self.residuals[bisect_left(self.residuals, old)]
        planes = self.sources[one]
        for i, plane in enumerate(planes):
            if not plane & source:
                planes[i] |= source
                break
        self.clusters[one] |= cluster
        if new:
            if new not in self.classes:
                self.classes[new] = {}
                insort(self.residuals, new)
            self.classes[new][one] = None
            self._refuse(one, new, 1)

    def _refuse(self, one: int, residual: int, change: int) -> None:
        for bits, table in ((self.sources[one][-1], self.no_source), (self.clusters[one], self.no_cluster)):
            while bits:
                bit = bits & -bits
                bits ^= bit
                left = table[bit].get(residual, 0) + change
                if left:
                    table[bit][residual] = left
                else:
                    del table[bit][residual]


def pack_shard(rows: list[tuple], capacity: int, per_source: int) -> list[tuple[int, int, int, int, int]]:
    """(row, piece, bin, offset, size) of the pieces of rows (source, cluster, size), which are in the order of placing."""
    bits: tuple[dict, dict] = ({}, {})
    bins, out, whole = Bins(capacity, per_source), [], 0
    for row, (source, cluster, size) in enumerate(rows):
        source, cluster = (0 if v is None else 1 << known.setdefault(v, len(known)) for v, known in ((source, bits[0]), (cluster, bits[1])))
        pieces, rest = divmod(size, capacity)
        for piece in range(pieces):
            whole -= 1
            out.append((row, piece, whole, 0, capacity))
        if rest:
            out.append((row, pieces, *bins.place(rest, source, cluster), rest))
    # whole pieces take the numbers after the packed bins
    return [(r, p, b if b >= 0 else bins.count - 1 - b, o, n) for r, p, b, o, n in out]


def _placed(batches: Iterator[pa.RecordBatch], names: list[str], capacity: int, per_source: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    for batch in batches:
        if batch.num_rows:
            held.append(pa.Table.from_batches([batch]))
            rows = pa.concat_tables(held)
            shard = rows.column("shard").to_numpy()
            starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
            for a, b in zip(starts, starts[1:]):
                yield _shard_batch(rows.slice(a, b - a), names, capacity, per_source)
            held = [rows.slice(starts[-1])]
    if held:
        yield _shard_batch(pa.concat_tables(held), names, capacity, per_source)


def _shard_batch(rows: pa.Table, names: list[str], capacity: int, per_source: int) -> pa.RecordBatch:
    shard = rows.column("shard")[0].as_py()
    rows = rows.take(pa.array(np.repeat(np.arange(rows.num_rows), rows.column("copies").to_numpy())))
    placed = np.array(pack_shard(list(zip(*(rows.column(c).to_pylist() for c in ("source", "cluster", "size")))), capacity, per_source), np.int64).reshape(-1, 5)
    ids = rows.column("id").combine_chunks().take(pa.array(placed[:, 0]))
    return pa.RecordBatch.from_arrays([ids, *(pa.array(v) for v in (placed[:, 1], placed[:, 2] + (shard << 32), placed[:, 3], placed[:, 4]))], names=names)


def pack_documents(spark, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline stage: the bin of every document."""
    return pack(docs)
