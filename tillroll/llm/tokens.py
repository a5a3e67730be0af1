"""Token ids in bit-packed block files."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm.common import text_of
from tillroll.session import stream_folder

VOCABULARY_FILE = "byte_bpe_50k.json"
END_ID = 2
#: A block is closed by the document that takes it to this many ids.
BLOCK_IDS = 1 << 17
#: Distinct pieces of text whose ids a worker remembers; beyond it the worker starts afresh.
REMEMBERED = 1_000_000
#: Texts encoded together.
TOGETHER = 128

#: White space and the run of other characters after it, cut where letters meet punctuation.
#: The vocabulary's own pattern never joins a character with white space behind it, nor a
#: letter with such punctuation, so these pieces are encoded independently.
PIECE = re.compile(r"[ \n]*+[A-Za-zÀ-ÖØ-öø-ÿ]++(?=[.,!?;:|#$%&*()\"-])|[ \n]*+[^ \n]++|[ \n]++")
#: A piece with other white space or a special token is encoded with its whole text.
ODD = re.compile(r"[^\S \n]|<\|endoftext\|>")


class Pieces(dict):
    """Numbers for pieces in the order they are first met."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self.fresh.append(piece)
        return number


class Encoder:
    """Ids of whole texts by the tokenizers library, each distinct piece encoded once per worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        #: Bytes of each id: a byte-level vocabulary writes one character for a byte.
        self.bytes = np.array([len(self.library.id_to_token(i)) for i in range(self.vocabulary)], np.int64)
        self.forget()

    @property
    def vocabulary(self) -> int:
        return self.library.get_vocab_size()

    def forget(self) -> None:
        self.pieces, self.used = Pieces(), 0
        self.starts, self.sizes, self.odd = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.ids = np.zeros(0, np.uint32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        numbers, cuts = self._numbers(texts)
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[numbers] - (ends - sizes), sizes)
        at += np.arange(len(at))
        bounds = np.r_[0, ends][cuts]
        out = np.split(self.ids[at], bounds[1:-1])
        for i in self._odd_texts(numbers, cuts):
            out[i] = self._whole(texts[i])
        return out

    def count(self, texts: list[str]) -> np.ndarray:
        """The number of ids of each text."""
        numbers, cuts = self._numbers(texts)
        out = np.diff(np.r_[0, np.cumsum(self.sizes[numbers])][cuts])
        for i in self._odd_texts(numbers, cuts):
            out[i] = len(self._whole(texts[i]))
        return out

    def _numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all pieces of all texts, and where each text's pieces begin and end."""
        if len(self.pieces) > REMEMBERED:
            self.forget()
        number, found = self.pieces.__getitem__, []
        for text in texts:
            pieces = PIECE.findall(text)
            found.append(np.fromiter(map(number, pieces), np.int64, len(pieces)))
        if self.pieces.fresh:
            self._learn(self.pieces.fresh)
            self.pieces.fresh = []
        return np.concatenate(found) if found else np.zeros(0, np.int64), np.r_[0, np.cumsum([len(f) for f in found])].astype(np.int64)

    def _learn(self, fresh: list[str]) -> None:
        """Encode new pieces. Those between white space and other characters are encoded as one
        text and told apart by the bytes of their ids, which is faster than one by one."""
        odd = np.array([ODD.search(p) is not None for p in fresh])
        joined = ~odd & np.array([p[0] in " \n" and p[-1] not in " \n" for p in fresh])
        at, alone = np.flatnonzero(joined), np.flatnonzero(~joined)
        ids, sizes = self._joined([fresh[i] for i in at])
        rest = [e.ids for e in self.library.encode_batch_fast([fresh[i] for i in alone], add_special_tokens=False)]
        coded = np.r_[ids, np.fromiter(chain.from_iterable(rest), np.uint32)]
        order = np.r_[at, alone]
        every = np.zeros(len(fresh), np.int64)
        every[order] = np.r_[sizes, np.array([len(c) for c in rest], np.int64)]
        starts = np.zeros(len(fresh), np.int64)
        starts[order] = np.cumsum(every[order]) - every[order]
        known, total = len(self.pieces) - len(fresh), self.used + len(coded)
        self.starts, self.sizes, self.odd = (_room(x, known, len(self.pieces)) for x in (self.starts, self.sizes, self.odd))
        self.ids = _room(self.ids, self.used, total)
        self.starts[known:len(self.pieces)] = self.used + starts
        self.sizes[known:len(self.pieces)] = every
        self.odd[known:len(self.pieces)] = odd
        self.ids[self.used:total] = coded
        self.used = total

    def _joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and how many each has."""
        if not pieces:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        ids = np.array(self.library.encode_batch_fast(["".join(pieces)], add_special_tokens=False)[0].ids, np.uint32)
        last = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum([len(p.encode()) for p in pieces]))
        return ids, np.diff(np.r_[-1, last])

    def _odd_texts(self, numbers: np.ndarray, cuts: np.ndarray) -> list[int]:
        odd = np.flatnonzero(self.odd[numbers])
        return sorted(set((np.searchsorted(cuts, odd, side="right") - 1).tolist()))

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


def _room(values: np.ndarray, used: int, needed: int) -> np.ndarray:
    """The same values with room for more; grows by doubling."""
    if needed <= len(values):
        return values
    grown = np.zeros(2 * needed, values.dtype)
    grown[:used] = values[:used]
    return grown


@lru_cache(maxsize=4)
def encoder(path: str | None) -> Encoder:
    """A worker's encoder; without a path it is the installed public vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY_FILE)
    return Encoder(path)


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids as consecutive fields of `width` bits, the lowest bit first."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits.reshape(-1), bitorder="little").tobytes()


def unpack(payload: bytes, width: int, first: int, count: int) -> np.ndarray:
    """Ids first .. first + count of a packed payload; reads only the bytes that hold them."""
    if width in (8, 16, 32):
        return np.frombuffer(payload, f"<u{width // 8}", count, first * width // 8).astype(np.uint32)
    at = first * width
    raw = np.frombuffer(payload, np.uint8)[at // 8:(at + count * width + 7) // 8]
    bits = np.unpackbits(raw, bitorder="little")[at % 8:at % 8 + count * width].reshape(count, width)
    whole = np.zeros((count, 32), np.uint8)
    whole[:, :width] = bits
    return np.packbits(whole, axis=1, bitorder="little").view("<u4").reshape(-1).astype(np.uint32)


def write(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID,
          vocabulary: str | None = None, block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of all texts, an end id after each, in ascending id order.

    The files are Parquet, so they land by Spark's commit in whatever store holds the
    folder. A row is one block: (shard, block, width, start, ids, offsets, payload). A
    shard is one range of ids, numbered in order; start counts the shard's ids before the
    block; document i of the block has the ids offsets[i] .. offsets[i + 1] of the payload,
    which packs every id in the fewest bits that the vocabulary and the end id need. A
    block holds whole documents. A null id comes first, null text is empty, equal ids
    keep all their rows, in the order of their texts.
    """
    schema = T.StructType([
        T.StructField("shard", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("width", T.IntegerType()),
        T.StructField("start", T.LongType()), T.StructField("ids", T.ArrayType(docs.schema[id_col].dataType)),
        T.StructField("offsets", T.ArrayType(T.LongType())), T.StructField("payload", T.BinaryType())])
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).repartitionByRange("id").sortWithinPartitions("id", "text")
    rows.mapInArrow(partial(_blocks, schema=schema.names, end_id=end_id, vocabulary=vocabulary, block_ids=block_ids), schema) \
        .write.option("compression", "zstd").parquet(folder)


def _blocks(batches: Iterator[pa.RecordBatch], schema: list[str], end_id: int, vocabulary: str | None, block_ids: int) -> Iterator[pa.RecordBatch]:
    code = encoder(vocabulary)
    width = max(code.vocabulary - 1, end_id).bit_length()
    shard, number, start = TaskContext.get().partitionId(), 0, 0
    ids, held, size, kind = [], [], 0, None
    for batch in batches:
        kind = batch.column(0).type
        for first in range(0, batch.num_rows, TOGETHER):
            part = batch.slice(first, TOGETHER)
            for one, coded in zip(part.column(0).to_pylist(), code.encode(part.column(1).to_pylist())):
                ids.append(one)
                held.append(np.append(coded, np.uint32(end_id)))
                size += len(held[-1])
                if size >= block_ids:
                    yield _block(schema, kind, shard, number, width, start, ids, held)
                    number, start, ids, held, size = number + 1, start + size, [], [], 0
    if ids:
        yield _block(schema, kind, shard, number, width, start, ids, held)


def _block(names: list[str], kind, shard: int, number: int, width: int, start: int, ids: list, held: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.r_[0, np.cumsum([len(h) for h in held])]
    return pa.RecordBatch.from_arrays([
        pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([width], pa.int32()), pa.array([start], pa.int64()),
        pa.array([ids], pa.list_(kind)), pa.array([offsets.tolist()], pa.list_(pa.int64())),
        pa.array([pack(np.concatenate(held), width)], pa.binary())], names=names)


def read(spark, folder: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32) of every document, from the files alone.

    start counts the ids of all documents before it: those of earlier shards, summed over
    one row per shard, of earlier blocks, and of the block's earlier documents. The sums
    are broadcast: there are no more shards than shuffle partitions.
    """
    blocks = spark.read.parquet(folder)
    sizes = blocks.groupBy("shard").agg(F.sum(F.element_at("offsets", -1)).alias("n"))
    before = sizes.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    rows = blocks.join(F.broadcast(before), "shard").select("ids", "offsets", "width", "payload", (F.col("before") + F.col("start")).alias("start"))
    schema = T.StructType([T.StructField(id_col, blocks.schema["ids"].dataType.elementType), T.StructField("start", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    return rows.mapInArrow(partial(_documents, names=schema.names), schema)


def _documents(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            ids, offsets, width, payload, start = (batch.column(i)[row] for i in range(5))
            at = np.array(offsets.as_py(), np.int64)
            raw = unpack(payload.as_buffer().to_pybytes(), width.as_py(), 0, int(at[-1])).astype("<u4").tobytes()
            crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([ids.values, pa.array(start.as_py() + at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], names=names)


def document(spark, folder: str, doc_id) -> np.ndarray | None:
    """The ids of one document, end id included: one block is read, and of it one document unpacked."""
    found = spark.read.parquet(folder).filter(F.array_contains("ids", doc_id)).limit(1).collect()
    if not found:
        return None
    row, = found
    i = row.ids.index(doc_id)
    return unpack(bytes(row.payload), row.width, row.offsets[i], row.offsets[i + 1] - row.offsets[i])


def round_trip(docs: DataFrame) -> DataFrame:
    """Write the files to a new shared folder and read them back."""
    folder = stream_folder(docs.sparkSession)
    write(docs, folder)
    return read(docs.sparkSession, folder)
