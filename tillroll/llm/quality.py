"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm.common import raw_texts, table, text_of

#: Bounds of the training sample: labelled rows taken, and lines of each, evenly over its text.
TRAIN_ROWS = 4000
TRAIN_LINES = 200
FOLDS, HELD_OUT = 3, 1
#: Bytes looked at together; a longer line is cut into pieces of this size whose counts are added.
PIECE = 1 << 20
EPOCHS, RATE, DECAY = 150, 0.05, 1e-4

UPPER, LOWER, DIGIT, SPACE, BANG, BAR, SIGN, STOP, OTHER, HIGH, TAIL = range(11)


def _classes() -> np.ndarray:
    kind = np.full(256, OTHER, np.uint8)
    for group, chars in ((UPPER, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (LOWER, b"abcdefghijklmnopqrstuvwxyz"), (DIGIT, b"0123456789"),
                         (SPACE, b" \t\r\n\v\f"), (BANG, b"!"), (BAR, b"|"), (SIGN, b"#$%&*@^~=<>+_\\/"), (STOP, b".,;:?'\"()-")):
        kind[list(chars)] = group
    kind[0x80:0xC0] = TAIL
    kind[0xC0:] = HIGH
    return kind


KIND = _classes()
#: Random odd numbers stand for bytes in a word's hash.
MIX = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
N_COUNTS = TAIL + 5
N_LOCAL = 14


def line_counts(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Per line of a text: class counts and word counts, and the length in bytes without the line feed."""
    data = np.frombuffer(raw, np.uint8)
    ends = np.r_[np.flatnonzero(data == 10), len(data)]
    starts = np.r_[0, ends[:-1] + 1]
    counts = np.zeros((len(ends), N_COUNTS))
    for first in range(0, len(data), PIECE):
        piece = data[first:first + PIECE]
        line = np.searchsorted(ends, np.arange(first, first + len(piece)), side="left") if len(ends) > 1 else np.zeros(len(piece), np.int64)
        kind = KIND[piece]
        counts[:, :TAIL + 1] += np.bincount(line * (TAIL + 1) + kind, minlength=len(ends) * (TAIL + 1)).reshape(len(ends), TAIL + 1)
        gap = kind == SPACE
        begin = np.flatnonzero(~gap & np.r_[True, gap[:-1]])
        if not len(begin):
            continue
        stop = np.flatnonzero(~gap & np.r_[gap[1:], True]) + 1
        place = np.arange(len(piece), dtype=np.uint64)
        place -= np.repeat(begin.astype(np.uint64), np.diff(np.r_[begin, len(piece)])) if begin[0] == 0 else \
            np.r_[np.zeros(begin[0], np.uint64), np.repeat(begin.astype(np.uint64), np.diff(np.r_[begin, len(piece)]))]
        value = np.where(gap, np.uint64(0), MIX[piece] * (place * np.uint64(2) + np.uint64(1)))
        word = np.add.reduceat(value, begin)
        of, last = line[begin], kind[stop - 1]
        again = np.zeros(len(word), bool)
        again[1:] = (word[1:] == word[:-1]) & (of[1:] == of[:-1])
        for at, mask in enumerate((np.ones(len(word), bool), again, (last == SIGN) | (last == BANG), stop - begin == 1)):
            counts[:, TAIL + 1 + at] += np.bincount(of[mask], minlength=len(ends))
    return counts, (ends - starts).astype(np.float64)


def line_features(counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Ratios of a line, and the same of the lines before and after it."""
    size, letters = np.maximum(lengths, 1), np.maximum(counts[:, UPPER] + counts[:, LOWER], 1)
    words = counts[:, TAIL + 1]
    per_word = np.maximum(words, 1)
    local = np.column_stack([
        counts[:, UPPER] / letters, counts[:, DIGIT] / size * 4, counts[:, BANG] / per_word, counts[:, BAR] / per_word, counts[:, SIGN] / per_word,
        counts[:, STOP] / per_word, counts[:, OTHER] / per_word, counts[:, HIGH] / size * 4, counts[:, TAIL + 2] / per_word,
        counts[:, TAIL + 3] / per_word, counts[:, TAIL + 4] / per_word, np.minimum(lengths / per_word / 10, 4), np.log1p(lengths) / 8, words == 0,
    ])
    edge = np.zeros((1, N_LOCAL))
    near = np.minimum(np.vstack([edge, local[:-1]]), 4), np.minimum(np.vstack([local[1:], edge]), 4)
    ends = np.zeros((len(local), 2))
    ends[0, 0] = ends[-1, 1] = 1
    return np.column_stack([np.minimum(local, 4), *near, ends, np.ones(len(local))])


N_FEATURES = 3 * N_LOCAL + 3


def marginals(unary: np.ndarray, turn: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over padded chains: P(label per line), P(label pairs) summed per chain, and log normaliser.

    unary: chains x lines x 2; turn: 2 x 2; lengths: lines of each chain.
    """
    n, steps, _ = unary.shape
    inside = np.arange(steps) < lengths[:, None]
    forward, backward = np.empty_like(unary), np.zeros_like(unary)
    forward[:, 0] = unary[:, 0]
    for t in range(1, steps):
        came = np.logaddexp(forward[:, t - 1, 0, None] + turn[0], forward[:, t - 1, 1, None] + turn[1]) + unary[:, t]
        forward[:, t] = np.where(inside[:, t, None], came, forward[:, t - 1])
    for t in range(steps - 2, -1, -1):
        ahead = backward[:, t + 1] + unary[:, t + 1]
        came = np.logaddexp(ahead[:, 0, None] + turn[:, 0], ahead[:, 1, None] + turn[:, 1])
        backward[:, t] = np.where(inside[:, t + 1, None], came, 0)
    total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
    single = np.exp(forward + backward - total[:, None, None]) * inside[:, :, None]
    pairs = np.zeros((n, 2, 2))
    if steps > 1:
        joint = forward[:, :-1, :, None] + turn + (unary + backward)[:, 1:, None, :] - total[:, None, None, None]
        pairs = (np.exp(joint) * inside[:, 1:, None, None]).sum(axis=1)
    return single, pairs, total


class LineModel:
    """Weights of the field and of the curve from the mean of line marginals to a score."""

    def __init__(self, prior: float = 0.5):
        self.weights, self.turn = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
        self.slope, self.offset, self.prior, self.trained = 1.0, 0.0, prior, False

    def good_lines(self, chains: list[np.ndarray]) -> list[np.ndarray]:
        """P(good) of every line of every chain; chains of like length run together."""
        out: list[np.ndarray] = [np.empty(0)] * len(chains)
        order = sorted(range(len(chains)), key=lambda i: len(chains[i]))
        while order:
            steps = len(chains[order[-1]])
            many = max(1, min(len(order), 400_000 // max(steps, 1)))
            some, order = order[-many:], order[:-many]
            padded, lengths = _padded([chains[i] for i in some])
            single, _, _ = marginals(padded @ self.weights, self.turn, lengths)
            for row, i in enumerate(some):
                out[i] = single[row, :lengths[row], 1]
        return out

    def mean_good(self, raws: list[bytes]) -> np.ndarray:
        """Mean P(good) of each text's lines, weighted by their length; nan for a text without any."""
        counted = [line_counts(raw) for raw in raws]
        good = self.good_lines([line_features(*c) for c in counted])
        return np.array([(g * n).sum() / n.sum() if n.sum() else np.nan for g, (_, n) in zip(good, counted)])

    def score(self, raws: list[bytes]) -> np.ndarray:
        if not self.trained:
            return np.full(len(raws), self.prior)
        mean = self.mean_good(raws)
        return np.where(np.isnan(mean), self.prior, 1 / (1 + np.exp(-(self.slope * np.nan_to_num(mean) + self.offset))))


def _padded(chains: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(c) for c in chains])
    padded = np.zeros((len(chains), lengths.max(), chains[0].shape[1]))
    for row, chain in enumerate(chains):
        padded[row, :len(chain)] = chain
    return padded, lengths


def fit(chains: list[np.ndarray], sizes: list[np.ndarray], labels: np.ndarray) -> LineModel:
    """Maximum likelihood with every line labelled as its document, then the curve of scores.

    Without both labels there is nothing to learn: every score is then the share of label
    1, or one half without any label.
    """
    model = LineModel(float(labels.mean()) if len(labels) else 0.5)
    if len(set(labels.tolist())) < 2:
        return model
    model.trained = True
    balance = np.where(labels == 1, 0.5 / (labels == 1).mean(), 0.5 / (labels == 0).mean())
    order = np.argsort([len(c) for c in chains], kind="stable")
    groups = [(*_padded([chains[i] for i in part]), labels[part], balance[part]) for part in np.array_split(order, max(1, len(order) // 250)) if len(part)]
    n_lines = sum(lengths.sum() for _, lengths, _, _ in groups)
    moved = [np.zeros_like(model.weights), np.zeros_like(model.turn)]
    spread = [np.zeros_like(model.weights), np.zeros_like(model.turn)]
    for epoch in range(1, EPOCHS + 1):
        slope = [-DECAY * model.weights, -DECAY * model.turn]
        for padded, lengths, wanted, weight in groups:
            single, pairs, _ = marginals(padded @ model.weights, model.turn, lengths)
            inside = np.arange(padded.shape[1]) < lengths[:, None]
            target = np.zeros_like(single)
            target[np.arange(len(wanted)), :, wanted] = inside
            slope[0] += np.einsum("nsf,nsl->fl", padded, (target - single) * weight[:, None, None]) / n_lines
            wanted_pairs = np.zeros_like(pairs)
            wanted_pairs[np.arange(len(wanted)), wanted, wanted] = lengths - 1
            slope[1] += ((wanted_pairs - pairs) * weight[:, None, None]).sum(axis=0) / n_lines
        for value, g, m, v in zip((model.weights, model.turn), slope, moved, spread):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            value += RATE * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8)
    good = model.good_lines(chains)
    mean = np.array([(g * n).sum() / n.sum() if n.sum() else np.nan for g, n in zip(good, sizes)])
    used = ~np.isnan(mean)
    model.slope, model.offset = _curve(mean[used], labels[used])
    return model


def _curve(mean: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """The logistic curve through the cut with the fewest errors on the sample, midway between its neighbours."""
    order = np.argsort(mean, kind="stable")
    value, good = mean[order], labels[order] == 1
    errors = np.r_[0, np.cumsum(good)] + np.r_[np.cumsum(~good[::-1])[::-1], 0]
    bounds = np.r_[0.0, value, 1.0]
    best = np.flatnonzero(errors == errors.min())
    at = best[np.argmax(bounds[best + 1] - bounds[best])]
    cut = (bounds[at] + bounds[at + 1]) / 2
    return 12.0, -12.0 * cut


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = TRAIN_ROWS) -> LineModel:
    """Fit on a bounded sample of labelled rows outside the held-out fold.

    At most max_rows labelled ids are taken, in the order of a hash of the id; they are
    found in docs by a join whose small side has that bound. Of an id with several texts
    each distinct text counts once, and at most 2 * max_rows texts, in the order of a hash,
    are learned from, so rows repeated under one id cost the driver nothing. Features of
    TRAIN_LINES lines of each, taken evenly from first to last, reach the driver. A null
    label or id, or an id with both labels, is left out. Other columns are not read.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col("quality").cast("int").alias("quality")).dropna()
    known = known.filter(fold("id") != HELD_OUT).groupBy("id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
    known = known.filter("quality = most and quality in (0, 1)").orderBy(F.xxhash64("id"), "id").limit(max_rows).select("id", "quality")
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    marked = texts.withColumn("mark", F.xxhash64("text"))
    chosen = marked.join(F.broadcast(known), "id").select("id", "mark", "quality").distinct().orderBy("mark", "id").limit(2 * max_rows)
    rows = marked.join(F.broadcast(chosen), ["id", "mark"]).groupBy("id", "mark").agg(
        F.min("text").alias("text"), F.min("quality").alias("quality")).select("text", "quality")
    schema = T.StructType([T.StructField("quality", T.IntegerType()), T.StructField("features", T.BinaryType()), T.StructField("sizes", T.BinaryType())])
    sample = rows.mapInArrow(_sample_rows, schema).collect()
    sample = sorted(sample, key=lambda r: (r.quality, bytes(r.features)))
    chains = [np.frombuffer(r.features, np.float64).reshape(-1, N_FEATURES) for r in sample]
    return fit(chains, [np.frombuffer(r.sizes, np.float64) for r in sample], np.array([r.quality for r in sample], np.int64))


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [line_counts(raw) for raw in raw_texts(batch.column(0))]
        even = [np.linspace(0, len(n) - 1, min(len(n), TRAIN_LINES)).round().astype(np.int64) for _, n in rows]
        # features of a line's neighbours are those in the text
        features = [line_features(*row)[at].tobytes() for row, at in zip(rows, even)]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(features, pa.binary()), pa.array([n[at].tobytes() for (_, n), at in zip(rows, even)], pa.binary())],
                                         names=["quality", "features", "sizes"])


def fold(name: str):
    return F.crc32(F.col(name).cast("string")) % FOLDS


def score_documents(docs: DataFrame, model: LineModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, score, predicted) of every row; nothing is shuffled.

    Every line of the whole text is labelled; P(good) of the lines is averaged by length.
    A null, empty or blank-line-only text scores the sample's share of label 1. Rows are
    scored as given, repeated ones too; a null id is in no held-out fold.
    """
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInArrow(partial(_score_rows, model=model), schema)
    return rows.select(F.col("id").alias(id_col), F.coalesce(fold("id") == HELD_OUT, F.lit(False)).alias("held_out"), "score",
                       (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _score_rows(batches: Iterator[pa.RecordBatch], model: LineModel) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(raw_texts(part.column(1))), pa.float64())], names=["id", "score"])


def keep_good(spark, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline stage: the documents the classifier does not reject, with their columns.

    Documents are scored row by row, so a null or repeated id changes nothing.
    """
    model = train(docs, table(spark, folder, "labels"))
    at = docs.columns.index("text")
    return docs.mapInArrow(partial(_good_rows, model=model, at=at), docs.schema)


def _good_rows(batches: Iterator[pa.RecordBatch], model: LineModel, at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, 256):
            part = batch.slice(first, 256)
            score = model.score([raw or b"" for raw in raw_texts(part.column(at))])
            yield part.filter(pa.array(score >= 0.5))
