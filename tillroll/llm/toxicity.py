"""Document toxicity from gradient-boosted trees over dense features, calibrated by an isotonic curve."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm.common import raw_texts, text_of, written

#: Bounds of the sample and of the lexicon that are learned from: labelled ids of either label, and lexicon entries.
TRAIN_ROWS = 3000
LEXICON = 20_000
FOLDS, HELD_OUT = 5, 0
#: Parts of the sample; features of a part come from the lexicon of the others, as they will for unseen texts.
PARTS = 4
#: A lexicon entry is in so many toxic texts at least, and so many times likelier there (natural logarithm).
SUPPORT, LEAST_WEIGHT, STRONG_WEIGHT = 3, 1.5, 3.0
#: Code points of a word's start that may be an entry of their own.
STARTS = range(3, 9)
TREES, DEPTH, LEAF, RATE, BINS, SHRINK = 80, 4, 3, 0.15, 64, 1.0
#: Code units of a text looked at together, and tokens a worker remembers.
PIECE = 1 << 20
REMEMBERED = 300_000
#: An insult this many words from an address in the second person is aimed at somebody.
NEAR = 3

#: Insults, and addresses in the second person, in four languages.
INSULTS = frozenset("""
idiot idiots moron morons stupid dumb loser losers scum trash garbage pathetic worthless disgusting clown clowns imbecile fool freak pig
idiote imbécile stupide débile crétin connard ordure déchet minable dégoûtant
dumm dummkopf trottel vollidiot abschaum müll erbärmlich wertlos widerlich versager
estúpido imbécil tonto basura escoria patético inútil asqueroso perdedor payaso
""".split())
SECOND_PERSON = frozenset("""
you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer ti tú usted ustedes vosotros
""".split())

#: Characters that stand for letters in disguised words.
DISGUISE = str.maketrans("013457@$!|", "oieastasii")
EDGES = ".,;:!?\"'()[]{}<>«»„“”‘’…-–—_*~`"
INNER = re.compile(r"[^\W_]+")
STRETCHED = re.compile(r"([^\W\d_])\1\1")

#: Columns of a token: its sums make the features of a text.
(LEX, STRONG, WEIGHT, LISTED, HIDDEN, SECOND, LETTERS, UPPER, SHOUTED, BANGS, MARKS, OTHER, DIGITS, MIXED, STRETCH, SINGLE) = range(16)
N_TOKEN = 16
N_FEATURES = 24


def terms(word: str) -> list[str]:
    """What a lexicon may hold of a word: itself, and its starts with a mark."""
    return [word, *(word[:n] + "*" for n in STARTS if n < len(word))]


def token_words(token: str) -> tuple[list[str], str]:
    """The lower-cased words of a token, and the token with disguises undone, or empty if it has none."""
    core = token.strip(EDGES).lower()
    plain = core.translate(DISGUISE)
    plain = "".join(INNER.findall(plain))
    words = INNER.findall(core)
    return words, "" if words == [plain] or not any(c.isalpha() for c in core) else plain


class Reader:
    """Features of texts under one lexicon; tokens are looked up once and remembered up to a bound."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.heads = {term.rstrip("*")[:STARTS[0]] for term in lexicon}
        self.forget()

    def forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.table = np.empty((4096, N_TOKEN))

    def weight(self, word: str) -> float:
        if word[:STARTS[0]] not in self.heads:
            return 0.0
        return max(self.lexicon.get(term, 0.0) for term in terms(word))

    def code(self, token: str) -> None:
        at = self.codes[token] = len(self.codes)
        if at == len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        self.table[at] = self.token(token)

    def token(self, token: str) -> tuple:
        """The columns of a token."""
        core = token.strip(EDGES)
        low = core.lower()
        bangs = 0 if len(core) == len(token) else token.count("!") + token.count("?")
        other, stretched = not token.isascii() and max(token) > "\u024f", bool(STRETCHED.search(low))
        upper = 0 if core == low else sum(map(str.isupper, core))
        if core.isalpha():
            weight, n = self.weight(low), len(core)
            return (weight >= LEAST_WEIGHT, weight >= STRONG_WEIGHT, weight, low in INSULTS, False, low in SECOND_PERSON,
                    n, upper, n > 2 and upper == n, bangs, len(token) - n, other, 0, False, stretched, n == 1)
        words, plain = token_words(token)
        weight = max(map(self.weight, words), default=0.0)
        listed = not INSULTS.isdisjoint(words)
        disguised = self.weight(plain) if plain else 0.0
        hidden = weight < LEAST_WEIGHT and not listed and (disguised >= LEAST_WEIGHT or plain in INSULTS)
        letters, digits = sum(map(str.isalpha, token)), sum(map(str.isdigit, token))
        return (weight >= LEAST_WEIGHT or hidden, max(weight, disguised) >= STRONG_WEIGHT, max(weight, disguised * hidden), listed or (hidden and plain in INSULTS), hidden,
                not SECOND_PERSON.isdisjoint(words), letters, upper, letters > 2 and upper == letters, bangs, len(token) - letters - digits, other, digits,
                letters > 1 and (digits > 0 or any(c in core for c in "@$*!|")), stretched, False)

    def features(self, text: str) -> np.ndarray:
        """The features of a whole text, read in pieces; words near each other across a piece's end count as well."""
        sums, n_tokens, aimed, seen = np.zeros(N_TOKEN), 0, 0, set()
        most, last, done = 0.0, np.empty((0, N_TOKEN)), 0
        for piece in pieces(text):
            tokens = piece.split()
            if len(self.codes) > REMEMBERED:
                self.forget()
            codes = self.codes
            for token in tokens:
                if token not in codes:
                    self.code(token)
            if not tokens:
                continue
            at = np.array([codes[token] for token in tokens])
            rows = self.table[at]
            sums += rows.sum(axis=0)
            n_tokens += len(tokens)
            most = max(most, rows[:, WEIGHT].max())
            bad = np.flatnonzero(rows[:, LEX] > 0)
            seen.update(tokens[i].lower() for i in bad)
            # a word is judged once the words after it are known
            rows = np.concatenate([last, rows])
            stop = max(done, len(rows) - NEAR)
            aimed += _aimed(rows, done, stop)
            last, done = rows[max(0, stop - NEAR):], min(stop, NEAR)
        aimed += _aimed(last, done, len(last))
        return _features(sums, n_tokens, aimed, len(seen), most)


def _aimed(rows: np.ndarray, first: int, last: int) -> int:
    """Insults from first to last with an address in the second person at most NEAR words before or after."""
    bad = first + np.flatnonzero((rows[first:last, LEX] > 0) | (rows[first:last, LISTED] > 0))
    address = np.flatnonzero(rows[:, SECOND] > 0)
    if not len(bad) or not len(address):
        return 0
    after = np.minimum(np.searchsorted(address, bad), len(address) - 1)
    gap = np.minimum(np.abs(address[after] - bad), np.abs(address[np.maximum(after - 1, 0)] - bad))
    return int((gap <= NEAR).sum())


def _features(s: np.ndarray, n: int, aimed: int, distinct: int, most: float) -> np.ndarray:
    per, letters = max(n, 1), max(s[LETTERS], 1)
    return np.array([
        s[LEX] / per, s[STRONG] / per, s[WEIGHT] / per, s[LISTED] / per, np.log1p(s[LEX]), np.log1p(s[STRONG]), np.log1p(s[LISTED]), np.log1p(distinct), most,
        s[HIDDEN] / per, np.log1p(s[HIDDEN]), s[SECOND] / per, aimed / max(s[LEX] + s[LISTED], 1), np.log1p(aimed),
        s[UPPER] / letters, s[SHOUTED] / per, s[BANGS] / per, s[MARKS] / per, s[OTHER] / per, s[DIGITS] / per, s[MIXED] / per, s[STRETCH] / per, s[SINGLE] / per,
        np.log1p(n),
    ])


def pieces(text: str) -> Iterator[str]:
    """A text in pieces of about PIECE characters, cut after white space; a longer token is cut where the next white space ends it."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text) and (gap := re.compile(r"\s").search(text, end)):
            end = gap.end()
        elif end < len(text):
            end = len(text)
        yield text[at:end]
        at = end


@dataclass
class Trees:
    """Boosted trees for the logistic loss, over features cut into bins; all trees are complete and of one depth."""

    cuts: list[np.ndarray] = field(default_factory=list)
    start: float = 0.0
    features: list[np.ndarray] = field(default_factory=list)
    bounds: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for column in x.T]
        binned = self.binned(x)
        share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.start = float(np.log(share / (1 - share)))
        margin = np.full(len(y), self.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            margin += self._grow(binned, p - y, p * (1 - p))
        return self

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(cut, column, side="left") for cut, column in zip(self.cuts, x.T)])

    def _grow(self, binned: np.ndarray, slope: np.ndarray, bend: np.ndarray) -> np.ndarray:
        """Add a tree level by level: every node takes the split that lowers the loss most."""
        n, width = binned.shape
        node, which, where = np.zeros(n, np.int64), [], []
        for level in range(DEPTH):
            nodes = 1 << level
            gain, feature, bound = np.zeros(nodes), np.zeros(nodes, np.int64), np.full(nodes, BINS)
            for column in range(width):
                cell = node * BINS + binned[:, column]
                g, h, k = (np.bincount(cell, weights, nodes * BINS).reshape(nodes, BINS).cumsum(axis=1) for weights in (slope, bend, None))
                left = g[:, :-1] ** 2 / (h[:, :-1] + SHRINK)
                right = (g[:, -1:] - g[:, :-1]) ** 2 / (h[:, -1:] - h[:, :-1] + SHRINK)
                better = left + right - g[:, -1:] ** 2 / (h[:, -1:] + SHRINK)
                better[(k[:, :-1] < LEAF) | (k[:, -1:] - k[:, :-1] < LEAF)] = 0
                best = better.argmax(axis=1)
                value = better[np.arange(nodes), best]
                wins = value > gain + 1e-9
                gain[wins], feature[wins], bound[wins] = value[wins], column, best[wins]
            which.append(feature)
            where.append(bound)
            node = node * 2 + (binned[np.arange(n), feature[node]] > bound[node])
        g, h = (np.bincount(node, weights, 1 << DEPTH) for weights in (slope, bend))
        leaf = -RATE * g / (h + SHRINK)
        self.features.append(np.concatenate(which))
        self.bounds.append(np.concatenate(where))
        self.leaves.append(leaf)
        return leaf[node]

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned, rows = self.binned(x), np.arange(len(x))
        out = np.full(len(x), self.start)
        for feature, bound, leaf in zip(self.features, self.bounds, self.leaves):
            node, at = np.zeros(len(x), np.int64), 0
            for level in range(DEPTH):
                here = at + node
                node = node * 2 + (binned[rows, feature[here]] > bound[here])
                at += 1 << level
            out += leaf[node]
        return out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising curve nearest to the labels, by pooling neighbours that fall: (margins, shares).

    A pool's share counts one more row of either label, so that no score is certain.
    """
    order = np.argsort(margin, kind="stable")
    pools: list[list[float]] = []
    for value, label in zip(margin[order].tolist(), y[order].tolist()):
        pools.append([label, 1, value, value])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            good, n, _, high = pools.pop()
            pools[-1][0] += good
            pools[-1][1] += n
            pools[-1][3] = high
    at = np.array([edge for _, _, low, high in pools for edge in (low, high)])
    share = np.array([(good + 0.5) / (n + 1) for good, n, _, _ in pools for _ in range(2)])
    # pools of few rows may turn the order of two shares
    return at, np.maximum.accumulate(share)


class ToxicityModel:
    """A lexicon, trees over its features, and the curve from their margin to a score."""

    def __init__(self, prior: float = 0.5):
        self.prior, self.lexicon, self.trees = prior, {}, None
        self.curve = np.empty(0), np.empty(0)

    def score(self, reader: Reader, texts: list[str]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.prior)
        return np.interp(self.trees.margin(np.array([reader.features(text) for text in texts]).reshape(-1, N_FEATURES)), *self.curve)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Fit on a bounded sample of labelled rows outside the held-out fold.

    At most max_rows ids of either label are taken in the order of a hash of the id; one text counts
    for a repeated id. A null label or id, or an id with both labels, is left out. Tasks count in how
    many texts of either label a word or its start occurs; at most LEXICON of these entries and one row of
    features per text reach the driver. A part of the sample is described by the lexicon of the other
    parts, and the curve is fitted on margins of trees that have not seen the part. Without both
    labels every score is the share of label 1, or one half without any label.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    known = known.filter(fold("id") != HELD_OUT).groupBy("id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).filter("toxic = most")
    sides = [known.filter(F.col("toxic") == side).orderBy(F.xxhash64("id"), "id").limit(max_rows).select("id", "toxic") for side in (0, 1)]
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    rows = texts.join(F.broadcast(sides[0].union(sides[1])), "id").groupBy("id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text"))
    # equal texts share a part, so that no text is described by a lexicon that knows it
    sample = written(rows.select(F.pmod(F.xxhash64("text"), F.lit(PARTS)).cast("int").alias("part"), "toxic", "text"))
    sizes = np.zeros((PARTS, 2))
    for row in sample.groupBy("part", "toxic").count().collect():
        sizes[row.part, row.toxic] = row["count"]
    total = sizes.sum(axis=0)
    model = ToxicityModel(float(total[1] / total.sum()) if total.any() else 0.5)
    if not total.all():
        return model
    cells = [F.sum(F.when((F.col("part") == p) & (F.col("toxic") == t), F.col("n"))).alias(f"c{p}{t}") for p in range(PARTS) for t in (0, 1)]
    counts = sample.mapInArrow(_term_rows, "part int, toxic int, term string, n long").groupBy("term").agg(*cells).fillna(0)
    toxic, clean = (sum(F.col(f"c{p}{t}") for p in range(PARTS)) for t in (1, 0))
    weight = F.log((toxic + 0.5) / (total[1] + 1)) - F.log((clean + 0.5) / (total[0] + 1))
    found = counts.filter((toxic >= SUPPORT) & (weight >= LEAST_WEIGHT)).orderBy(F.desc(toxic * weight), "term").limit(LEXICON).collect()
    entries = {row.term: np.array([[row[f"c{p}{t}"] for t in (0, 1)] for p in range(PARTS)]) for row in found}
    model.lexicon = _weights(entries, sizes)
    others = [_weights({term: np.delete(count, p, axis=0) for term, count in entries.items()}, np.delete(sizes, p, axis=0)) for p in range(PARTS)]
    learned = sample.mapInArrow(partial(_feature_rows, lexicons=others), "part int, toxic int, features binary").collect()
    learned = sorted(learned, key=lambda r: (r.part, r.toxic, bytes(r.features)))
    x = np.array([np.frombuffer(r.features) for r in learned])
    y, part = np.array([r.toxic for r in learned], np.float64), np.array([r.part for r in learned])
    margin = np.zeros(len(y))
    for p in range(PARTS):
        seen = part != p
        if seen.any() and not seen.all():
            margin[~seen] = Trees().fit(x[seen], y[seen]).margin(x[~seen])
    model.trees = Trees().fit(x, y)
    model.curve = isotonic(margin if len(set(part.tolist())) > 1 else model.trees.margin(x), y)
    return model


def _weights(entries: dict[str, np.ndarray], sizes: np.ndarray) -> dict[str, float]:
    total = sizes.sum(axis=0)
    out = {}
    for term, count in entries.items():
        clean, toxic = count.sum(axis=0)
        weight = float(np.log((toxic + 0.5) / (total[1] + 1)) - np.log((clean + 0.5) / (total[0] + 1)))
        if toxic >= SUPPORT and weight >= LEAST_WEIGHT:
            out[term] = weight
    return out


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch, in how many texts of a part and label a term occurs."""
    for batch in batches:
        counts: dict[tuple, int] = {}
        for part, toxic, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw_texts(batch.column(2))):
            words: set[str] = set()
            for piece in pieces(raw.decode()):
                for token in set(piece.split()):
                    found, plain = token_words(token)
                    words.update(found)
                    if plain:
                        words.add(plain)
            for term in {term for word in words for term in terms(word)}:
                key = part, toxic, term
                counts[key] = counts.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.int32()), pa.array([k[1] for k in counts], pa.int32()),
                                          pa.array([k[2] for k in counts], pa.string()), pa.array(counts.values(), pa.int64())], names=["part", "toxic", "term", "n"])


def _feature_rows(batches: Iterator[pa.RecordBatch], lexicons: list[dict[str, float]]) -> Iterator[pa.RecordBatch]:
    readers = [Reader(lexicon) for lexicon in lexicons]
    for batch in batches:
        parts = batch.column(0).to_pylist()
        values = [readers[part].features(raw.decode()).tobytes() for part, raw in zip(parts, raw_texts(batch.column(2)))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.binary())], names=["part", "toxic", "features"])


def fold(name: str):
    return F.crc32(F.col(name).cast("string")) % FOLDS


def score_documents(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, score, predicted) of every row; nothing is shuffled and no other column is read.

    The whole text is read, a null one as empty; rows are scored as given, repeated ones too; a null
    id is in no held-out fold. An empty table gives an empty one.
    """
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInArrow(partial(_score_rows, model=model), schema)
    return rows.select(F.col("id").alias(id_col), F.coalesce(fold("id") == HELD_OUT, F.lit(False)).alias("held_out"), "score",
                       (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _score_rows(batches: Iterator[pa.RecordBatch], model: ToxicityModel) -> Iterator[pa.RecordBatch]:
    reader = Reader(model.lexicon)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = [raw.decode() for raw in raw_texts(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(reader, texts), pa.float64())], names=["id", "score"])
