"""Similarity of two names: mean of the token-set and the token-sort ratio, and the search for alike names.

A pair whose mean reaches s has a ratio of s or more. That is one of three things, and each
leaves a trace that an index finds:

* the sorted words, all of them or the distinct ones, are at most (100 - s) % of their letters
  apart in insertions and deletions. Then they share many pairs of letters;
* the words of one name that the other lacks are few letters against the common ones;
* all words of one name are in the other, the rest being short enough for the other ratio.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.session import stored

#: Letter pairs and words whose frequency orders the index; others count as rarer. Any bound gives the same pairs.
ORDERED = 1 << 16
BITS = ("b0", "b1", "b2", "b3")


def common_length(left: str, right: str) -> int:
    """Length of the longest common subsequence, one machine-word row per letter."""
    masks: dict[str, int] = {}
    for i, letter in enumerate(left):
        masks[letter] = masks.get(letter, 0) | (1 << i)
    full = (1 << len(left)) - 1
    row = full
    for letter in right:
        matched = row & masks.get(letter, 0)
        row = ((row + matched) | (row - matched)) & full
    return len(left) - row.bit_count()


def _percent(distance: int, length: int) -> float:
    return 100.0 - 100.0 * distance / length if length else 100.0


def _distance(left: str, right: str) -> int:
    return len(left) + len(right) - 2 * common_length(left, right)


def sort_ratio(left: str, right: str) -> float:
    left, right = " ".join(sorted(left.split())), " ".join(sorted(right.split()))
    return _percent(_distance(left, right), len(left) + len(right))


def set_ratio(left: str, right: str) -> float:
    a, b = set(left.split()), set(right.split())
    if not a or not b:
        return 0.0
    shared = a & b
    if shared and (a <= b or b <= a):
        return 100.0
    only_a, only_b = " ".join(sorted(a - b)), " ".join(sorted(b - a))
    base = len(" ".join(shared))
    gap = 1 if base else 0
    with_a, with_b = base + gap + len(only_a), base + gap + len(only_b)
    best = _percent(_distance(only_a, only_b), with_a + with_b)
    if base:
        best = max(best, _percent(gap + len(only_a), base + with_a), _percent(gap + len(only_b), base + with_b))
    return best


def similar_pairs(names: DataFrame, score: float, ordered: int = ORDERED) -> DataFrame:
    """(left_pid, right_pid, score, symmetric): all pairs of one block whose mean ratio reaches the score.

    `names` holds block, pid, comparison and side: of a block, those of side 2 meet all
    others, those of side 1 do not meet each other. Pairs come from `candidates`; they are scored
    with the two names beside them, and only pairs that reach the score leave a task.
    """
    texts = names.select("pid", "comparison").dropDuplicates(["pid"])
    pairs = candidates(names, score, ordered).join(texts.select(F.col("pid").alias("left_pid"), F.col("comparison").alias("a")), "left_pid").join(
        texts.select(F.col("pid").alias("right_pid"), F.col("comparison").alias("b")), "right_pid")
    return pairs.select("left_pid", "right_pid", "a", "b").mapInArrow(
        partial(_scored_pairs, score=score), "left_pid string, right_pid string, score double, symmetric double")


def candidates(names: DataFrame, score: float, ordered: int = ORDERED) -> DataFrame:
    """(left_pid, right_pid), left < right: pairs of a block that may reach the score, from one join of postings.

    Letter pairs and words are ordered by rarity. Names that must share t of their letter pairs
    share one among the first of them, all but the last t - 1 of a name; places, lengths and the
    number that may still follow are compared in the join. A name's rarest words are looked up
    among all words of the others and its words among the rarest ones of the others. Bits
    that stand for a name's letter pairs differ in no more places than the pairs do.
    """
    # the work is in the letters, not in the bytes that the planner counts
    tasks = names.sparkSession.sparkContext.defaultParallelism
    names = names.select("block", "pid", "comparison", "side").repartition(tasks, "pid")
    counted = names.select("pid", "comparison").dropDuplicates(["pid"]).select("comparison").mapInArrow(_feature_counts, "feature string, n long")
    common = counted.groupBy("feature").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "feature").limit(ordered).collect()
    order = {row.feature: row.n for row in common}
    postings = stored(names.mapInArrow(partial(_postings, order=order, score=score),
                                "block string, key string, pid string, side int, asks boolean, answers boolean, length int, place int,"
                                "b0 long, b1 long, b2 long, b3 long, words array<string>"))
    more = lambda end: [F.col(name).alias(f"{name}_{end}") for name in (*BITS, "words")]
    left = postings.where("side = 2 AND asks").select("block", "key", F.col("pid").alias("left_pid"), F.col("length").alias("n"), F.col("place").alias("i"), *more("n"))
    right = postings.where("answers").select("block", "key", F.col("pid").alias("right_pid"), F.col("length").alias("m"), F.col("place").alias("j"), "side", *more("m"))
    both, apart = F.col("n") + F.col("m"), F.abs(F.col("n") - F.col("m"))
    # the least distance has the parity of both lengths
    most = F.floor(F.lit((100 - score) / 100) * both + F.lit(1e-9))
    most = most - F.pmod(most + both, F.lit(2))
    follow = 1 + F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j"))
    differ = sum(F.bit_count(F.col(f"{part}_n").bitwiseXOR(F.col(f"{part}_m"))) for part in BITS)
    alike = (apart <= most) & (2 * follow >= both + 2 - 3 * most) & (differ <= 3 * most)
    # a side's common words are all of one side, or so much of it that the rest is a small part
    common = F.array_intersect("words_n", "words_m")
    whole = lambda words: F.lit(score / (200 - score)) * F.length(F.array_join(words, " ")) - F.lit(1e-9)
    nested = (apart <= F.lit((200 - 2 * score) / 100) * both + F.lit(1e-9)) & (
        (F.size(common) == F.least(F.size("words_n"), F.size("words_m")))
        | (F.length(F.array_join(common, " ")) >= F.least(whole(F.col("words_n")), whole(F.col("words_m")))))
    found = left.join(right, ["block", "key"]).where(
        (F.col("left_pid") != F.col("right_pid")) & ((F.col("side") == 1) | (F.col("left_pid") < F.col("right_pid")))
        & F.when(F.col("i").isNull(), nested).otherwise(alike))
    return found.select(F.least("left_pid", "right_pid").alias("left_pid"), F.greatest("left_pid", "right_pid").alias("right_pid")).distinct()


def letter_pairs(text: str) -> list[str]:
    """The pairs of letters of a name, its words between spaces; repeated ones are numbered."""
    seen: Counter[str] = Counter()
    out = []
    padded = f" {text} "
    for i in range(len(padded) - 1):
        pair = padded[i:i + 2]
        seen[pair] += 1
        out.append(f"g{seen[pair]}:{pair}")
    return out


def _views(name: str) -> tuple[list[str], list[str]]:
    """Sorted distinct words, and the sorted strings whose letters are compared."""
    words = name.split()
    distinct = sorted(set(words))
    texts = [" ".join(distinct)]
    if len(distinct) < len(words):
        texts.append(" ".join(sorted(words)))
    return distinct, texts


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter[str] = Counter()
        for name in batch.column(0).to_pylist():
            words, texts = _views(name)
            counts.update(letter_pairs(texts[0]))
            counts.update(f"w:{word}" for word in words)
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["feature", "n"])


def _postings(batches: Iterator[pa.RecordBatch], order: dict[str, int], score: float) -> Iterator[pa.RecordBatch]:
    apart = (100 - score) / 100
    for batch in batches:
        out: list[tuple] = []
        for block, pid, name, side in zip(*(column.to_pylist() for column in batch.columns)):
            words, texts = _views(name)
            for text in texts if words else ():
                pairs = sorted(letter_pairs(text), key=lambda pair: (order.get(pair, 0), pair))
                bits = _bits(pairs)
                # a deletion loses two letter pairs, an insertion one; the shortest partner loses most
                lost = int(4 * apart / (1 + apart) * len(text) + 1e-9)
                out += [(block, pair, pid, side, True, True, len(text), place, *bits, None) for place, pair in enumerate(pairs[:lost + 1])]
            rare = _rare_words(words, order, apart)
            for word in words:
                out.append((block, f"a:{word}", pid, side, word in rare, True, len(texts[-1]), None, *[0] * len(BITS), words))
                out.append((block, f"b:{word}", pid, side, True, word in rare, len(texts[-1]), None, *[0] * len(BITS), words))
        types = [pa.string()] * 3 + [pa.int32(), pa.bool_(), pa.bool_(), pa.int32(), pa.int32(), *[pa.int64()] * len(BITS), pa.list_(pa.string())]
        columns = list(zip(*out)) if out else [[]] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                         names=["block", "key", "pid", "side", "asks", "answers", "length", "place", *BITS, "words"])


def _bits(pairs: list[str]) -> tuple[int, ...]:
    """A set of letter pairs as 256 bits in signed words; a bit may stand for several pairs."""
    bits = 0
    for pair in pairs:
        bits ^= 1 << (crc32(pair.encode()) >> 24)
    raw = bits.to_bytes(8 * len(BITS), "little")
    return tuple(int.from_bytes(raw[i:i + 8], "little", signed=True) for i in range(0, len(raw), 8))


def _rare_words(words: list[str], order: dict[str, int], apart: float) -> set[str]:
    """The rarest words, up to one that must be common if the others make up too much of the name."""
    total, rare, letters = len(" ".join(words)), set(), -1
    for word in sorted(words, key=lambda w: (order.get(f"w:{w}", 0), w)):
        rare.add(word)
        letters += len(word) + 1
        if (letters + 1) * (1 - apart) > 2 * apart * (total - 1 - letters) + 1e-9:
            break
    return rare


def _scored_pairs(batches: Iterator[pa.RecordBatch], score: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for left_pid, right_pid, a, b in zip(*(column.to_pylist() for column in batch.columns)):
            symmetric = sort_ratio(a, b)
            if symmetric >= 2 * score - 100:
                mean = (symmetric + set_ratio(a, b)) / 2
                if mean >= score:
                    out.append((left_pid, right_pid, mean, symmetric))
        columns = list(zip(*out)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()),
                                          pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.float64())],
                                         names=["left_pid", "right_pid", "score", "symmetric"])
