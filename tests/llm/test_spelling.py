import random
import re
import zlib
from collections import Counter

import pytest

from tillroll.llm import spelling


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute_counts(rows, thinned=spelling.THINNED):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            value = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            counts[run if value % thinned else run[:value % len(run)] + run[value % len(run) + 1:]] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def brute_variants(counts):
    out = {}
    near = {w: [v for v in counts if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in counts}
    for w, n in counts.items():
        form = min(near[w], key=lambda v: (-counts[v], v), default=None)
        out[w] = form if form and counts[form] >= 5 * n else None
    rows = set()
    for w in counts:
        root = w
        while out[root]:
            root = out[root]
        rows.add((w, out[w], root, counts[w], len(near[w]), counts.get(out[w])))
    return rows


def as_rows(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def vocabulary(seed, n, letters="abé", least=6, most=9):
    rng = random.Random(seed)
    return {"".join(rng.choices(letters, k=rng.randint(least, most))): rng.choice([5, 6, 30, 200, 1000, 6000]) for _ in range(n)}


@pytest.mark.parametrize("seed, chunk, cells", [(1, 4096, 1 << 24), (2, 7, 1 << 24), (3, 4096, 50)])
def test_variants_equal_brute_force(spark, monkeypatch, seed, chunk, cells):
    """Also with blocks dealt to pairs of chunks, and with matrices cut into slices."""
    monkeypatch.setattr(spelling, "CHUNK", chunk)
    counts = vocabulary(seed, 500)
    rows = list(counts.items())
    found = next(iter(spelling._compare(_tile_table(rows)))) if chunk == 4096 else None
    assert found is None or found.num_rows
    monkeypatch.setattr(spelling, "CELLS", cells)
    assert as_rows(spelling.variants(spark.createDataFrame(rows, "word string, n long"))) == brute_variants(counts)


def _tile_table(rows):
    import pyarrow as pa
    same = [(w, n) for w, n in sorted(rows) if len(w) == 7 and w[:5] == sorted(x for x, _ in rows if len(x) == 7)[0][:5]] or rows[:2]
    same += [("aaaaaaa", 5), ("aaaaaba", 5)]
    zero = [0] * len(same)
    return pa.table({"longer": [7] * len(same), "block": zero, "kind": zero, "low": zero, "high": zero, "chunk": zero,
                     "word": [w for w, _ in same], "n": [n for _, n in same]})


def test_long_words_and_other_alphabets(spark):
    long = "x" * 30_000
    counts = {long: 5, long + "y": 40, "y" + long: 5, "слово1": 7, "слова1": 70, "abc": 5, "abd": 30, "ab": 900, "bc": 1}
    counts = {w: n for w, n in counts.items() if len(w) > 2}
    assert as_rows(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))) == brute_variants(counts)


def test_chains_lead_to_their_last_form(spark):
    words = ["aaaaaaaa"[:i] + "bbbbbbbb"[i:] for i in range(9)]
    counts = {w: 5 * 6**i for i, w in enumerate(words)}
    got = {r.word: r.root for r in spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert set(got.values()) == {words[-1]}


def test_counts_of_whole_texts(spark, monkeypatch):
    rng = random.Random(4)
    words = list(vocabulary(5, 40)) + ["short", "ÉCOLES", "Écoles", "ab1cdefgh"]
    rows = [(i if i else None, " ".join(rng.choices(words, k=rng.randint(0, 300))) + rng.choice(["", ".", "\n"])) for i in range(60)]
    rows += [(7, None), (8, ""), rows[3], rows[3], (9, "abcdefg," * 40_000)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, word string, n int")
    monkeypatch.setattr(spelling, "PIECE", 1000)
    monkeypatch.setattr(spelling, "HELD_WORDS", 10)
    pulled = list(spelling.pieces(rows[10][1] * 9))
    assert "".join(pulled) == rows[10][1] * 9 and len(pulled) > 1
    got = {r.word: r.n for r in spelling.count_words(docs, thinned=3).collect()}
    assert got == brute_counts(rows, 3)
    assert as_rows(spelling.group_variants(docs)) == brute_variants(brute_counts(rows))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.group_variants(docs).collect() == []
