import random

import numpy as np
import pytest
import xxhash

from tillroll.llm import graph, simhash


def brute_print(text, words=3):
    tokens = (text or "").encode().lower().split()
    shingles = [b" ".join(tokens[i:i + words]) for i in range(len(tokens) - words + 1)] or ([b" ".join(tokens)] if tokens else [])
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, radius=3):
    group = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius and group[i] != group[j]:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    return group


def documents():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(500)] + ["É", "ß"]
    out = []
    for i in range(60):
        words = rng.choices(vocabulary, k=rng.randint(0, 200))
        out.append(" ".join(words))
        for _ in range(rng.choice([0, 0, 2, 5])):
            copy = list(words)
            if copy:
                copy[rng.randrange(len(copy))] += "x"
            out.append("\t".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    return out + [out[3]] * 30 + [None, "", "  \n", "one", "one two", "One Two", "a b c"]


@pytest.mark.parametrize("limit", [simhash.GROUP_LIMIT, 5])
def test_components_are_those_of_all_pairs(spark, limit):
    texts = documents()
    docs = spark.createDataFrame([(i + 10, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, fp string, component_id int")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs, group_limit=limit).collect()}
    prints = [brute_print(t) for t in texts]
    groups = brute_groups(prints)
    assert [got[i + 10].fingerprint for i in range(len(texts))] == [format(p, "016x") for p in prints]
    assert [got[i + 10].component_id for i in range(len(texts))] == [g + 10 for g in groups]


def in_gray_order(codes, head, side):
    rank = [int(c) for c in codes]
    for step in (1, 2, 4, 8, 16, 32):
        rank = [r ^ r >> step for r in rank]
    order = sorted(range(len(codes)), key=lambda i: (head[i], side[i], rank[i]))
    return codes[order], head[order], side[order]


@pytest.mark.parametrize("heads, fan", [(1, 16), (1, 2), (9, 16), (400, 16), (400, 3)])
def test_index_finds_every_pair_of_a_head_and_no_other(monkeypatch, heads, fan):
    monkeypatch.setattr(simhash, "FAN", fan)
    monkeypatch.setattr(simhash, "FRONTIER", 50)
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 2**64, 40, dtype=np.uint64)
    codes = np.concatenate([seeds] + [seeds ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(9)])
    head = np.tile(rng.integers(0, heads, 40), 10)
    for cut in (False, True):
        side = 2 * head + rng.integers(0, 2, 400) if cut else np.full(400, -1)
        codes, head, side = in_gray_order(codes, head, side)
        got = [(i, j) for x, y in simhash.close_pairs(simhash.Index(codes, head, side), 3) for i, j in zip(x.tolist(), y.tolist())]
        want = {(i, j) for j in range(400) for i in range(j) if head[i] == head[j] and not (cut and side[i] == side[j])
                and int(codes[i] ^ codes[j]).bit_count() <= 3}
        assert len(got) == len(set(got)) and set(got) == want and want


def test_index_prunes_whole_groups(monkeypatch):
    rng = np.random.default_rng(5)
    codes, head, side = in_gray_order(rng.integers(0, 2**64, 5000, dtype=np.uint64), np.zeros(5000, np.int64), np.full(5000, -1))
    index, asked = simhash.Index(codes, head, side), {}
    near = index.near
    monkeypatch.setattr(index, "near", lambda level, x, y, radius: (asked.__setitem__(level, asked.get(level, 0) + len(x)), near(level, x, y, radius))[1])
    for _ in simhash.close_pairs(index, 0):
        pass
    assert asked[0] < 5000 * 4999 / 2 / 4 and asked[1] < 313 * 314 / 2
    assert len(index.levels) == 5


def test_one_code_and_none():
    none = np.zeros(0, np.int64)
    assert list(simhash.close_pairs(simhash.Index(none.astype(np.uint64), none, none), 3)) == []
    one = np.zeros(1, np.int64)
    assert list(simhash.close_pairs(simhash.Index(one.astype(np.uint64), one, one - 1), 3)) == []


def test_text_longer_than_a_piece(monkeypatch):
    text = "alpha beta gamma delta " * 40
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "PIECE", 50)
    assert simhash.fingerprint(text.encode()) == whole
    assert whole & (1 << 64) - 1 == brute_print(text)


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (9, "a b c d"), (8, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, None), (None, None), (7, 7), (7, 7), (9, 7), (8, 8)], key=str)
    kept = simhash.keep_first(spark, docs, "")
    assert sorted((str(r.doc_id) for r in kept.collect())) == ["7", "7", "8", "None", "None"] and kept.columns == docs.columns
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


@pytest.mark.parametrize("links", [[], [(1, 1), (None, 2)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)] + [(100, 101), (101, 100)]])
def test_components_of_paths_and_stars(spark, links):
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {n: min(m for l in ([(a, b) for a, b in links if a != b and a is not None and b is not None]) for m in l if (m >= 100) == (n >= 100))
            for l in links if None not in l and l[0] != l[1] for n in l}
    assert {n: c for n, c in got.items() if n != c} == {n: c for n, c in want.items() if n != c}
