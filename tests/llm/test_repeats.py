import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from tillroll.llm import repeats


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[s:s + length] for r in raws for s in range(len(r) - length + 1))
    out = []
    for raw in raws:
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - length + 1):
            if seen[raw[s:s + length]] > 1:
                gone[s:s + length] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((len(raw), int(gone.sum()), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), sha256(kept).hexdigest()))
    return out


def texts():
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefgh ") for _ in range(400))
    out = [None, "", "a" * 50, "abc" * 30, base, base[10:200]]
    for _ in range(150):
        at = rng.randint(0, 390)
        out.append("".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 60))) + base[at:at + rng.randint(0, 60)] + "".join(rng.choice("ab") for _ in range(rng.randint(0, 30))))
    return out + out[20:30]


@pytest.mark.parametrize("settings", [{"length": 12, "prefix": 4}, {"length": 12, "prefix": 4, "group_limit": 2}, {"length": 30, "prefix": 29, "batches": 1}])
def test_removes_what_stands_twice(spark, settings):
    data = texts()
    ids = list(range(len(data)))
    ids[3], ids[-1] = None, ids[-2]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in zip(ids, data)], "doc_id long, text string, key int, first string")
    got = Counter(tuple(r) for r in repeats.remove_repeats(docs, **settings).collect())
    assert got == Counter((i, *b) for i, b in zip(ids, brute(data, settings["length"])))


def test_entries_file_equal_strings_alike():
    rng = np.random.default_rng(1)
    shared = rng.integers(97, 101, 300).astype(np.uint8)
    filed = []
    for pad in (0, 17, 90):
        raw = np.r_[rng.integers(97, 101, pad).astype(np.uint8), shared]
        key, _, first, place, count = repeats.sampled_suffixes(raw, 200, 32)
        assert count.sum() == len(raw) - 199 and first[0] == 0 and (np.diff(first) == count[:-1]).all()
        strings = {int(f + i) - pad: (int(k), int(p - i)) for k, f, p, n in zip(key, first, place, count) for i in range(n)}
        filed.append({s: v for s, v in strings.items() if s >= 0})
    assert filed[0] == filed[1] == filed[2]


def test_text_longer_than_a_piece(monkeypatch, spark):
    monkeypatch.setattr(repeats, "PIECE", 64)
    raw = np.frombuffer(("ab cd ef gh" * 40).encode(), np.uint8)
    whole = [(s, raw[s:s + 20].tobytes()) for s in range(len(raw) - 19)]
    found = [(start + s, raw[start + s:start + s + 20].tobytes()) for start, piece in repeats._pieces(raw, 20) for s in range(len(piece) - 19)]
    assert found == whole


def test_empty_table(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_levels_are_merged_only_for_a_next_batch(monkeypatch, spark):
    wrote = []
    monkeypatch.setattr(repeats, "written", lambda df: wrote.append(df) or df)
    family = repeats.Family()
    for keys in ([1, 2, 2, 3], [3, 4], [5, 5, 1], [6, 4, 7]):
        family.add(spark.createDataFrame([(k,) for k in keys], "key long"))
    assert len(wrote) == 5  # four batches, and the first two merged for the third
    assert sorted(r.key for r in family.repeated().collect()) == [1, 2, 3, 4, 5]


def test_texts_move_compressed():
    import pyarrow as pa
    texts = ["", "one two " * 500, "ā\x00"]
    out = next(repeats._packed(iter([pa.RecordBatch.from_arrays([pa.array([1, None, 3]), pa.array([4, 5, 6]), pa.array(texts)], names=["id", "check", "text"])])))
    assert [repeats.decompress(p).decode() for p in out.column(2).to_pylist()] == texts
    assert out.column(2).nbytes < 200 and out.column(0).to_pylist() == [1, None, 3]
