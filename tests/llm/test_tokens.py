import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tillroll.llm import tokens
from tillroll.session import stream_folder

import public_tokenizers

LIBRARY = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY_FILE))


def encoded(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_pieces_give_the_ids_of_the_whole_text():
    rng, code = random.Random(2), tokens.Encoder(public_tokenizers.path(tokens.VOCABULARY_FILE))
    signs = [" ", "\n", "\t", "a", "B", "é", "'s", "!", "1", " ", " ", "<|endoftext|>", "\x1c", "中", "'", "  ", "\r\n", "👍", "\x85", "​", "-", "×"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    for at in range(0, len(texts), 50):
        part = texts[at:at + 50]
        assert [i.tolist() for i in code.encode(part)] == [encoded(t) for t in part]
        assert code.count(part).tolist() == [len(encoded(t)) for t in part]


def test_a_worker_that_forgets_gives_the_same_ids(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    code = tokens.Encoder(public_tokenizers.path(tokens.VOCABULARY_FILE))
    for text in ("one two three four", "five six seven", "one two", "", "eight nine ten one"):
        assert code.encode([text])[0].tolist() == encoded(text)


@pytest.mark.parametrize("width", [1, 7, 8, 13, 16, 17, 32])
def test_packing_round_trip_and_random_access(width):
    ids = np.random.default_rng(width).integers(0, 2**width, 997).astype(np.uint32)
    packed = tokens.pack(ids, width)
    assert len(packed) == -(-997 * width // 8)
    assert (tokens.unpack(packed, width, 0, 997) == ids).all()
    for first, count in ((0, 0), (5, 1), (333, 100), (996, 1)):
        assert (tokens.unpack(packed, width, first, count) == ids[first:first + count]).all()


@pytest.mark.parametrize("block_ids", [1, 200, tokens.BLOCK_IDS])
def test_files_round_trip(spark, block_ids):
    rows = [(i * 7 % 101, f"Text number {i}, with words. " * (i % 9)) for i in range(101)] + [(None, "no id"), (500, None), (501, ""), (501, "same id"), (502, "long " * 4000)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, shard int, ids string").repartition(5)
    folder = stream_folder(spark)
    tokens.write(docs, folder, block_ids=block_ids)
    got = sorted((tuple(r) for r in tokens.read(spark, folder).collect()), key=lambda r: r[1])
    start, want = 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*encoded(text), 2], "<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    assert tokens.document(spark, folder, 502).tolist() == [*encoded("long " * 4000), 2]
    assert tokens.document(spark, folder, 9999) is None


def test_empty_table(spark):
    assert tokens.round_trip(spark.createDataFrame([], "doc_id long, text string")).collect() == []
