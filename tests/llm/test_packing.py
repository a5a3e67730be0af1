import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tillroll.llm import packing, tokens


@pytest.mark.parametrize("seed", range(6))
def test_each_piece_goes_to_a_tightest_compatible_bin(seed):
    rng = random.Random(seed)
    rows = sorted([(rng.choice([None, "hot", "hot", "a", "b", "c"]), rng.choice([None, 1, 1, 2, *range(3, 40)]), rng.randint(1, 260)) for _ in range(400)],
                  key=lambda r: -(r[2] % 100))
    free, sources, clusters = {}, defaultdict(Counter), defaultdict(set)
    pieces = Counter()
    for row, piece, one, offset, size in packing.pack_shard(rows, 100, 2):
        source, cluster, total = rows[row]
        pieces[row] += size
        if size == 100:
            assert one not in free and offset == 0
            continue
        assert piece == total // 100 and size == total % 100
        fits = [b for b in free if free[b] >= size and (source is None or sources[b][source] < 2) and (cluster is None or cluster not in clusters[b])]
        if fits:
            assert one in fits and free[one] == min(free[b] for b in fits)
        else:
            assert one not in free
            free[one] = 100
        assert offset == 100 - free[one]
        free[one] -= size
        sources[one][source] += source is not None
        clusters[one].add(cluster)
    assert pieces == Counter({i: r[2] for i, r in enumerate(rows)})


def test_rows(spark):
    rows = [(i, f"word{i} " * (i % 50), "hot" if i % 3 else "cold") for i in range(300)]
    rows += [(1000, "copy of one text", "a")] * 40 + [(None, None, None), (None, "", "x"), (5000, "long " * 9000, "a")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, bin_id int")
    got = packing.pack(docs, capacity=256, shard_rows=64).collect()
    want = tokens.encoder(None).count([t or "" for _, t, _ in rows]) + 1
    assert sum(r.n_tokens for r in got) == want.sum()
    bins = defaultdict(list)
    for r in got:
        bins[r.bin_id].append(r)
    source = {i: s for i, _, s in rows}
    for members in bins.values():
        members.sort(key=lambda r: r.bin_offset)
        ends = [0]
        for r in members:
            assert r.bin_offset == ends[-1]
            ends.append(r.bin_offset + r.n_tokens)
        assert ends[-1] <= 256
        assert max(Counter(source[r.doc_id] for r in members if r.doc_id is not None).values(), default=0) <= 2
        assert sum(r.doc_id == 1000 for r in members) <= 1
    assert sum(r.n_tokens for r in got if r.doc_id == 5000) == tokens.encoder(None).count(["long " * 9000])[0] + 1


def test_without_source_and_with_given_clusters(spark):
    docs = spark.createDataFrame([(i, "x y z", i % 2 or None) for i in range(20)], "doc_id long, text string, group int")
    got = packing.pack(docs, cluster_col="group", capacity=64).collect()
    odd = Counter(r.bin_id for r in got if r.doc_id % 2)
    assert max(odd.values()) == 1 and len(got) == 20


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert packing.pack(docs).collect() == []


def test_same_bins_for_any_partitioning(spark):
    docs = spark.createDataFrame([(i, "a b c " * (i % 30), "s" + str(i % 4)) for i in range(200)], "doc_id long, text string, source string")
    one, other = (sorted(map(tuple, packing.pack(docs.repartition(n, F.hash("doc_id")), capacity=128, shard_rows=50).collect())) for n in (1, 7))
    assert one == other


@pytest.mark.parametrize("row", [(7, "one text", "hot"), (None, None, None)])
def test_repeated_rows_use_all_shards(spark, row):
    docs = spark.createDataFrame([row] * 2000 + [(i, f"text {i}", "cold") for i in range(100, 600)], "doc_id long, text string, source string")
    got = packing.pack(docs, capacity=64, shard_rows=250).collect()
    assert len(got) == 2500
    copies = Counter(r.bin_id >> 32 for r in got if r.doc_id == row[0])
    assert sorted(copies) == list(range(10)) and set(copies.values()) == {200}
    assert Counter(r.doc_id for r in got if r.doc_id != row[0]) == Counter(range(100, 600))
