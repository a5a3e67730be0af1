import random
from decimal import Decimal

import pytest

from tillroll.functions import similarity
from tillroll.plans import products
from tillroll.operators.ranking import with_rank

SCHEMA = "name string, normalized_name string, canonical_name string, receipt_id long, category string"


def suggest(spark, names, ordered=similarity.ORDERED):
    items = spark.createDataFrame([(n, None, None, i, "яйца") for i, n in enumerate(names)], SCHEMA)
    return products.duplicate_suggestions(products.with_match_features(products.catalogue(items)), ordered=ordered).collect()


@pytest.mark.parametrize("left, right, expected", [
    ("GRIMBERGEN Blonde 6,7% 0,5L", "GRIMBERGEN Blonde 6.7% 500 ml", "high"), ("Blue Moon 0.33L", "Blue Moon 0.5L", None),
    ("Kūtī dētas olas 10gab", "Kūtī dētas olas WELL DONE 10gab", "possible"), ("Biezenis RŪDOLFS 110g", "Biezenis RŪDOLFS 6x110g", None),
    ("Biezenis RŪDOLFS 6x110g", "Biezenis RŪDOLFS 4x110g", None), ("Saldais krējums EXPORTA 35% 200ml", "Saldais krējums Exporta 35% 200g", None),
    ("Cipsi Adazu ar siera garsu 130g", "Čipsi ĀDAŽU ar siera garšu 130g", "high"), ("Coca Cola Zero 1L", "Coca Cola Original 1L", None),
    ("Gāzēts dzēriens PEPSI 1L", "Gāzēts dzēriens PEPSI MAX 1L", None), ("Gurķi īsie kg", "Gurķi īsie kg 2. šķ.", None),
    ("Produkts Alfa Beta 500g", "Produkts Alfa Beta Plus 500g", "possible"), ("Ķiploki kg", "Ķiploki 50+ mm kg", None),
    ("Kūtī dētas olas WELL DONE L izm. 10gab", "Kūtī dētas olas WELL DONE M izm. 10gab", None), ("Burkāni 1kg", "Burkāni jaunie 1kg", None),
    ("Rīsi VALDO kārba 8x125g", "Rīsi Valdo 8x125g", "possible"),
])
def test_pairs(spark, left, right, expected):
    assert [r.confidence for r in suggest(spark, [left, right])] == ([] if expected is None else [expected])


def test_pair_details(spark):
    r, = suggest(spark, ["Cipsi Adazu ar siera garsu 130g", "Čipsi ĀDAŽU ar siera garšu 130g"])
    assert (r.score, r.weight_g, r.same_category, r.same_words, r.merge_term) == (100.0, 130, True, True, "adazu")


def brute(spark, names):
    """All pairs of the names, by the same tests on every pair."""
    items = spark.createDataFrame([(n, None, None, i, "яйца") for i, n in enumerate(names)], SCHEMA)
    rows = products.with_match_features(products.catalogue(items)).collect()
    agree = lambda a, b: a is None or b is None or a == 0 or b == 0 or a == b
    out = set()
    for i, a in enumerate(rows):
        for b in rows[i + 1:]:
            kinds = [x.f.volume_ml is not None and y.f.volume_ml is not None or x.f.weight_g is not None and y.f.weight_g is not None for x, y in ((a, b),)]
            measured = [x.f.volume_ml is not None or x.f.weight_g is not None for x in (a, b)]
            far = a.f.percentage is not None and b.f.percentage is not None and abs(a.f.percentage - b.f.percentage) > Decimal("0.05")
            if (a.pack == b.pack and a.variants == b.variants and not (all(measured) and not kinds[0]) and agree(a.f.volume_ml, b.f.volume_ml)
                    and agree(a.f.weight_g, b.f.weight_g) and not far and not (a.normalized == b.normalized and a.identity == b.identity)
                    and (similarity.sort_ratio(a.comparison, b.comparison) + similarity.set_ratio(a.comparison, b.comparison)) / 2 >= 88):
                out.add(frozenset((a.identity, b.identity)))
    return out


def test_all_pairs_are_found_in_any_order_of_the_index(spark):
    rng = random.Random(3)
    words = "piens balts svaigs lauku maize rupja zaļā tēja siers zero classic olas krējums salds".split()
    sizes = ["", "", "1L", "0,5L", "500g", "0g", "1kg 1L", "2x100g", "6x110g", "3,5%", "3,5% 1L"]
    names = [" ".join([*rng.sample(words, rng.randint(1, 5)), rng.choice(sizes)]).strip() for _ in range(260)]
    names += [n[:k] + rng.choice("aeiš") + n[k:] for n in names[:120] for k in (rng.randint(0, len(n)),)] + [f"Piens Balts Svaigs Lauku n{i}" for i in range(60)]
    names = sorted(set(names))
    want = brute(spark, names)
    assert len(want) > 1500
    for ordered in (similarity.ORDERED, 37):
        got = [frozenset((r.left_identity, r.right_identity)) for r in suggest(spark, names, ordered)]
        assert len(got) == len(set(got)) and set(got) == want


def test_resolve_names(spark):
    items = spark.createDataFrame([("a", None, "X"), ("b", None, "X"), ("b", None, "Y"), ("X", None, None)], "name string, normalized_name string, canonical_name string")
    asked = spark.createDataFrame([("a",), ("b",), ("X",), ("?",)], "asked string")
    assert {r.asked: r.identity for r in products.resolve_names(asked, items).collect()} == {"a": "X", "b": None, "X": "X", "?": None}


def test_rank_equals_sorted_position(spark):
    rows = [(i * 7919 % 97, i) for i in range(400)]
    out = with_rank(spark.createDataFrame(rows, "a long, b long").repartition(5), "a", "b").collect()
    want = {r: i for i, r in enumerate(sorted(rows))}
    assert all(want[(r.a, r.b)] == r["rank"] for r in out) and len(out) == 400


def test_candidates_stay_near_the_results(spark):
    """Every pair that reaches the score is a candidate, few others are, and no pair of a block's settled side."""
    rng = random.Random(5)
    words = "piens balts svaigs lauku maize rupja tēja siers olas krējums salds desa gaļa zivs sula rīsi milti cukurs".split()
    names = sorted({" ".join(rng.sample(words, rng.randint(2, 5))) for _ in range(2000)})
    rows = [("x", f"{i:04d}", n, 2 if i % 4 else 1) for i, n in enumerate(names)] + [("y", "9998", "piens balts", 1), ("y", "9999", "balts piens", 1)]
    table = spark.createDataFrame(rows, "block string, pid string, comparison string, side int")
    want = {(f"{i:04d}", f"{j:04d}") for i, a in enumerate(names) for j, b in enumerate(names[i + 1:], i + 1)
            if (i % 4 or j % 4) and (similarity.sort_ratio(a, b) + similarity.set_ratio(a, b)) / 2 >= 88}
    got = {tuple(r) for r in similarity.candidates(table, 88.0).collect()}
    assert want <= got and len(got) <= 20 * len(want) and not any("99" in pair[0][:2] for pair in got)
    assert {(r.left_pid, r.right_pid) for r in similarity.similar_pairs(table, 88.0).collect()} == want


@pytest.mark.parametrize("seed", range(3))
def test_every_score_leaves_a_trace(seed):
    """The bounds of the index hold for names with misspelt, repeated and missing words."""
    rng = random.Random(seed)
    for _ in range(3000):
        a = " ".join(rng.choices(["ab", "abc", "b", "cab", "dd", "ee"], k=rng.randint(1, 5)))
        b = "".join(c for c in a if rng.random() > 0.1)
        b = " ".join(rng.sample(b.split(), len(b.split())) + rng.choice([[], ["x"], ["ab"]]))
        if not b.strip() or (similarity.sort_ratio(a, b) + similarity.set_ratio(a, b)) / 2 < 88:
            continue
        order, apart = {}, 0.12
        heads = []
        for n in (a, b):
            heads.append({p for t in similarity._views(n)[1] for p in sorted(similarity.letter_pairs(t))[:int(4 * apart / (1 + apart) * len(t) + 1e-9) + 1]})
        words = [set(n.split()) for n in (a, b)]
        rare = [similarity._rare_words(sorted(w), order, apart) for w in words]
        assert heads[0] & heads[1] or rare[0] & words[1] or rare[1] & words[0], (a, b)
