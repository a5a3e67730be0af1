from pyspark.sql import functions as F

from tillroll.functions import names, receipts
from tillroll.functions.similarity import set_ratio, sort_ratio


def column(spark, values, build, name="v"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.withColumn("o", build(F.col("v"))).orderBy("i").select("o").collect()]


def test_normal_form(spark):
    cases = {
        "Alus GRIMBERGEN Blonde 6,7% 0,5L sk. D": "alus grimbergen blonde 6.7% 500ml",
        "GRIMBERGEN Blonde 6.7% 500 ml": "grimbergen blonde 6.7% 500ml",
        "Coca-Cola Zero 1 L PET": "coca cola zero 1000ml",
        "blue moon 5,4% 0.33l": "blue moon 5.4% 330ml",
        "Siers 0.5 kg": "siers 500g",
        "Olas 10 gab.": "olas 10gab",
        "Olas 2,5gab": "olas 2.5gab",
        "Kūtī/dētas  12 %": "kūtī dētas 12%",
        "A 1kg B 2,25 l": "a 1000g b 2250ml",
        "": "",
    }
    assert column(spark, list(cases), names.normalize) == list(cases.values())


def test_features(spark):
    rows = column(spark, ["blue moon 5.4% 330ml", "siers 500g", "piens 2.0%"], names.features)
    assert [(r.volume_ml, r.weight_g, None if r.percentage is None else float(r.percentage)) for r in rows] == [
        (330, None, 5.4), (None, 500, None), (None, None, 2.0)]


def test_multipack_and_tokens(spark):
    assert column(spark, ["6x110g", "6 x 0,11 kg", "6×110g", "6х110g", "110g"], names.multipack) == [
        "6 x 110 g"] * 4 + [None]
    assert column(spark, ["blue moon 330ml a bb"], names.significant_tokens) == [["bb", "blue", "moon"]]


def test_variants(spark):
    df = spark.createDataFrame([("gurki isie kg", "Gurki isie kg 2. sk."), ("pepsi max", "PEPSI MAX"),
                                ("olas l izm", "olas L izm. 10gab"), ("kiploki 50", "Kiploki 50+ mm kg")],
                               "c string, f string")
    out = [r[0] for r in df.select(names.variants(F.col("c"), F.col("f"))).collect()]
    assert out == [["quality-grade:2"], ["max"], ["egg-size:l"], ["caliber:50"]]


def test_valid_names(spark):
    assert column(spark, ["gab", "gab.", "kg", "500g", "500g.", "12", "Siers", None], names.is_valid_item_name) == [
        False, False, False, False, False, False, True, False]


def test_name_issue(spark):
    cases = {"": "empty_name", "Čeks 123": "receipt_header", "Papildus depozīta maksa": "service_line",
             "Siers lkg": "ocr_lkg", "Piens 500m1": "ocr_m1", "Piens 1, 25L": "unsafe_decimal_corruption",
             "sviestu250g": "glued_package_token", "Piens 1L": None, "Rīsi 8x125g": None}
    assert column(spark, list(cases), receipts.name_issue) == list(cases.values())


def test_contamination_and_action(spark):
    cases = {"Piens 1, 5L": ("ocr_decimal_corruption", "corrected"), "Kase Nr. 12": ("cashier_line", "rejected"),
             "Rīsi 8x125g": ("multipack", "unresolved"), "Olas 6gab. 300g": ("ambiguous_package_size", "unresolved"),
             "Piens 1L": ("unknown", "unchanged"), "sviestu250g": ("glued_tokens", "rejected"),
             "Piens — 1L": ("unknown", "corrected")}
    df = receipts.with_contamination(spark.createDataFrame([(n,) for n in cases], "name string"))
    assert {r.name: (r.contamination, r.action) for r in df.collect()} == cases


def test_metadata_lines(spark):
    lines = ["SIA RIMI LATVIA", "Maxima", "Čeks 123/456", "123/456", "Kase Nr. 12", "Paldies par pirkumu!",
             "Piens 1L", "Rimi piens"]
    assert column(spark, lines, receipts.is_metadata_line) == [True] * 6 + [False] * 2


def test_ratios():
    assert sort_ratio("a b", "b a") == 100.0
    assert set_ratio("olas 10gab", "olas well done 10gab") == 100.0
    assert round(sort_ratio("abcd", "abce"), 2) == 75.0
    assert set_ratio("", "x") == 0.0


def brute_common(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


def test_common_length_against_table():
    import random
    from tillroll.functions.similarity import common_length
    rng = random.Random(1)
    for _ in range(300):
        a = "".join(rng.choice("abc d") for _ in range(rng.randint(0, 70)))
        b = "".join(rng.choice("abc d") for _ in range(rng.randint(0, 70)))
        assert common_length(a, b) == brute_common(a, b)
