import random

from pyspark.sql import functions as F

from tillroll import vocabulary as V
from tillroll.functions.categories import classify, is_unresolved, keyword_places, label_source, reporting_label, write_label

GOLDEN = {
    V.EGGS: ["Kūtī dētas olas 10gab."],
    V.MEAT: ["Liellopa maltā gaļa WELL DONE 400g", "Cāļa krūtiņas fileja WELL DONE 500g",
             "Vār. Doktordesa MELNAIS BARONS 400g", "Liell. g. uzkoda Beef Jerky Classic WD 40g",
             "Cāļa šķiņķi grieķu jog. marinādē 400g", "K/k cūkgaļa kubiciņos Pīrādziņu RGK 350g"],
    V.FISH: ["Atlantijas laSa fileja kg", "Garneles NOWACO 16-20 b/g jēlas 300g"],
    V.DAIRY: ["Piens WELL DONE 2,0% 1L", "Jogurts GRIEĶU bez piedevām 400g", "Kausētais siers DZINTARS ar šķiņķi 200g",
              "Biezpiena sieriņš KĀRUMS šokolādes 45g", "Biezp. krēms KĀRUMS ar zem., ērkš. 140g",
              "Skābpiena dzēriens AYRAN Baltais 500ml"],
    V.SNACKS: ["Kartupeļu čipsi LAY'S siera 200g", "Čipsi ar siera garšu 130g", "Zemesrieksti ESTRELLA Čedaras siers 140g"],
    V.GROCERY: ["Pasta DE CECCO Spaghetti Nr. 12 500g", "Rīsi VALDO kārba 8x125g", "Griki Valdo 4x125g",
                "Pilngraudu auzu pārslas DOBELE 500g", "Kviešu milti WELL DONE 550D 2kg",
                "Saulespuķu eļļa EXTRA LINE 1L", "RAMEN nūdeles SANTA MARIA 200G"],
    V.SAUCES: ["Tomātu pasta SPILVA 520g", "Salsas mērce DIP SANTA MARIA vid. as. 250g",
               "Majonēze HELLMANNS ORIGINAL 76% 405ml"],
    V.READY_MEALS: ["Nūd. zupa NONGSHIM KIMCHI RAMYUN 120g", "Ā/p nūdeles Carbonara SAM YANG 130g",
                    "Sviestm. GIGA ar vist. g. gurķi sieru 260g", "Gaļas salāti ar šķiņķi 500g"],
    V.FROZEN: ["Saldēti frī kartupeļi AVIKO Steak 750g", "Saldējums MAGNUM Mini Mix 6x42g"],
    V.BAKERY: ["Baltmaize kefīra Lielmaize LM 500g", "Kruasāns 7DAYS ar kakao krēmu 60g",
               "Kruasāns ar šokolādes pildījumu 60g", "Burgeru maizītes Maiziņš 240g",
               "Tostermaize kefīra vērtīgā FAZER 450g"],
    V.SOFT_DRINKS: ["Zaļā tēja LIPTON aveņu-zemeņu 20x1,4g", "Malta kafija LAVAZZA CLUB 250g",
                    "Dzeramais ūdens AQUA negāzēts 5L", "Gāzēts dzēriens FANTA ORANGE 2L PET D",
                    "Energijas dzériens Monster 0,51", "Coca-Cola Zero 1.5L",
                    "Gāz. dz. SANPELLEGRINO Mel.&Aran. 330ml D", "Ledus tēja FUZETEA citr.-citronz. 1,5L D"],
    V.ALCOHOL: ["Alus MADONAS nefiltrēts 5,6% 0,5L D", "Sidrs LIELVĀRDES CRAFT CAN 5,6% 0,5L D",
                "Vīns POMEGRANATE 12,5% 0,75L"],
    V.PETS: ["Konservi kaķiem JOSI liellopa 100g", "Konservi kaķiem ar tunci 100g"],
    V.HOUSEHOLD: ["Zobu pasta SENSODYNE COMPL. PROTECT. 75ml", "Matu šampūns DZINTARS 250ml",
                  "Papīra dvieļi BLOOM Comfort 2k. 500lap.", "Dabiskā lateksa cimdi SPONTEX M",
                  "Zobu birste COLGATE Ultra Soft 1+1", "Tual. tīr. līdz. DOMESTOS Lime 700ml"],
    V.BABY: ["BIO biez. RŪDOLFS dārz. rīsi vista 6+ 110g"],
    V.SERVICE: ["Papildus depozīta maksa", "Papīra iepirkumu maisiņš PALDIES"],
    V.PRODUCE: ["Āboli ROYAL GALA 75+ kg 2. šķ.", "Šampinjoni 250g", "Ķirbis RIEKSTU kg 2. šķ."],
    V.UNRESOLVED: ["Produkts TEST 5,0% 500g", "Sald. TEST 500g", "Santa Maria 250g", "Spilva 500g",
                   "Dārzeņi cepšanai HORTEX 400g", "Humoss ar zaļumiem ATLANTIKA 200g",
                   "Kuskuss ar dārzeņiem GRACI 300g", "Kukurūzas saldās vālītes vārītas 450g",
                   "Gurķu-sinepju salāti SPILVA 390g", "Pankūkas ar biezpiena pildīj. MĀJAS 420g",
                   "Siera uzkoda WELL DONE PREMIUM Pizza 24g", "Pulveris Isostar H&P apelsinu 400g", "", None],
}


def test_golden_names(spark):
    rows = [(n, c) for c, listing in GOLDEN.items() for n in listing]
    df = classify(spark.createDataFrame(rows, "name string, expected string"))
    wrong = df.where(F.col("predicted") != F.col("expected")).collect()
    assert wrong == []
    sources = {r[0]: r[1] for r in df.select("predicted", label_source(F.col("predicted"))).distinct().collect()}
    assert sources[V.UNRESOLVED] == "fallback" and sources[V.EGGS] == "rule"


def test_labels(spark):
    df = spark.createDataFrame([("Напитки ",), (V.EGGS,), (None,), (" ",), ("Promo",)], "c string")
    out = df.select(reporting_label(F.col("c")), write_label(F.col("c"))).collect()
    assert [tuple(r) for r in out] == [(V.UNRESOLVED, V.SOFT_DRINKS), (V.EGGS, V.EGGS),
                                       (V.UNRESOLVED, V.UNRESOLVED), (V.UNRESOLVED, V.UNRESOLVED), ("promo", "promo")]


def test_unresolved_filter_both_readings(spark):
    df = spark.createDataFrame([(V.UNRESOLVED,), (V.EGGS,), (None,), ("old",)], "c string")
    assert [r[0] for r in df.select(is_unresolved(F.col("c"))).collect()] == [True, False, True, True]
    assert [r[0] for r in df.select(is_unresolved(F.col("c"), True)).collect()] == [False, False, True, True]


def test_keyword_tree_equals_substring_tests():
    rng, words = random.Random(1), [w for listing in V.KEYWORDS.values() for w in listing]
    patterns = V.keyword_patterns()
    for _ in range(3000):
        parts = [rng.choice(words).rstrip("*") + rng.choice(["", "", "x", "iem"]) for _ in range(rng.randint(0, 5))]
        text = f" {' '.join(parts)} "
        found = keyword_places(text)
        for at, category in enumerate(V.CATEGORY_PRIORITY):
            assert found[at] == min((text.find(p) + 1 for p in patterns[category] if p in text), default=0), (text, category)


def test_pattern_table_is_complete():
    patterns = V.keyword_patterns()
    assert set(patterns) == set(V.CATEGORY_PRIORITY) and len(V.CATEGORY_PRIORITY) == 17
    assert " cukgal" in patterns[V.MEAT] and " tual tir" not in patterns[V.HOUSEHOLD]
