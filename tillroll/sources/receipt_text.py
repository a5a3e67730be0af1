"""Receipt documents to receipts and lines.

A document is one row and stays one row until its lines are found: neighbours of a line
are looked up in the document's own array of lines, so parsing needs no shuffle.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions.columns import UNICODE, UNICODE_FOLD, one_space, settled
from tillroll.functions.receipts import is_metadata_line, repair_text, text_issue

# --- fixed values: layouts ----------------------------------------------------------------
RIMI_HEADER = r"(?iuU)^(?:sia\s+)?rimi(?:\s+(?:latvia|latvija))?$"
RIMI_LINE = UNICODE_FOLD + r"(\d+(?:,\d+)?)\s*(gab|kg)\s+X\s+(\d+,\d{2})\s*EUR(?:/kg)?(?:\s+(\d+,\d{2}))?"
RIMI_STOP = ["sia rimi", "jur. adrese", "kase nr", "pvn", "sasijas", "čeks", "ceks", "elektroniska", "klients",
             "atlaides", "tavs letaupijums", "maksajumu", "apmaksa", "bankas", "terminala", "tirgotaja", "laiks",
             "visa", "kopa", "kopā", "saglabajiet", "rrn", "nopelnita", "atl.", "gala cena"]
# the same, with what stands before its first match and after it
RIMI_FIRST = UNICODE_FOLD + "(?s)^.*?" + RIMI_LINE.removeprefix(UNICODE_FOLD) + ".*$"
MAXIMA_LINE = UNICODE + r"\d+,\d{2}\s+X\s+[\d,]+"
MAXIMA_PRICE = UNICODE + r"\d+,\d{2}\s+X\s+"
MAXIMA_STOP = ["atlaide", "kopā", "summa", "apmaksai"]
DATE_DASHED = UNICODE + r"(\d{4})[-.](\d{2})[-.](\d{2})"
DATE_ANY = UNICODE + r"(\d{4})[-.](\d{2})[-.](\d{2})|(\d{2})\.(\d{2})\.(\d{4})"
MONEY_TEXT = UNICODE + r"\d+,\d{2}"
ITEM = ("array<struct<line_no: bigint, name: string, quantity: decimal(18,4), quantity_unit: string, "
        "unit_price: decimal(18,4), price: decimal(14,2)>>")


def read_documents(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """One row per text file; the file stem is the receipt number."""
    df = spark.read.option("wholetext", True).option("pathGlobFilter", pattern).text(path)
    return df.select(file_stem(F.col("_metadata.file_name")).alias("receipt_number"), F.col("value").alias("text"))


def file_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def _money(text: Column, kind: str = "decimal(14,2)") -> Column:
    return F.replace(F.nullif(text, F.lit("")), F.lit(","), F.lit(".")).try_cast(kind)


def _has_any(text: Column, words: list[str]) -> Column:
    return reduce(or_, [F.contains(text, F.lit(w)) for w in words])


def _first(lines: Column, test) -> Column:
    return F.get(F.filter(lines, test), 0)


def _judged(lines: Column, is_item, usable) -> Column:
    """Each line with whether it is an item or may be part of a name, looked at once."""
    items = F.transform(lines, lambda line: F.struct(line.alias("line"), F.lower(line).alias("lowered"), is_item(line).alias("item")))
    return F.transform(items, lambda l: F.struct(  # noqa: E741
        l["line"].alias("line"), l["item"].alias("item"), F.coalesce((l["line"] != "") & usable(l), F.lit(False)).alias("usable")))


def _neighbours(judged: Column) -> Column:
    """Lines that are items, each with the three lines before and after it."""
    around = F.transform(judged, lambda l, i: F.when(l["item"], F.struct(  # noqa: E741
        i.alias("i"), l["line"].alias("line"),
        *[F.get(judged, i - k).alias(f"p{k}") for k in (1, 2, 3)],
        *[F.get(judged, i + k).alias(f"n{k}") for k in (1, 2, 3)])))
    return F.array_compact(around)


def _named(items: Column, name) -> Column:
    """Attach the name and drop items whose name has a fault."""
    with_name = F.transform(items, lambda a: F.struct(a.alias("a"), F.trim(name(a)).alias("name")))
    # a lambda has no shared subexpressions, so each step is bound by one of its own
    spaced = F.transform(with_name, lambda n: F.struct(n["a"].alias("a"), n["name"].alias("name"), one_space(n["name"]).alias("text")))
    lowered = F.transform(spaced, lambda n: F.struct(n["a"].alias("a"), n["name"].alias("name"), n["text"].alias("text"), F.lower(n["text"]).alias("lowered")))
    with_issue = F.transform(lowered, lambda n: F.struct(n["a"].alias("a"), n["name"].alias("name"), text_issue(n["text"], n["lowered"]).alias("issue")))
    return F.filter(with_issue, lambda n: n["issue"].isNull())


def rimi_judged(lines: Column) -> Column:
    return _judged(lines, lambda line: line.rlike(RIMI_LINE), lambda l: ~l["item"] & ~_has_any(l["lowered"], RIMI_STOP))  # noqa: E741


def _rimi_items(judged: Column) -> Column:
    def name(a):
        one = F.coalesce(a["p1"]["usable"], F.lit(False))
        two = one & F.coalesce(a["p2"]["usable"], F.lit(False))
        three = two & F.coalesce(a["p3"]["usable"], F.lit(False))
        return F.concat_ws(" ", F.when(three, a["p3"]["line"]), F.when(two, a["p2"]["line"]), F.when(one, a["p1"]["line"]))

    def price(a, parts):
        quantity = _money(F.get(parts, 0), "decimal(18,4)")
        unit = _money(F.get(parts, 2), "decimal(14,2)")
        paid = F.coalesce(_money(F.get(parts, 3)), F.round(quantity * unit, 2).cast("decimal(14,2)"))
        found = F.lit(None).cast("decimal(14,2)")
        for k in (3, 2, 1):  # a discount line leads to the next one, a final price ends the search
            text = F.lower(a[f"n{k}"]["line"])
            final = F.contains(text, F.lit("gala cena"))
            last = _money(F.regexp_extract(a[f"n{k}"]["line"], UNICODE + r"(\d+,\d{2})\s*$", 1))
            follows = ~a[f"n{k}"]["item"] & (F.startswith(text, F.lit("atl")) | final)
            found = F.when(F.coalesce(follows, F.lit(False)), F.when(final & last.isNotNull(), last).otherwise(found))
        return F.coalesce(found, paid)

    # the groups of the first match, found once; none of them can hold the mark between them
    parted = F.transform(_named(_neighbours(judged), name), lambda n: F.struct(n.alias("n"), F.split(
        F.regexp_replace(n["a"]["line"], RIMI_FIRST, "$1\u0001$2\u0001$3\u0001$4"), "\u0001").alias("parts")))
    return F.transform(parted, lambda p: F.struct(
        p["n"]["a"]["i"].cast("bigint").alias("line_no"), p["n"]["name"].alias("name"),
        _money(F.get(p["parts"], 0), "decimal(18,4)").alias("quantity"),
        F.lower(F.get(p["parts"], 1)).alias("quantity_unit"),
        _money(F.get(p["parts"], 2), "decimal(18,4)").alias("unit_price"),
        price(p["n"]["a"], p["parts"]).alias("price"))).cast(ITEM)


def maxima_judged(lines: Column) -> Column:
    return _judged(lines, lambda line: line.rlike(MAXIMA_LINE), lambda l: ~_has_any(l["lowered"], MAXIMA_STOP) & ~(  # noqa: E741
        l["item"] | l["line"].rlike(MAXIMA_PRICE)))


def _maxima_items(judged: Column) -> Column:
    def name(a):
        one = F.coalesce(a["p1"]["usable"], F.lit(False))
        two = one & (F.length(a["p1"]["line"]) <= 20) & F.coalesce(a["p2"]["usable"], F.lit(False))
        return F.concat_ws(" ", F.when(two, a["p2"]["line"]), F.when(one, a["p1"]["line"]))

    def price(a):
        reduced = [F.when(F.contains(F.lower(a[f"n{k}"]["line"]), F.lit("cena ar atlaidi")), _money(F.regexp_extract(a[f"n{k}"]["line"], MONEY_TEXT, 0)))
                   for k in (1, 2)]
        return F.coalesce(*reduced, _money(F.regexp_extract(a["line"], UNICODE + r"(\d+,\d{2})\s+[A-Z]?$", 1)))

    return F.transform(_named(_neighbours(judged), name), lambda n: F.struct(
        n["a"]["i"].cast("bigint").alias("line_no"), n["name"].alias("name"),
        F.coalesce(_money(F.regexp_extract(n["a"]["line"], UNICODE + r"X\s+([\d,]+)", 1), "decimal(18,4)"), F.lit(1).cast("decimal(18,4)")).alias("quantity"),
        F.when(n["a"]["line"].rlike(UNICODE_FOLD + r"X\s+[\d,]+\s+(?:gab|gb)\.?\b"), "piece").otherwise("unknown").alias("quantity_unit"),
        _money(F.regexp_extract(n["a"]["line"], UNICODE + r"(\d+,\d{2})\s+X\s+", 1), "decimal(18,4)").alias("unit_price"),
        price(n["a"]).alias("price"))).cast(ITEM)


def iso_text(value: Column) -> Column:
    return F.regexp_replace(value, r"^(\d{2})\.(\d{2})\.(\d{4})$", "$3-$2-$1")


def parse_documents(documents: DataFrame) -> DataFrame:
    """Add store, date, total, lines (array) and status to documents with text."""
    keep = [c for c in documents.columns if c != "text"]
    strip = lambda line: F.regexp_replace(line, UNICODE + r"^\s+|\s+$", "")
    df = documents.withColumn("_raw", F.filter(F.transform(
        F.split(repair_text(F.coalesce("text", F.lit(""))), r"\R|[\x{1c}-\x{1e}]"), strip), lambda line: line != ""))
    df = df.withColumns({
        "_rimi": F.exists("_raw", lambda line: F.contains(F.lower(line), F.lit("rimi"))),
        "_header": F.exists("_raw", lambda line: line.rlike(RIMI_HEADER)),
        "_lines": F.transform("_raw", lambda line: F.when(is_metadata_line(line), "").otherwise(line))})
    lines, back = F.col("_lines"), F.reverse("_lines")
    df = df.withColumn("_judged", F.when(F.col("_rimi"), rimi_judged(lines)))
    df = df.withColumn("_a", _rimi_items(F.col("_judged")))
    df = df.withColumn("_layout_a", F.col("_rimi") & (F.col("_header") | (F.size("_a") > 0)))
    df = df.withColumn("_judged", F.when(~F.col("_layout_a"), maxima_judged(lines)))
    timed = _first(lines, lambda line: F.contains(F.lower(line), F.lit("laiks")) & line.rlike(DATE_DASHED))
    dated = F.regexp_extract(_first(lines, lambda line: line.rlike(DATE_ANY)), DATE_ANY, 0)
    rimi_date = F.coalesce(F.regexp_replace(F.nullif(F.regexp_extract(timed, DATE_DASHED, 0), F.lit("")), r"\.", "-"),
                           F.when(F.contains(dated, F.lit(".")), iso_text(dated)).otherwise(F.nullif(dated, F.lit(""))))
    rimi_total = _first(back, lambda line: F.lower(line).rlike("kopa|kopā") & line.rlike(MONEY_TEXT))
    maxima_day = UNICODE + r"\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}"
    maxima_date = F.nullif(F.regexp_extract(_first(lines, lambda line: line.rlike(maxima_day)), maxima_day, 0), F.lit(""))
    maxima_total = _first(back, lambda line: F.contains(F.lower(line), F.lit("kopā apmaksai")) & line.rlike(MONEY_TEXT))
    total = F.when(F.col("_layout_a"), rimi_total).otherwise(maxima_total)
    df = df.withColumns({
        "_items": F.when(F.col("_layout_a"), F.col("_a")).otherwise(_maxima_items(F.col("_judged"))),
        "_date": F.when(F.col("_layout_a"), rimi_date).otherwise(iso_text(maxima_date)),
        "_total": _money(F.regexp_extract(total, MONEY_TEXT, 0))})
    paid = F.aggregate("_items", F.lit(0).cast("decimal(20,2)"), lambda s, i: (s + F.coalesce(i["price"], F.lit(0).cast("decimal(14,2)"))).cast("decimal(20,2)"))
    status = F.when(F.size("_raw") == 0, "empty_text").when(F.size("_items") == 0, "no_items").otherwise("ok")
    record = F.struct(
        F.when(F.col("_layout_a"), "RIMI").otherwise("MAXIMA").alias("store"), F.col("_date").alias("date"),
        F.when(F.coalesce("_total", F.lit(0)) == 0, paid).otherwise(F.col("_total")).cast("decimal(14,2)").alias("total"),
        F.col("_total").alias("stated_total"), F.col("_items").alias("items"), status.alias("status"))
    return df.select(*keep, settled(record).alias("d")).select(*keep, "d.*")


def parsed_receipts(parsed: DataFrame) -> DataFrame:
    return parsed.where("status = 'ok'").select("receipt_number", "date", "store", "total")


def parsed_documents(parsed: DataFrame) -> DataFrame:
    """Readable documents with their lines, as ingest takes them."""
    return parsed.where("status = 'ok'").select("receipt_number", "date", "store", "total", "items")


def parsed_items(parsed: DataFrame) -> DataFrame:
    return parsed.where("status = 'ok'").select("receipt_number", F.explode("items").alias("i")).select("receipt_number", "i.*")


def rejected_documents(parsed: DataFrame) -> DataFrame:
    return parsed.where("status != 'ok'").select("receipt_number", "status")
