"""SQL counterparts of the registered queries, written against the raw driver tables.

They do not repeat the method of the Spark jobs: package sizes come from the part columns
rather than from the name, trailing medians from a self-join, and so on.
"""

from __future__ import annotations

from tillroll import vocabulary as V

U = V.UNRESOLVED
CANON = ", ".join(f"'{c}'" for c in V.CANONICAL_CATEGORIES)
LEGACY = ", ".join(f"'{c}'" for c in V.LEGACY_CATEGORIES)
AS_OF = "DATE '1998-06-14'"

RECEIPTS = """receipts AS (
  SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS date, CAST(o_orderdate AS DATE) AS d,
         strftime(o_orderdate, '%Y-%m') AS month, c_mktsegment AS store,
         CAST(o_totalprice AS DECIMAL(14,2)) AS total, 'R-' || o_orderkey AS receipt_number
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

WORDS = [("Brand#5", "maize", V.BAKERY), ("Brand#6", "piens", V.DAIRY), ("Brand#12", "banan", V.PRODUCE), ("Brand#13", "olas", V.EGGS),
         ("Brand#14", "lasis", V.FISH), ("Brand#15", "beer", V.ALCOHOL), ("Brand#16", "kakao", V.SOFT_DRINKS), ("Brand#17", "frozen", V.FROZEN),
         ("Brand#18", "burger", V.READY_MEALS), ("Brand#19", "desa", V.MEAT), ("Brand#20", "rieksti", V.SNACKS), ("Brand#21", "milti", V.GROCERY),
         ("Brand#22", "ketchup", V.SAUCES), ("Brand#23", "ziepes", V.HOUSEHOLD), ("Brand#24", "whiskas", V.PETS)]
PARTS = f"""parts AS (
  SELECT p_partkey, p_brand, p_type, p_size, p_brand || ' ' || p_name || CASE p_brand {" ".join(f"WHEN '{b}' THEN ' {w}'" for b, w, _ in WORDS)} ELSE '' END AS base,
    CASE p_brand {" ".join(f"WHEN '{b}' THEN '{c}'" for b, _, c in WORDS)} ELSE '{U}' END AS predicted,
    CASE p_type WHEN 'LARGE' THEN base || ' ' || p_size || '00ml'
      WHEN 'SMALL' THEN CASE WHEN p_brand = 'Brand#3' THEN base ELSE base || ' loose' END
      WHEN 'PROMO' THEN base || ' 2x' || p_size || '0g' ELSE base || ' ' || p_size || '00g' END AS name,
    CASE WHEN p_type = 'SMALL' THEN NULL
      WHEN p_type = 'LARGE' THEN CASE WHEN p_brand = 'Brand#2' THEN base ELSE base || ' drink' END
      WHEN p_type = 'MEDIUM' AND p_brand = 'Brand#1' THEN NULL ELSE base END AS canonical_name,
    CASE p_type WHEN 'ECONOMY' THEN '{V.GROCERY}' WHEN 'STANDARD' THEN 'напитки' WHEN 'MEDIUM' THEN '{V.DAIRY}'
      WHEN 'LARGE' THEN '{V.SOFT_DRINKS}' WHEN 'SMALL' THEN '{U}'
      ELSE CASE p_brand WHEN 'Brand#5' THEN '' WHEN 'Brand#6' THEN NULL ELSE 'promo' END END AS category,
    coalesce(canonical_name, name) AS identity,
    CASE WHEN p_brand <> 'Brand#9' THEN lower(replace(name, '#', ' ')) END AS normalized_name,
    lower(replace(identity, '#', ' ')) AS product_key
  FROM part)"""

ITEMS = f"""lines AS (
  SELECT l_linenumber * 281474976710656 + CAST('0x' || substr(md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey,
      CAST(l_quantity AS DECIMAL(14,2)), CAST(l_extendedprice AS DECIMAL(14,2)), strftime(l_shipdate, '%Y%m%d'))), 1, 12) AS BIGINT) AS id,
    l_orderkey AS receipt_id, parts.*, CAST(l_quantity AS BIGINT) AS q, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
    CAST(l_extendedprice AS DECIMAL(14,2)) AS price, l_returnflag AS flag, l_returnflag = 'R' AS old, l_linestatus AS status,
    p_size * 100 AS g, (2 * cents + q) // (2 * q) AS listed,
    l_returnflag = 'A' AND abs(q * listed - cents) > 2 AS off
  FROM lineitem JOIN parts ON l_partkey = p_partkey),
items AS MATERIALIZED (
  SELECT *,
    CASE WHEN old THEN NULL ELSE price END AS line_total,
    CASE WHEN old THEN NULL ELSE (cents * 200 + q) // (2 * q) END AS unit_e4,
    CASE WHEN old OR p_type = 'PROMO' THEN NULL WHEN p_type = 'SMALL' THEN (cents * 200 + q) // (2 * q)
      ELSE (2 * cents * 100000 + q * g) // (2 * q * g) END AS price_e4,
    CASE WHEN old THEN CASE WHEN status = 'O' THEN 'unknown' END
      WHEN flag = 'A' AND p_type = 'PROMO' THEN 'unknown' ELSE 'piece' END AS quantity_unit,
    CASE WHEN old OR p_type IN ('PROMO', 'SMALL') THEN NULL ELSE g END AS package_size,
    CASE WHEN old THEN NULL WHEN p_type IN ('PROMO', 'SMALL') THEN 'unknown' WHEN p_type = 'LARGE' THEN 'ml' ELSE 'g' END AS package_unit,
    CASE WHEN old THEN CASE WHEN status = 'O' THEN 'unknown' END WHEN p_type = 'PROMO' THEN 'unknown'
      WHEN p_type = 'SMALL' THEN 'eur_per_piece' WHEN p_type = 'LARGE' THEN 'eur_per_l' ELSE 'eur_per_kg' END AS price_unit,
    CASE WHEN old THEN NULL WHEN p_type = 'PROMO' THEN 'rejected' WHEN flag = 'N' THEN 'parser'
      WHEN p_type = 'SMALL' THEN 'inferred_piece' ELSE 'package_name' END AS price_source,
    CASE WHEN old OR p_type = 'PROMO' THEN NULL WHEN flag = 'N' THEN 0.95
      WHEN off OR p_type = 'SMALL' THEN 0.70 ELSE 0.85 END AS confidence,
    CASE flag WHEN 'N' THEN 'rule' WHEN 'A' THEN 'manual' ELSE 'fallback' END AS category_source,
    CASE WHEN category IS NULL OR trim(category) = '' OR lower(category) IN ({LEGACY}) THEN '{U}' ELSE lower(category) END AS label
  FROM lines)"""

RULES = f"""rules AS (
  SELECT DISTINCT product_key, CASE p_brand WHEN 'Brand#7' THEN '{V.SNACKS}' ELSE 'напитки' END AS category
  FROM parts WHERE p_brand IN ('Brand#7', 'Brand#8'))"""

OBS = """obs AS MATERIALIZED (
  SELECT items.*, receipts.date, receipts.d, receipts.month, receipts.store,
    CASE WHEN price_e4 IS NULL THEN 'missing_normalized_price' WHEN price_e4 > 100000000 THEN 'normalized_price_out_of_range'
      WHEN confidence < 0.75 THEN 'low_confidence' END AS reason,
    coalesce(confidence < 0.75, TRUE) OR coalesce(price_e4 > 100000000 OR price_e4 <= 0, FALSE) AS review
  FROM items JOIN receipts ON items.receipt_id = receipts.id)"""

MIXED = """mixed AS (
  SELECT identity FROM obs GROUP BY identity HAVING bool_or(canonical_name IS NULL) AND bool_or(canonical_name IS NOT NULL))"""

ELIGIBLE = "eligible AS (SELECT * FROM obs WHERE reason IS NULL)"

DEVIATION = """history AS (
  SELECT c.receipt_id, c.id, any_value(c.identity) AS identity, any_value(c.price_unit) AS unit, any_value(c.price_e4) AS p,
    count(h.price_e4) AS n, CAST(2 * median(h.price_e4) AS BIGINT) AS m2, min(h.price_e4) AS lo, max(h.price_e4) AS hi
  FROM eligible c LEFT JOIN eligible h ON h.identity = c.identity AND h.price_unit = c.price_unit
    AND h.d >= c.d - 180 AND (h.d < c.d OR (h.d = c.d AND (h.receipt_id, h.id) < (c.receipt_id, c.id)))
  WHERE c.identity NOT IN (SELECT identity FROM mixed)
  GROUP BY c.receipt_id, c.id),
deviation AS MATERIALIZED (
  SELECT identity, receipt_id, id, unit, p,
    CASE WHEN n < 3 THEN 'INSUFFICIENT_HISTORY' WHEN (2 * p - m2) * 100 <= -10 * m2 THEN 'CHEAPER_THAN_USUAL'
      WHEN (2 * p - m2) * 100 >= 15 * m2 THEN 'MORE_EXPENSIVE_THAN_USUAL' ELSE 'NORMAL' END AS status,
    CASE WHEN n < 3 THEN 'insufficient_prior_history' END AS reason,
    CASE WHEN n >= 3 THEN m2 END AS m2, CASE WHEN n >= 3 THEN lo END AS lo, CASE WHEN n >= 3 THEN hi END AS hi, n,
    CASE WHEN n >= 3 THEN sign(2 * p - m2) * ((abs(2 * p - m2) * 2000 + m2) // (2 * m2)) / 10.0 END AS change
  FROM history
  UNION ALL
  SELECT identity, receipt_id, id, price_unit, price_e4, 'INSUFFICIENT_HISTORY',
    CASE WHEN identity IN (SELECT identity FROM mixed) THEN 'unresolved_product_identity' ELSE reason END,
    NULL, NULL, NULL, 0, NULL
  FROM obs WHERE reason IS NOT NULL OR identity IN (SELECT identity FROM mixed))"""


def with_views(body: str, *views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n" + body


ITEM_VIEWS = (PARTS, ITEMS)
OBS_VIEWS = (RECEIPTS, PARTS, ITEMS, OBS)
PRICE_VIEWS = (*OBS_VIEWS, MIXED, ELIGIBLE)

SQL: dict[str, str] = {}


def add(name: str, body: str, *views: str) -> None:
    SQL[name] = with_views(body, *views) if views else body


def statements() -> dict[str, str]:
    return dict(SQL)


def two(expression: str) -> str:
    return f"CAST({expression} AS DOUBLE)"


# --- spend --------------------------------------------------------------------------------
add("monthly_spend", f"SELECT month, {two('sum(price)')} AS spend FROM obs GROUP BY month", *OBS_VIEWS)
add("category_spend", f"SELECT label AS category, {two('sum(price)')} AS spend FROM obs GROUP BY label", *OBS_VIEWS)
add("top_products", f"""SELECT identity, {two('s')} AS spend FROM (SELECT identity, sum(price) AS s FROM obs GROUP BY identity)
  ORDER BY s DESC, identity LIMIT 10""", *OBS_VIEWS)
add("spend_totals", f"""SELECT {two('sum(s)')} AS total_spent, (SELECT count(DISTINCT receipt_id) FROM obs) AS receipt_count,
  count(*) AS month_count, CAST((2 * sum(s) * 100 + count(*)) // (2 * count(*)) AS DOUBLE) / 100 AS monthly_average
  FROM (SELECT month, sum(price) AS s FROM obs GROUP BY month)""", *OBS_VIEWS)
SQL["spend_totals"] = SQL["spend_totals"].replace("(2 * sum(s) * 100 + count(*)) //", "(2 * CAST(sum(s) * 100 AS HUGEINT) + count(*)) //")
add("total_spent", f"SELECT {two('sum(total)')} AS total_spent FROM receipts", RECEIPTS)
add("filtered_category_spend", f"""SELECT label AS category, {two('sum(price)')} AS spend FROM obs
  WHERE d BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AND store = 'BUILDING' AND (identity LIKE '%gear%' OR name LIKE '%gear%')
  GROUP BY label""", *OBS_VIEWS)
add("unresolved_monthly_spend", f"""SELECT month, {two('sum(price)')} AS spend FROM obs
  WHERE coalesce(category, '') NOT IN ({CANON}) OR category = '{U}' GROUP BY month""", *OBS_VIEWS)
add("insight_lines", f"""SELECT CAST(1 AS BIGINT) AS line_no, 'coverage' AS type, CAST(NULL AS VARCHAR) AS month, CAST(NULL AS VARCHAR) AS subject,
    CAST(r AS DOUBLE) AS amount, CAST(NULL AS DOUBLE) AS percent, n FROM tot
  UNION ALL SELECT 2, 'month_change', month, CASE WHEN abs(pct) < 0.05 THEN 'unchanged' WHEN pct > 0 THEN 'increased' ELSE 'decreased' END, NULL, abs(pct), NULL
    FROM (SELECT month, sign(s - p) * ((2000 * abs(s - p) + p) // (2 * p)) / 10.0 AS pct FROM (
      SELECT month, CAST(s * 100 AS HUGEINT) AS s, CAST(lag(s) OVER (ORDER BY month) * 100 AS HUGEINT) AS p FROM mon) ORDER BY month DESC LIMIT 1)
  UNION ALL SELECT 3, 'largest_category', NULL, label, {two('s')}, ((2000 * CAST(s * 100 AS HUGEINT) + CAST(t * 100 AS HUGEINT)) // (2 * CAST(t * 100 AS HUGEINT))) / 10.0, NULL
    FROM (SELECT label, s, (SELECT t FROM tot) AS t FROM cat ORDER BY s DESC, label LIMIT 1)""",
    *OBS_VIEWS, "mon AS (SELECT month, sum(price) AS s FROM obs GROUP BY month)",
    "cat AS (SELECT label, sum(price) AS s FROM obs GROUP BY label)",
    "tot AS (SELECT (SELECT count(DISTINCT receipt_id) FROM obs) AS r, count(*) AS n, sum(s) AS t FROM mon)")
add("report_monthly_receipts", f"SELECT month, {two('sum(total)')} AS spend_eur FROM receipts GROUP BY month", RECEIPTS)
add("report_category_spend", f"SELECT category, {two('sum(price)')} AS spend_eur FROM items GROUP BY category", *ITEM_VIEWS)
add("report_average_price_by_store", """SELECT identity AS product, store, price_unit AS normalized_price_unit, count(*) AS observations,
    CAST((2 * sum(price_e4) + count(*)) // (2 * count(*)) AS DOUBLE) / 10000 AS average_price
  FROM obs WHERE price_e4 > 0 GROUP BY identity, store, price_unit""", *OBS_VIEWS)
add("report_price_history", """SELECT date, identity AS product, store, price_e4 / 10000.0 AS normalized_unit_price, price_unit AS normalized_price_unit
  FROM obs WHERE price_e4 > 0""", *OBS_VIEWS)
add("report_recurring_products", """SELECT identity AS product, count(DISTINCT receipt_id) AS receipts FROM items
  GROUP BY identity HAVING count(DISTINCT receipt_id) > 1""", *ITEM_VIEWS)
add("report_evidence_distribution", """SELECT coalesce(price_source, 'missing') AS source, CAST(confidence AS DOUBLE) AS confidence, count(*) AS items
  FROM items GROUP BY ALL""", *ITEM_VIEWS)

# --- periods ------------------------------------------------------------------------------
NOW = "d >= DATE '1998-06-01' AND d < DATE '1998-06-15'"
BEFORE = "d >= DATE '1998-05-01' AND d < DATE '1998-05-15'"
MAY = "d >= DATE '1998-05-01' AND d < DATE '1998-06-01'"
TENTH = "sign({a}) * ((2000 * abs({a}) + {b}) // (2 * {b})) / 10.0"
add("period_summary", f"""SELECT s / 100.0 AS spend, receipt_count, p / 100.0 AS previous_spend, previous_receipt_count, (s - p) / 100.0 AS absolute_delta,
    CASE WHEN p <> 0 THEN {TENTH.format(a='(s - p)', b='p')} END AS percentage_delta,
    CASE WHEN receipt_count >= 3 THEN ((2 * s * 30 + 14) // 28) / 100.0 END AS forecast
  FROM (SELECT CAST(coalesce(sum(total) FILTER ({NOW}), 0) * 100 AS BIGINT) AS s, count(*) FILTER ({NOW}) AS receipt_count,
    CAST(coalesce(sum(total) FILTER ({BEFORE}), 0) * 100 AS BIGINT) AS p, count(*) FILTER ({BEFORE}) AS previous_receipt_count FROM receipts)""", RECEIPTS)
for key, start, end, earlier in (("previous_month", "1998-05-01", "1998-06-01", "1998-04-01"), ("last_30_days", "1998-05-16", "1998-06-15", "1998-04-16")):
    now, before = f"d >= DATE '{start}' AND d < DATE '{end}'", f"d >= DATE '{earlier}' AND d < DATE '{start}'"
    add(f"period_summary_{key}", f"""SELECT s / 100.0 AS spend, n AS receipt_count, p / 100.0 AS previous_spend, m AS previous_receipt_count, (s - p) / 100.0 AS absolute_delta,
    CASE WHEN p <> 0 THEN {TENTH.format(a='(s - p)', b='p')} END AS percentage_delta, CAST(NULL AS DOUBLE) AS forecast
  FROM (SELECT CAST(coalesce(sum(total) FILTER ({now}), 0) * 100 AS BIGINT) AS s, count(*) FILTER ({now}) AS n,
    CAST(coalesce(sum(total) FILTER ({before}), 0) * 100 AS BIGINT) AS p, count(*) FILTER ({before}) AS m FROM receipts)""", RECEIPTS)
add("story_month", """SELECT requested, CASE WHEN requested IN (SELECT month FROM receipts) THEN requested ELSE '1998-05' END AS month,
    CASE WHEN requested IN (SELECT month FROM receipts) THEN requested ELSE (SELECT max(month) FROM receipts) END AS month_of_later_day
  FROM (SELECT DISTINCT strftime(l_shipdate, '%Y-%m') AS requested FROM lineitem)""", RECEIPTS)
add("category_changes", f"""SELECT label AS category, c / 100.0 AS current, p / 100.0 AS previous, (c - p) / 100.0 AS delta,
    CASE WHEN m > 0 THEN ((2000 * abs(c - p) + m) // (2 * m)) / 10.0 ELSE 0.0 END AS magnitude_percent
  FROM (SELECT *, max(abs(c - p)) OVER () AS m FROM (
    SELECT label, CAST(coalesce(sum(price) FILTER ({NOW}), 0) * 100 AS BIGINT) AS c, CAST(coalesce(sum(price) FILTER ({BEFORE}), 0) * 100 AS BIGINT) AS p
    FROM obs WHERE ({NOW}) OR ({BEFORE}) GROUP BY label))
  ORDER BY abs(c - p) DESC, c DESC, label LIMIT 5""", *OBS_VIEWS)
add("daily_trend", f"""SELECT strftime(day, '%Y-%m-%d') AS date, CAST(coalesce(sum(total), 0) AS DOUBLE) AS spend
  FROM generate_series(DATE '1998-05-01', DATE '1998-05-31', INTERVAL 1 DAY) t(day) LEFT JOIN receipts ON d = CAST(day AS DATE) GROUP BY day""", RECEIPTS)
add("monthly_trend", f"SELECT month, {two('sum(total)')} AS spend FROM receipts WHERE d <= {AS_OF} GROUP BY month", RECEIPTS)
add("months_available", "SELECT month, count(*) AS receipt_count FROM receipts GROUP BY month", RECEIPTS)
REGISTER = """SELECT r.id AS receipt_id, receipt_number, r.date, r.store, CAST(total AS DOUBLE) AS total, count(obs.id) AS item_count,
    count(*) FILTER (review) AS price_warning_count
  FROM receipts r LEFT JOIN obs ON obs.receipt_id = r.id WHERE {where} GROUP BY ALL"""
add("receipt_register", REGISTER.format(where=f"r.{MAY.replace('AND d', 'AND r.d')} AND lower(r.store) LIKE '%build%'"), *OBS_VIEWS)
add("register_totals", f"""SELECT {two('sum(total)')} AS total, CAST(sum(n) AS BIGINT) AS item_count, count(*) AS receipt_count
  FROM receipts LEFT JOIN (SELECT receipt_id, count(*) AS n FROM obs GROUP BY receipt_id) ON receipt_id = id WHERE d <= {AS_OF}""", *OBS_VIEWS)
add("register_by_total", f"SELECT * FROM ({REGISTER.format(where='r.' + MAY.replace('AND d', 'AND r.d'))}) ORDER BY total DESC, receipt_id LIMIT 40", *OBS_VIEWS)
add("receipt_previews", f"""SELECT receipt_id, line_no, name, CAST(q AS DOUBLE) AS quantity, CAST(price AS DOUBLE) AS price, label AS category,
    category_source, review AS has_price_warning
  FROM (SELECT *, row_number() OVER (PARTITION BY receipt_id ORDER BY id) AS line_no FROM obs WHERE {MAY}) WHERE line_no <= 2""", *OBS_VIEWS)
add("recent_receipts", REGISTER.format(where=f"r.{NOW.replace('AND d', 'AND r.d')}") + " ORDER BY r.date DESC, r.id DESC LIMIT 5", *OBS_VIEWS)
add("receipt_lines", f"""SELECT receipt_id, CAST(id AS VARCHAR) AS line_id, name, CAST(price AS DOUBLE) AS paid,
    CASE WHEN quantity_unit = 'piece' AND unit_e4 IS NOT NULL THEN q || ' шт. · ' || replace(CAST(CAST(((unit_e4 + 50) // 100) AS DECIMAL(18,2)) / 100 AS DECIMAL(18,2))::VARCHAR, '.', ',') || ' €/шт. · ' ELSE '' END
      || 'итого ' || replace(CAST(price AS VARCHAR), '.', ',') || ' €' AS price_text,
    label AS category, CASE WHEN trim(category) <> '' AND category NOT IN ({CANON}) THEN category END AS legacy_category,
    CASE category_source WHEN 'rule' THEN 'По правилу' WHEN 'manual' THEN 'Ручная' ELSE 'Требует решения' END AS category_source,
    coalesce(confidence < 0.75, TRUE) OR coalesce(price_e4 > 100000000, FALSE) AS needs_review FROM items""", *ITEM_VIEWS)
add("month_summary", f"""SELECT '1998-06' AS month, s / 100.0 AS spend, receipt_count, item_line_count, latest_receipt_date, reasons, reasons = '' AS eligible,
    CASE WHEN reasons = '' THEN ((2 * s * 30 + 14) // 28) / 100.0 END AS forecast
  FROM (SELECT *, concat_ws(',', CASE WHEN receipt_count < 3 THEN 'less_than_3_receipts' END, CASE WHEN item_line_count < 10 THEN 'less_than_10_item_lines' END,
      CASE WHEN latest_receipt_date IS NULL THEN 'no_current_month_receipts' WHEN date_diff('day', CAST(latest_receipt_date AS DATE), {AS_OF}) > 3 THEN 'latest_receipt_older_than_3_days' END) AS reasons
    FROM (SELECT CAST(coalesce(sum(total), 0) * 100 AS BIGINT) AS s, count(*) AS receipt_count,
      (SELECT count(*) FROM obs WHERE {NOW}) AS item_line_count, max(date) AS latest_receipt_date FROM receipts WHERE {NOW}))""", *OBS_VIEWS)
add("selected_month_summary", f"""SELECT '1998-05' AS month, CAST(coalesce(sum(total), 0) AS DOUBLE) AS spend, count(*) AS receipt_count,
    (SELECT count(*) FROM obs WHERE {MAY}) AS item_line_count, max(date) AS latest_receipt_date, 'completed_month' AS reasons, FALSE AS eligible,
    CAST(NULL AS DOUBLE) AS forecast FROM receipts WHERE {MAY}""", *OBS_VIEWS)
add("top_month_products", f"""SELECT t.identity, CAST(s AS DOUBLE) AS spend, purchase_count, ((l.price_e4 + 50) // 100) / 100.0 AS latest_price, l.price_unit,
    sign(l.price_e4 - b.price_e4) * ((2000 * abs(l.price_e4 - b.price_e4) + b.price_e4) // (2 * b.price_e4)) / 10.0 AS change_percent
  FROM top t LEFT JOIN latest l ON l.identity = t.identity LEFT JOIN LATERAL (
    SELECT price_e4 FROM priced p WHERE p.identity = l.identity AND p.price_unit = l.price_unit AND (p.d, p.receipt_id, p.id) < (l.d, l.receipt_id, l.id)
    ORDER BY p.d DESC, p.receipt_id DESC, p.id DESC LIMIT 1) b ON TRUE""", *OBS_VIEWS,
    f"""top AS (SELECT identity, sum(price) AS s, count(*) AS purchase_count FROM obs WHERE {MAY} GROUP BY identity
      ORDER BY s DESC, purchase_count DESC, lower(identity), identity LIMIT 3)""",
    "priced AS (SELECT * FROM obs WHERE price_e4 > 0 AND d < DATE '1998-06-01')",
    """latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY d DESC, receipt_id DESC, id DESC) AS rn
      FROM priced WHERE d >= DATE '1998-05-01') WHERE rn = 1)""")

add("month_price_context", SQL["top_month_products"].replace("ORDER BY s DESC, purchase_count DESC, lower(identity), identity LIMIT 3", ""))
add("previous_prices", f"""SELECT identity, price_unit AS normalized_price_unit, receipt_id, CAST(id AS VARCHAR) AS line_id, price_e4 / 10000.0 AS price,
    before / 10000.0 AS price_before, date_before, sign(price_e4 - before) * ((2000 * abs(price_e4 - before) + before) // (2 * before)) / 10.0 AS change_percent
  FROM (SELECT *, lag(price_e4) OVER line AS before, lag(date) OVER line AS date_before FROM obs WHERE price_e4 > 0
    WINDOW line AS (PARTITION BY identity, price_unit ORDER BY d, receipt_id, id))""", *OBS_VIEWS)
add("comparable_units", """SELECT coalesce(price_unit, '') AS this_unit, coalesce(u, '') AS other_unit, coalesce(price_unit = u AND (price_unit IN ('eur_per_l', 'eur_per_kg')
      OR price_unit = 'eur_per_piece' AND (product_key = k OR coalesce(canonical_name = c, FALSE))), FALSE) AS comparable, count(*) AS lines
  FROM (SELECT *, lag(id) OVER line AS i, lag(price_unit) OVER line AS u, lag(product_key) OVER line AS k, lag(canonical_name) OVER line AS c FROM items
    WINDOW line AS (PARTITION BY receipt_id ORDER BY id)) WHERE i IS NOT NULL GROUP BY ALL""", *ITEM_VIEWS)

# --- price evidence -----------------------------------------------------------------------
add("price_evidence", """SELECT receipt_id, CAST(id AS VARCHAR) AS line_id, name, normalized_name, CAST(q AS DOUBLE) AS quantity, CAST(price AS DOUBLE) AS price,
    CAST(line_total AS DOUBLE) AS line_total, unit_e4 / 10000.0 AS unit_price, CAST(package_size AS DOUBLE) AS package_size,
    price_e4 / 10000.0 AS normalized_unit_price, CAST(confidence AS DOUBLE) AS price_parse_confidence, quantity_unit, package_unit,
    price_unit AS normalized_price_unit, price_source AS price_parse_source FROM items""", *ITEM_VIEWS)
add("price_quality", """SELECT count(*) AS lines, count(line_total) AS with_line_total, count(unit_e4) AS with_unit_price, count(price_e4) AS with_normalized_price,
    count(*) FILTER (price_unit = 'eur_per_l') AS per_litre, count(*) FILTER (price_unit = 'eur_per_kg') AS per_kilogram,
    count(*) FILTER (price_unit = 'eur_per_piece') AS per_piece, count(*) FILTER (price_unit IS NULL OR price_unit = 'unknown') AS unit_unknown,
    count(*) FILTER (confidence < 0.75) AS stated_low_confidence, count(*) FILTER (confidence IS NULL OR confidence < 0.75) AS low_confidence,
    count(*) FILTER (price_e4 > 100000000 OR price_e4 <= 0) AS suspicious,
    count(*) FILTER (abs(q * unit_e4 - cents * 100) > 200) AS arithmetic_mismatch,
    count(*) FILTER (price_e4 IS NOT NULL AND price_unit <> 'unknown') AS comparable,
    ((2000 * count(*) FILTER (price_e4 IS NOT NULL) + count(*)) // (2 * count(*))) / 10.0 AS coverage_percent FROM items""", *ITEM_VIEWS)
CLASSIFIED = """CASE WHEN reason IS NULL THEN 'already_safe' WHEN old THEN 'line_total_needs_receipt'
    WHEN p_type = 'PROMO' THEN 'ambiguous_multipack' WHEN confidence > 0.85 THEN 'stronger_evidence_exists' END AS cr"""
CLASS = "CASE WHEN cr IS NULL THEN 'CORRECTABLE_V1' WHEN cr = 'already_safe' THEN 'ALREADY_SAFE' ELSE 'NOT_CORRECTABLE_V1' END AS classification"
add("issue_worklist", f"""SELECT date, receipt_id, CAST(id AS VARCHAR) AS line_id, name, store, CAST(q AS DOUBLE) AS quantity, CAST(price AS DOUBLE) AS paid,
    coalesce(abs(q * unit_e4 - cents * 100) > 200, FALSE) AS mismatch, {CLASS}, cr AS classification_reason
  FROM (SELECT *, {CLASSIFIED} FROM obs WHERE confidence IS NULL OR confidence < 0.75 ORDER BY date DESC, receipt_id DESC, id DESC LIMIT 100)""", *OBS_VIEWS)
SUSPICIOUS = "(price_e4 > 100000000 OR price_e4 <= 0)"
for issue, test in (("unknown", "quantity_unit IS NULL OR quantity_unit = 'unknown'"), ("missing_package", "quantity_unit = 'piece' AND package_size IS NULL"),
                    ("suspicious", SUSPICIOUS), ("all", f"""line_total IS NULL OR unit_e4 IS NULL OR price_unit IS NULL OR price_unit = 'unknown'
    OR confidence IS NULL OR confidence < 0.75 OR {SUSPICIOUS} OR abs(q * unit_e4 - cents * 100) > 200""")):
    add(f"issue_worklist_{issue}", f"""SELECT date, receipt_id, CAST(id AS VARCHAR) AS line_id, name, store, CAST(q AS DOUBLE) AS quantity, CAST(price AS DOUBLE) AS paid,
    coalesce(abs(q * unit_e4 - cents * 100) > 200, FALSE) AS mismatch, {CLASS}, cr AS classification_reason
  FROM (SELECT *, {CLASSIFIED} FROM obs WHERE {test} ORDER BY date DESC, receipt_id DESC, id DESC LIMIT 200)""", *OBS_VIEWS)
add("mismatched_lines", """SELECT receipt_id, CAST(id AS VARCHAR) AS line_id, abs(q * e4 - cents * 100) / 10000.0 AS difference
  FROM (SELECT *, unit_e4 + CASE WHEN q = 50 THEN 10000 ELSE 0 END AS e4 FROM items) WHERE abs(q * e4 - cents * 100) > 200""", *ITEM_VIEWS)
add("price_correctability", f"""SELECT {CLASS}, coalesce(cr, '') AS classification_reason, count(*) AS lines
  FROM (SELECT *, {CLASSIFIED} FROM obs) GROUP BY ALL""", *OBS_VIEWS)
add("price_eligibility", "SELECT coalesce(reason, 'eligible') AS reason, count(*) AS lines FROM obs GROUP BY ALL", *OBS_VIEWS)

# --- price history ------------------------------------------------------------------------
EVIDENCE = """CASE WHEN status = 'INSUFFICIENT_HISTORY' THEN CASE reason WHEN 'insufficient_prior_history' THEN 'NOT_ENOUGH_HISTORY'
    WHEN 'missing_normalized_price' THEN 'PRICE_NOT_COMPARABLE' WHEN 'unresolved_product_identity' THEN 'PRODUCT_IDENTITY_UNCERTAIN'
    ELSE 'EVIDENCE_NEEDS_REVIEW' END END"""
add("price_deviation", f"""SELECT identity, receipt_id, CAST(id AS VARCHAR) AS line_id, status, reason, unit AS normalized_price_unit, p / 10000.0 AS price,
    m2 / 20000.0 AS median_price, lo / 10000.0 AS min_price, hi / 10000.0 AS max_price, CAST(change AS DOUBLE) AS deviation_percent, n AS prior_count,
    CASE WHEN status = 'INSUFFICIENT_HISTORY' THEN 'INSUFFICIENT' ELSE 'SUFFICIENT' END AS evidence_strength, {EVIDENCE} AS evidence,
    CASE WHEN reason = 'insufficient_prior_history' THEN 3 - n END AS remaining FROM deviation""", *PRICE_VIEWS, DEVIATION)
add("receipt_price_summary", """SELECT receipt_id, count(*) AS total_items, count(*) FILTER (status = 'CHEAPER_THAN_USUAL') AS cheap,
    count(*) FILTER (status = 'MORE_EXPENSIVE_THAN_USUAL') AS expensive, count(*) FILTER (status = 'INSUFFICIENT_HISTORY') AS insufficient
  FROM deviation GROUP BY receipt_id""", *PRICE_VIEWS, DEVIATION)
add("price_evidence_summary", """SELECT status, coalesce(reason, '') AS reason, count(*) AS lines, CAST(sum(n) AS BIGINT) AS prior_prices
  FROM deviation GROUP BY ALL""", *PRICE_VIEWS, DEVIATION)
PRODUCT_REASON = """products AS (
  SELECT identity, CASE WHEN identity IN (SELECT identity FROM mixed) THEN 'unresolved_product_identity'
      WHEN count(DISTINCT price_unit) FILTER (reason IS NULL) > 1 THEN 'incompatible_price_units'
      WHEN count(*) FILTER (reason IS NULL) = 0 THEN 'no_comparable_history' END AS why,
    count(DISTINCT store) AS seen, count(DISTINCT store) FILTER (reason IS NULL) AS usable, min(price_unit) FILTER (reason IS NULL) AS unit
  FROM obs GROUP BY identity)"""
add("price_trend", """SELECT identity, CAST(NULL AS VARCHAR) AS reason, month, (CAST(2 * median(price_e4) AS BIGINT) + 1) // 2 / 10000.0 AS median_price,
    count(*) AS observation_count, price_unit AS normalized_price_unit
  FROM eligible WHERE identity IN (SELECT identity FROM products WHERE why IS NULL) GROUP BY identity, month, price_unit
  UNION ALL SELECT identity, why, NULL, NULL, 0, NULL FROM products WHERE why IS NOT NULL""", *PRICE_VIEWS, PRODUCT_REASON)
LEVELS = """levels AS (
  SELECT identity, price_unit, store, (CAST(2 * median(price_e4) AS BIGINT) + 1) // 2 AS m, min(price_e4) AS lo, max(price_e4) AS hi,
    count(*) AS n, max(date) AS latest_date,
    row_number() OVER (PARTITION BY identity, price_unit ORDER BY m, lower(store), store) AS position
  FROM eligible GROUP BY identity, price_unit, store)"""
add("store_levels", """SELECT identity, price_unit AS normalized_price_unit, store, position, n AS observation_count, latest_date,
    m / 10000.0 AS median_price, lo / 10000.0 AS min_price, hi / 10000.0 AS max_price FROM levels""", *PRICE_VIEWS, LEVELS)
add("store_comparison", f"""SELECT identity, reason, evidence_level, is_tie, CASE WHEN reason IS NULL THEN unit END AS normalized_price_unit,
    CASE WHEN reason IS NULL THEN usable ELSE 0 END AS store_count, CASE WHEN claim THEN sa END AS cheapest_store, CASE WHEN claim THEN sb END AS comparison_store,
    CASE WHEN claim THEN ((2000 * (mb - ma) + mb) // (2 * mb)) / 10.0 END AS difference_percent, claim AND evidence_level = 'COMPARABLE' AS strong_claim_allowed
  FROM (SELECT *, reason IS NULL AND evidence_level <> 'PRELIMINARY' AND NOT is_tie AS claim FROM (
    SELECT *, CASE WHEN reason IS NULL THEN CASE WHEN fewest >= 3 THEN 'COMPARABLE' WHEN fewest >= 2 THEN 'LIMITED' ELSE 'PRELIMINARY' END END AS evidence_level,
      reason IS NULL AND ma = mb AS is_tie
    FROM (SELECT p.identity, p.unit, p.usable, CASE WHEN why = 'no_comparable_history' OR why IS NULL THEN CASE WHEN usable < 2 THEN
        CASE WHEN seen <= 1 THEN 'only_one_store' ELSE 'insufficient_comparable_prices' END END ELSE why END AS reason,
        any_value(l.m) FILTER (position = 1) AS ma, any_value(l.m) FILTER (position = 2) AS mb,
        any_value(l.store) FILTER (position = 1) AS sa, any_value(l.store) FILTER (position = 2) AS sb, min(l.n) AS fewest
      FROM products p LEFT JOIN levels l ON l.identity = p.identity GROUP BY ALL)))""", *PRICE_VIEWS, PRODUCT_REASON, LEVELS)
add("product_dossier", """SELECT o.identity, any_value(x.lines) AS lines, any_value(CAST(x.s AS DOUBLE)) AS total_paid, any_value(x.receipts) AS receipts, any_value(x.aliases) AS aliases,
    any_value(x.stores) AS stores, any_value(o.date) AS latest_date, any_value(CAST(coalesce(o.line_total, o.price) AS DOUBLE)) AS latest_total,
    any_value(o.unit_e4 / 10000.0) AS latest_unit_price, any_value(o.price_e4 / 10000.0) AS latest_price, any_value(o.price_unit) AS latest_price_unit,
    any_value(o.price_source) AS latest_source
  FROM (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY d DESC, receipt_id DESC, id DESC) AS rn FROM obs) o
  JOIN (SELECT identity, count(*) AS lines, sum(price) AS s, count(DISTINCT receipt_id) AS receipts, count(DISTINCT name) AS aliases, count(DISTINCT store) AS stores
    FROM obs GROUP BY identity) x ON x.identity = o.identity WHERE rn = 1 GROUP BY o.identity""", *OBS_VIEWS)
add("dossier_stores", f"SELECT identity, store, count(*) AS lines, {two('sum(price)')} AS paid FROM obs GROUP BY ALL", *OBS_VIEWS)
add("dossier_aliases", "SELECT DISTINCT identity, name AS alias FROM obs", *OBS_VIEWS)

# --- categories ---------------------------------------------------------------------------
add("group_health", f"""SELECT count(*) FILTER (n > 1) AS conflicts, count(*) FILTER (u) AS unresolved, count(*) AS groups FROM (
  SELECT product_key, count(DISTINCT label) AS n, bool_or(label = '{U}') AS u FROM items GROUP BY product_key)""", *ITEM_VIEWS)
REVIEW = f"""groups AS (
  SELECT product_key, min(identity) AS display_name, count(*) AS item_count, count(DISTINCT receipt_id) AS receipt_count, count(DISTINCT name) AS alias_count,
    count(DISTINCT store) AS store_count, max(date) AS last_date, count(DISTINCT label) - 1 AS conflict_count,
    CASE WHEN count(DISTINCT label) = 1 THEN min(label) ELSE '{U}' END AS category,
    product_key IN (SELECT product_key FROM rules) AS has_rule, bool_or(canonical_name IS NOT NULL) AS has_canonical_name,
    concat_ws(',', CASE WHEN bool_or(label = '{U}') THEN 'unresolved' END,
      CASE WHEN bool_or(coalesce(trim(category), '') <> '' AND category NOT IN ({CANON})) THEN 'legacy_category' END,
      CASE WHEN bool_or(flag = 'R') THEN 'fallback' END, CASE WHEN count(DISTINCT label) > 1 THEN 'category_conflict' END,
      CASE WHEN bool_or(flag = 'A') AND bool_or(flag = 'N') THEN 'manual_and_rule' END,
      CASE WHEN bool_or(normalized_name IS NULL) THEN 'no_normalized_name' END,
      CASE WHEN product_key NOT IN (SELECT product_key FROM rules) THEN 'no_manual_rule' END,
      CASE WHEN bool_or(coalesce(trim(category), '') = '') THEN 'empty_category' END) AS problems
  FROM obs GROUP BY product_key)"""
add("review_groups", "SELECT * FROM groups WHERE problems <> ''", *OBS_VIEWS, RULES, REVIEW)
add("review_page", """SELECT * FROM groups WHERE list_contains(string_split(problems, ','), 'category_conflict')
  ORDER BY conflict_count DESC, item_count DESC, lower(display_name), product_key LIMIT 100""", *OBS_VIEWS, RULES, REVIEW)
for order, by, skip in (("count", "item_count DESC, lower(display_name)", 50), ("recent", "last_date DESC", 0), ("name", "lower(display_name)", 100)):
    add(f"review_page_{order}", f"""SELECT * FROM groups WHERE list_contains(string_split(problems, ','), 'no_manual_rule')
  ORDER BY {by}, product_key LIMIT 50 OFFSET {skip}""", *OBS_VIEWS, RULES, REVIEW)
add("review_page_info", "SELECT count(*) AS total_count, TRUE AS has_prev, count(*) > 100 AS has_next FROM groups WHERE problems <> ''", *OBS_VIEWS, RULES, REVIEW)
add("review_values", f"""SELECT DISTINCT product_key, kind, value FROM (
  SELECT product_key, 'alias' AS kind, name AS value FROM obs UNION ALL SELECT product_key, 'category', label FROM obs
  UNION ALL SELECT product_key, 'source', category_source FROM obs UNION ALL SELECT product_key, 'store', store FROM obs
  UNION ALL SELECT product_key, 'legacy', category FROM obs WHERE coalesce(trim(category), '') <> '' AND category NOT IN ({CANON}))""", *OBS_VIEWS)
add("category_audit", f"""SELECT 'category' AS metric, coalesce(category, '') AS label, count(*) AS n FROM items GROUP BY ALL
  UNION ALL SELECT 'source', category_source, count(*) FROM items GROUP BY ALL
  UNION ALL SELECT 'total_items', '', count(*) FROM items
  UNION ALL SELECT 'empty_categories', '', count(*) FROM items WHERE coalesce(category, '') = ''
  UNION ALL SELECT 'unknown_categories', '', count(DISTINCT category) FROM items WHERE coalesce(category, '') <> '' AND label NOT IN ({CANON})
  UNION ALL SELECT 'other_count', '', count(*) FROM items WHERE label = '{U}'
  UNION ALL SELECT 'manual_rules', '', count(*) FROM rules
  UNION ALL SELECT 'covered_by_rules', '', count(*) FROM items WHERE product_key IN (SELECT product_key FROM rules)
  UNION ALL SELECT 'conflict_groups', '', count(*) FROM (SELECT 1 FROM items GROUP BY product_key HAVING count(DISTINCT label) > 1)""", *ITEM_VIEWS, RULES)
PADDED = "' ' || trim(regexp_replace(lower(coalesce({c}, '')), '[^\\p{{L}}]+', ' ', 'g')) || ' '"
# Which bound names contain a keyword is checked on the text itself.
ALL_PATTERNS = " OR ".join(f"contains(t, '{p}')" for listing in V.keyword_patterns().values() for p in listing)
RECORDS = f"""records AS (
  SELECT i.* REPLACE (CASE WHEN n.hit <> (predicted <> '{U}') THEN 'unexpected keyword' ELSE predicted END AS predicted), r.category IS NOT NULL AS covered,
    CASE r.category WHEN 'напитки' THEN '{V.SOFT_DRINKS}' ELSE r.category END AS rule_category
  FROM items i JOIN (SELECT name AS nm, ({ALL_PATTERNS}) AS hit FROM (SELECT name, {PADDED.format(c='name')} AS t FROM (SELECT DISTINCT name FROM parts))) n ON n.nm = i.name
  LEFT JOIN rules r ON r.product_key = lower(replace(i.name, '#', ' ')))"""
add("classifier_confusion", """SELECT label AS persisted, predicted, covered AS rule_covered, count(*) AS lines FROM records GROUP BY ALL""", *ITEM_VIEWS, RULES, RECORDS)
add("classifier_summary", f"""SELECT scope, CAST(sum(n) AS BIGINT) AS lines, CAST(sum(e) AS BIGINT) AS exact_matches, CAST(sum(f) AS BIGINT) AS fallback_count, count(*) AS identities,
    count(*) FILTER (e = n) AS exact_identities, CAST(sum(o) AS BIGINT) AS rule_override_lines,
    ((20000 * sum(e) + sum(n)) // (2 * sum(n))) / 10000.0 AS exact_rate, ((20000 * sum(f) + sum(n)) // (2 * sum(n))) / 10000.0 AS fallback_rate,
    ((20000 * count(*) FILTER (e = n) + count(*)) // (2 * count(*))) / 10000.0 AS exact_identity_rate
  FROM (SELECT scope, identity, count(*) AS n, count(*) FILTER (label = predicted) AS e, count(*) FILTER (predicted = '{U}') AS f,
      count(*) FILTER (rule_category <> predicted) AS o
    FROM (SELECT *, 'overall' AS scope FROM records UNION ALL SELECT *, CASE WHEN covered THEN 'rule_covered' ELSE 'rule_free' END FROM records)
    GROUP BY scope, identity) GROUP BY scope""", *ITEM_VIEWS, RULES, RECORDS)
add("classifier_samples", """SELECT label AS persisted, predicted, rank, name FROM (
  SELECT *, row_number() OVER (PARTITION BY label, predicted ORDER BY receipt_id, id) AS rank FROM records WHERE label <> predicted) WHERE rank <= 3""", *ITEM_VIEWS, RULES, RECORDS)
add("category_sources", "SELECT category_source, count(*) AS lines FROM items GROUP BY ALL", *ITEM_VIEWS)

# --- tables -------------------------------------------------------------------------------
add("constraint_audit", """SELECT 'receipts.receipt_number_unique' AS constraint_name, count(*) AS violations FROM (SELECT 1 FROM receipts GROUP BY receipt_number HAVING count(*) > 1)
  UNION ALL SELECT 'rules.product_key_unique', count(*) FROM (SELECT 1 FROM rules GROUP BY product_key HAVING count(*) > 1)
  UNION ALL SELECT 'receipts.total_not_null', count(*) FROM receipts WHERE total IS NULL
  UNION ALL SELECT 'receipts.receipt_number_not_null', count(*) FROM receipts WHERE receipt_number IS NULL
  UNION ALL SELECT 'items.receipt_id_not_null', count(*) FROM items WHERE receipt_id IS NULL
  UNION ALL SELECT 'items.name_not_null', count(*) FROM items WHERE name IS NULL
  UNION ALL SELECT 'items.quantity_not_null', count(*) FROM items WHERE q IS NULL
  UNION ALL SELECT 'items.price_not_null', count(*) FROM items WHERE price IS NULL
  UNION ALL SELECT 'items.category_not_null', count(*) FROM items WHERE category IS NULL
  UNION ALL SELECT 'items.category_source_not_null', count(*) FROM items WHERE category_source IS NULL
  UNION ALL SELECT 'items.receipt_exists', count(*) FROM items WHERE receipt_id NOT IN (SELECT id FROM receipts)""", RECEIPTS, PARTS, ITEMS, RULES)
add("schema_conform", f"""SELECT 'rule' AS category_source, TRUE AS no_canonical, count(*) AS lines, {two('sum(price)')} AS spend FROM obs""", *OBS_VIEWS)

# --- names and duplicates -----------------------------------------------------------------
add("name_features", """SELECT DISTINCT name, lower(replace(name, '#', ' ')) AS normalized, CASE WHEN p_type = 'LARGE' THEN CAST(p_size AS BIGINT) * 100 END AS volume_ml,
    CASE WHEN p_type IN ('ECONOMY', 'STANDARD', 'MEDIUM') THEN CAST(p_size AS BIGINT) * 100 END AS weight_g, CAST(NULL AS DOUBLE) AS percentage,
    CASE WHEN p_type = 'PROMO' THEN '2 x ' || p_size || '0 g' END AS multipack,
    array_to_string(list_sort(list_distinct(regexp_extract_all(lower(replace(name, '#', ' ')), '\\b[a-z]{2,}\\b'))), ' ') AS tokens FROM items""", *ITEM_VIEWS)
add("search_products", """SELECT identity FROM (SELECT DISTINCT identity FROM items WHERE identity ILIKE '%hot gear%' OR name ILIKE '%hot gear%')
  ORDER BY lower(identity), identity LIMIT 10""", *ITEM_VIEWS)
add("resolve_names", """SELECT asked, coalesce((SELECT min(identity) FROM named WHERE identity = asked),
    (SELECT CASE WHEN count(DISTINCT identity) = 1 THEN min(identity) END FROM named WHERE name = asked)) AS identity
  FROM (SELECT DISTINCT name AS asked FROM items UNION SELECT p_name FROM part)""", *ITEM_VIEWS, "named AS (SELECT DISTINCT name, identity FROM items)")
add("merge_catalogue", """SELECT identity AS product, count(*) AS item_count, count(DISTINCT receipt_id) AS receipt_count, max(canonical_name) AS canonical_name
  FROM items GROUP BY identity""", *ITEM_VIEWS)
add("match_catalogue", """SELECT name, coalesce(normalized_name, '') AS normalized_name, identity, nullif(category, '') AS category, count(*) AS item_count,
    count(DISTINCT receipt_id) AS receipt_count FROM items GROUP BY ALL""", *ITEM_VIEWS)

# all pairs, scored by the bits of a common subsequence; no bound name holds a variant word or a percentage
LCS = """list_reduce(list_prepend((CAST(1 AS BIGINT) << length({a})) - 1, list_transform(range(length({b})),
    lambda k: list_sum(list_transform(range(length({a})), lambda i: CASE WHEN {a}[i + 1] = {b}[k + 1] THEN CAST(1 AS BIGINT) << i ELSE 0 END)))),
    lambda state, m: ((state + (state & CAST(m AS BIGINT))) | (state - (state & CAST(m AS BIGINT)))) & ((CAST(1 AS BIGINT) << length({a})) - 1))"""
KNOWN_LCS = """list_reduce(list_prepend((CAST(1 AS BIGINT) << length({a}.s)) - 1, list_transform(string_split({b}.s, ''), lambda ch: coalesce({a}.masks[ch], 0))),
    lambda state, m: ((state + (state & m)) | (state - (state & m))) & ((CAST(1 AS BIGINT) << length({a}.s)) - 1))"""
SUGGESTIONS = f"""products AS (
  SELECT name, identity, nullif(category, '') AS category, count(*) AS item_count, count(DISTINCT receipt_id) AS receipt_count,
    lower(replace(name, '#', ' ')) AS normalized, coalesce(normalized_name, '') AS normalized_name FROM items GROUP BY ALL),
featured AS MATERIALIZED (
  SELECT *, CAST(nullif(regexp_extract(normalized, '\\b(\\d+)ml\\b', 1), '') AS BIGINT) AS ml, CAST(nullif(regexp_extract(normalized, '\\b(\\d+)g\\b', 1), '') AS BIGINT) AS g,
    CASE WHEN regexp_matches(name, '\\d+x\\d+g') THEN regexp_replace(regexp_extract(name, '\\d+x\\d+g'), '(\\d+)x(\\d+)g', '\\1 x \\2 g') END AS pack,
    list_sort(list_distinct(regexp_extract_all(normalized, '\\b[a-z]{{2,}}\\b'))) AS tokens, list_sort(list_distinct(string_split(normalized, ' '))) AS u,
    array_to_string(list_sort(string_split(normalized, ' ')), ' ') AS s,
    map_from_entries(list_transform(list_distinct(string_split(s, '')), lambda ch: struct_pack(k := ch,
      v := CAST(list_sum(list_transform(range(length(s)), lambda i: CASE WHEN s[i + 1] = ch THEN CAST(1 AS BIGINT) << i ELSE 0 END)) AS BIGINT)))) AS masks,
    md5('{{"name":"' || name || '","normalized_name":"' || normalized_name || '","identity":"' || identity || '"' || coalesce(',"category":"' || category || '"', '') || '}}') AS pid
  FROM products),
met AS MATERIALIZED (
  SELECT a, b, 100.0 - 100.0 * (length(a.s) + length(b.s) - 2 * (length(a.s) - bit_count({KNOWN_LCS.format(a="a", b="b")}))) / (length(a.s) + length(b.s)) AS sym
  FROM featured a JOIN featured b ON a.pid < b.pid AND a.pack IS NOT DISTINCT FROM b.pack
  WHERE coalesce(a.ml = b.ml, TRUE) AND coalesce(a.g = b.g, TRUE) AND NOT (coalesce(a.ml, a.g) IS NOT NULL AND coalesce(b.ml, b.g) IS NOT NULL
    AND (a.ml IS NULL OR b.ml IS NULL) AND (a.g IS NULL OR b.g IS NULL)) AND NOT (a.normalized = b.normalized AND a.identity = b.identity)),
split AS MATERIALIZED (
  SELECT a, b, sym, list_filter(a.u, lambda w: list_contains(b.u, w)) AS shared, array_to_string(list_filter(a.u, lambda w: NOT list_contains(b.u, w)), ' ') AS oa,
    array_to_string(list_filter(b.u, lambda w: NOT list_contains(a.u, w)), ' ') AS ob, length(array_to_string(shared, ' ')) AS base, CASE WHEN base > 0 THEN 1 ELSE 0 END AS gap,
    base + gap + length(oa) AS la, base + gap + length(ob) AS lb
  FROM met WHERE sym >= 75.9),
scored AS (
  SELECT a, b, sym, (sym + CASE WHEN base > 0 AND (oa = '' OR ob = '') THEN 100.0 ELSE greatest(
      100.0 - 100.0 * (length(oa) + length(ob) - 2 * (length(oa) - bit_count({LCS.format(a="oa", b="ob")}))) / (la + lb),
      CASE WHEN base > 0 THEN greatest(100.0 - 100.0 * (gap + length(oa)) / (base + la), 100.0 - 100.0 * (gap + length(ob)) / (base + lb)) ELSE 0 END) END) / 2 AS mean
  FROM split),
ordered AS (
  SELECT CASE WHEN a.item_count > b.item_count OR (a.item_count = b.item_count AND lower(a.identity) <= lower(b.identity)) THEN a ELSE b END AS l,
    CASE WHEN a.item_count > b.item_count OR (a.item_count = b.item_count AND lower(a.identity) <= lower(b.identity)) THEN b ELSE a END AS r, mean, sym
  FROM scored WHERE mean >= 88),
suggestions AS MATERIALIZED (
  SELECT l.identity AS left_identity, r.identity AS right_identity, l.normalized AS left_normalized, r.normalized AS right_normalized, l.item_count AS left_item_count,
    r.item_count AS right_item_count, l.receipt_count AS left_receipt_count, r.receipt_count AS right_receipt_count, l.category AS left_category, r.category AS right_category,
    round(mean, 2) AS score, round(sym, 2) AS symmetric_score, CASE WHEN mean >= 95 AND l.tokens = r.tokens THEN 'high' ELSE 'possible' END AS confidence,
    CASE WHEN l.ml = r.ml THEN l.ml END AS volume_ml, CASE WHEN l.g = r.g THEN l.g END AS weight_g, CAST(NULL AS DOUBLE) AS percentage, l.pack AS multipack,
    l.tokens = r.tokens AS same_words, coalesce(l.category = r.category, FALSE) AS same_category,
    coalesce(list_min(list_intersect(l.tokens, r.tokens)), split_part(l.identity, ' ', 1)) AS merge_term
  FROM ordered)"""
add("duplicate_suggestions", "SELECT * FROM suggestions", *ITEM_VIEWS, SUGGESTIONS)
add("top_duplicate_suggestions", """SELECT * FROM suggestions WHERE confidence = 'high'
  ORDER BY score DESC, left_item_count + right_item_count DESC, left_identity, right_identity LIMIT 200""", *ITEM_VIEWS, SUGGESTIONS)

# --- story and operations -----------------------------------------------------------------
STORY_OBS = (RECEIPTS, PARTS, ITEMS, OBS.replace("obs AS MATERIALIZED", "every_obs AS MATERIALIZED"),
             "obs AS MATERIALIZED (SELECT * FROM every_obs WHERE d >= DATE '1997-11-02' AND d < DATE '1998-06-01')", MIXED, ELIGIBLE, DEVIATION)
add("story_items", f"""SELECT o.identity, o.receipt_id, CAST(o.id AS VARCHAR) AS line_id, o.name, o.date, CAST(o.price AS DOUBLE) AS amount,
    coalesce(h.n >= 5 AND o.price >= 40 AND o.cents * 2 >= 3 * h.m2 AND (o.price >= 0.25 * s.spend OR (s.delta > 0 AND o.price >= 0.5 * s.delta)), FALSE) AS unusual,
    coalesce(h.n, 0) AS history_count, v.status, o.price_unit AS normalized_price_unit, CAST(v.change AS DOUBLE) AS deviation_percent,
    CASE WHEN v.m2 IS NULL THEN 0.0 ELSE round(abs(v.p / 10000.0 - v.m2 / 20000.0), 2) END AS price_effect, c.conflict AS category_conflict
  FROM obs o JOIN deviation v ON v.receipt_id = o.receipt_id AND v.id = o.id
  JOIN (SELECT identity, count(DISTINCT label) > 1 AS conflict FROM obs GROUP BY identity) c ON c.identity = o.identity
  LEFT JOIN (SELECT identity, count(*) AS n, CAST(2 * median(cents) AS BIGINT) AS m2 FROM obs WHERE d >= DATE '1998-01-31' AND d < DATE '1998-05-01' AND cents > 0
    GROUP BY identity) h ON h.identity = o.identity
  CROSS JOIN (SELECT sum(total) FILTER ({MAY}) AS spend, abs(sum(total) FILTER ({MAY}) - sum(total) FILTER (d >= DATE '1998-04-01' AND d < DATE '1998-05-01')) AS delta FROM receipts) s
  WHERE o.{MAY.replace('AND d', 'AND o.d')}""", *STORY_OBS)
add("story_timeline", f"""SELECT CASE WHEN n <= 60 THEN 'receipt' ELSE 'day_group' END AS type, date, CASE WHEN n <= 60 THEN id END AS receipt_id,
    count(*) AS receipts, CAST(sum(total) AS DOUBLE) AS total
  FROM (SELECT *, count(*) OVER () AS n FROM receipts WHERE {MAY}) GROUP BY ALL""", RECEIPTS)
add("story_timeline_receipts", f"""SELECT date, id AS receipt_id, store, CAST(total AS DOUBLE) AS total
  FROM receipts WHERE {MAY} AND (SELECT count(*) FROM receipts WHERE {MAY}) > 60""", RECEIPTS)
QUEUE = f"""queue AS (SELECT * FROM (
  SELECT 'category_conflicts' AS key, 1.0 AS priority, 'critical' AS severity, (SELECT count(*) FROM (SELECT 1 FROM items GROUP BY product_key HAVING count(DISTINCT label) > 1)) AS n
  UNION ALL SELECT 'low_confidence_prices', 2.0, 'high', (SELECT count(*) FROM items WHERE confidence IS NULL OR confidence < 0.75)
  UNION ALL SELECT 'suspicious_prices', 2.1, 'high', (SELECT count(*) FROM items WHERE price_e4 > 100000000)
  UNION ALL SELECT 'uncategorized', 5.0, 'low', (SELECT count(DISTINCT product_key) FROM items WHERE label = '{U}')) WHERE n > 0)"""
add("action_queue", """SELECT key, CAST(priority AS DOUBLE) AS priority, severity, n FROM queue
  UNION ALL SELECT 'merge_suggestions', 4.0, 'medium', n FROM (SELECT count(*) AS n FROM suggestions WHERE confidence = 'high') WHERE n > 0""", *ITEM_VIEWS, QUEUE, SUGGESTIONS)

# --- maintenance --------------------------------------------------------------------------
SOURCE = """CASE WHEN p_type = 'PROMO' THEN 'rejected' WHEN old AND p_type = 'SMALL' THEN 'inferred_piece' WHEN old THEN 'package_name'
    ELSE price_source END AS derived_source"""
FILLED_E4 = """CASE WHEN p_type = 'PROMO' THEN NULL WHEN p_type = 'SMALL' THEN (cents * 200 + q) // (2 * q)
    ELSE (2 * cents * 100000 + q * g) // (2 * q * g) END AS filled_e4"""
BACKFILL = f"""plan AS (SELECT *, {SOURCE}, {FILLED_E4},
    CASE WHEN p_type = 'PROMO' THEN 'unknown' WHEN p_type = 'SMALL' THEN 'eur_per_piece' WHEN p_type = 'LARGE' THEN 'eur_per_l' ELSE 'eur_per_kg' END AS new_unit,
    CASE WHEN old THEN CASE p_type WHEN 'PROMO' THEN NULL WHEN 'SMALL' THEN 0.70 ELSE 0.85 END ELSE confidence END AS new_confidence FROM items)"""
add("price_backfill_statistics", """SELECT derived_source, new_unit AS normalized_price_unit, coalesce(printf('%.2f', CAST(new_confidence AS DOUBLE)), 'NULL') AS confidence,
    CASE WHEN confidence >= 0.90 AND filled_e4 > 100000000 THEN 'suspicious' ELSE '' END AS conflict, count(*) AS checked, count(*) FILTER (old) AS to_update,
    CAST(sum(CASE WHEN p_type = 'PROMO' THEN 1 ELSE 0 END + CASE WHEN old AND p_type <> 'PROMO' THEN 1 ELSE 0 END
      + CASE WHEN filled_e4 > 100000000 THEN 1 ELSE 0 END + CASE WHEN p_type = 'PROMO' AND flag <> 'N' THEN 1 ELSE 0 END) AS BIGINT) AS warnings
  FROM plan GROUP BY ALL""", *ITEM_VIEWS, BACKFILL)
add("price_backfill_fields", """SELECT derived_source, field, count(*) AS lines FROM (
    SELECT derived_source, unnest(list_filter([
      'line_total', 'unit_price', CASE WHEN p_type <> 'PROMO' OR status <> 'O' THEN 'quantity_unit' END, CASE WHEN p_type NOT IN ('PROMO', 'SMALL') THEN 'package_size' END,
      'package_unit', CASE WHEN p_type <> 'PROMO' THEN 'normalized_unit_price' END, CASE WHEN p_type <> 'PROMO' OR status <> 'O' THEN 'normalized_price_unit' END,
      'price_parse_source', CASE WHEN p_type <> 'PROMO' THEN 'price_parse_confidence' END], lambda x: x IS NOT NULL)) AS field
    FROM plan WHERE old) GROUP BY ALL""", *ITEM_VIEWS, BACKFILL)
APPLIED = """done AS (SELECT *, old AND p_type NOT IN ('PROMO', 'SMALL') AS hit FROM plan),
after AS (SELECT CASE WHEN hit THEN price ELSE line_total END AS line_total, CASE WHEN hit THEN (cents * 200 + q) // (2 * q) ELSE unit_e4 END AS unit_e4,
    CASE WHEN hit THEN filled_e4 ELSE price_e4 END AS price_e4, CASE WHEN hit THEN new_unit ELSE price_unit END AS price_unit,
    CASE WHEN hit THEN new_confidence ELSE confidence END AS confidence, q, cents FROM done)"""
add("price_backfill_apply", SQL["price_quality"].split(ITEMS + "\n", 1)[1].replace("FROM items", "FROM after"), *ITEM_VIEWS, BACKFILL, APPLIED)
add("name_backfill", """SELECT CASE WHEN normalized_name IS NULL THEN 'to_update' ELSE 'already_filled' END AS outcome, count(*) AS lines,
    count(DISTINCT lower(replace(name, '#', ' '))) AS names FROM items GROUP BY ALL""", *ITEM_VIEWS)
add("recategorize", f"""SELECT coalesce(category, '') = '' AS touched, CASE WHEN coalesce(category, '') = '' THEN predicted ELSE category END AS category, count(*) AS lines
  FROM items GROUP BY ALL""", *ITEM_VIEWS)
add("recategorize_overwrite", "SELECT TRUE AS touched, predicted AS category, count(*) AS lines FROM items GROUP BY ALL", *ITEM_VIEWS)
add("manifest_validation", """SELECT error, count(*) AS products, CAST(sum(n) FILTER (error <> 'invalid_predicate' OR brand <> 'Brand#5') AS BIGINT) AS lines,
    CAST(sum(n) FILTER (brand NOT IN ('Brand#7', 'Brand#9')) AS BIGINT) AS stated_lines
  FROM (SELECT p_brand AS brand, identity, count(*) AS n, CASE p_brand WHEN 'Brand#2' THEN 'confidence_not_high' WHEN 'Brand#3' THEN 'target_not_approved'
      WHEN 'Brand#4' THEN 'unknown_operation' WHEN 'Brand#5' THEN 'invalid_predicate' WHEN 'Brand#6' THEN 'has_exclusions' WHEN 'Brand#7' THEN 'unsupported_predicate'
      WHEN 'Brand#8' THEN 'identity_duplicated' WHEN 'Brand#9' THEN 'invalid_predicate' WHEN 'Brand#10' THEN 'identity_missing' ELSE '' END AS error
    FROM items GROUP BY ALL) JOIN (VALUES (1), (2)) AS copies(copy) ON copy = 1 OR brand = 'Brand#8' GROUP BY error""", *ITEM_VIEWS)
add("csv_projection", """SELECT 'missing' AS side, count(*) AS receipts FROM receipts WHERE store = 'MACHINERY'
  UNION ALL SELECT 'unexpected', count(*) FROM receipts WHERE store = 'BUILDING'
  UNION ALL SELECT 'read', count(*) FILTER (store <> 'MACHINERY') + count(*) FILTER (store = 'BUILDING') FROM receipts""", RECEIPTS)
add("report_sink", SQL["category_audit"])
UPSERT = """fresh AS (SELECT DISTINCT product_key FROM items WHERE canonical_name LIKE 'Brand#8 %' OR canonical_name LIKE 'Brand#10 %')"""
add("rule_upsert", f"""SELECT coalesce(r.product_key, f.product_key) AS product_key, CASE WHEN f.product_key IS NOT NULL THEN '{V.MEAT}' ELSE r.category END AS category,
    'manual' AS source, CASE WHEN r.product_key IS NULL THEN '2001-02-03' ELSE '2001-01-01' END AS created,
    CASE WHEN f.product_key IS NOT NULL THEN '2001-02-03' ELSE '2001-01-01' END AS updated
  FROM rules r FULL JOIN fresh f ON f.product_key = r.product_key""", *ITEM_VIEWS, RULES, UPSERT)
add("apply_product_categories", f"""SELECT CASE WHEN r.category IS NULL THEN i.category WHEN r.category = 'напитки' THEN '{V.SOFT_DRINKS}' ELSE r.category END AS category,
    CASE WHEN r.category IS NULL THEN i.category_source ELSE 'manual' END AS category_source, count(*) AS lines
  FROM items i LEFT JOIN rules r ON r.product_key = i.product_key GROUP BY ALL""", *ITEM_VIEWS, RULES)
add("override_lines", f"""SELECT CASE WHEN q = 50 THEN '{V.HOUSEHOLD}' ELSE category END AS category, CASE WHEN q = 50 THEN 'manual' ELSE category_source END AS category_source,
    count(*) AS lines FROM items GROUP BY ALL""", *ITEM_VIEWS)
add("merge_products", """SELECT CASE WHEN base LIKE 'Brand#11 %' THEN 'Brand#11 merged' ELSE canonical_name END AS canonical_name, count(*) AS lines FROM items GROUP BY ALL""", *ITEM_VIEWS)
add("correction_previews", """SELECT error, FALSE AS eligible_before, error = '' AS eligible_after, count(*) AS lines FROM (
    SELECT CASE WHEN (2 * cents * 100000 + q * 250) // (2 * q * 250) > 100000000 THEN 'blocking_diagnostic_remains' ELSE '' END AS error FROM items WHERE confidence = 0.70)
  GROUP BY ALL""", *ITEM_VIEWS)
add("guarded_corrections", """SELECT CASE WHEN q = 50 THEN 'line_changed' ELSE 'written' END AS outcome, count(*) AS lines FROM items
  WHERE confidence = 0.70 AND (2 * cents * 100000 + q * 250) // (2 * q * 250) <= 100000000 GROUP BY ALL""", *ITEM_VIEWS)
add("arithmetic_repair", """SELECT q = 50 AND NOT old AND (p_type = 'PROMO' OR price_e4 > 100000000 OR FALSE) AS mismatch, coalesce(price_source, '') AS source, count(*) AS lines
  FROM items GROUP BY ALL""", *ITEM_VIEWS)
STATE = f"""states AS (SELECT identity, count(*) AS n, any_value(product_key) AS key FROM items WHERE identity LIKE 'Brand#4 %' GROUP BY identity)"""
WRONG = [("Brand#12", "identity_row_count"), ("Brand#13", "item_exception_count"), ("Brand#14", "rule_scope_rows"),
         ("Brand#15", "shared_product_key_identity_count"), ("Brand#16", "current_categories"), ("Brand#17", "effective_product"),
         ("Brand#18", "product_key"), ("Brand#19", "existing_rule"), ("Brand#20", "raw_alias_keys"), ("Brand#21", "item_exception_ids")]
add("migration_violations", " UNION ALL ".join(
    f"SELECT DISTINCT identity AS effective_product, '{p}_drift' AS violation FROM items WHERE identity LIKE '{brand} %'" for brand, p in WRONG), *ITEM_VIEWS)
add("migration_drift", """SELECT 'line' AS kind, count(*) AS n FROM items WHERE identity LIKE 'Brand#4 %' AND q = 50 UNION ALL SELECT 'rule', 1
  UNION ALL SELECT 'lines written', count(*) FROM items WHERE identity LIKE 'Brand#4 %' AND q <> 50
  UNION ALL SELECT 'rules written', count(DISTINCT key) - 1 FROM states""", *ITEM_VIEWS, STATE)
add("migration_summary", """SELECT coalesce(category, '') AS source, 'алкоголь' AS target, count(*) AS lines FROM items WHERE identity LIKE 'Brand#4 %' GROUP BY ALL""", *ITEM_VIEWS)
add("migration", """SELECT 'changed' AS kind, 'category' AS detail, count(*) AS n FROM items WHERE identity LIKE 'Brand#4 %'
  UNION ALL SELECT 'violations', '', 0 UNION ALL SELECT 'rules', 'insert', count(DISTINCT key) FROM states
  UNION ALL SELECT 'rules', 'total', (SELECT count(DISTINCT key) FROM states) + (SELECT count(*) FROM rules)""", *ITEM_VIEWS, RULES, STATE)
add("snapshot_diff", """SELECT CASE WHEN q = 1 THEN 'deleted' ELSE 'changed' END AS status, CASE WHEN q = 1 THEN '' WHEN flag = 'A' THEN 'category' ELSE 'category,category_source' END AS changed_fields,
    count(*) AS lines FROM items WHERE q IN (1, 50) GROUP BY ALL""", *ITEM_VIEWS)
add("snapshot_sparse_diff", """SELECT receipt_id, id, 'changed' AS status, CASE WHEN flag = 'A' THEN 'category' ELSE 'category,category_source' END AS changed_fields
  FROM items WHERE q = 50 AND canonical_name LIKE 'Brand#11 new %'""", *ITEM_VIEWS)
add("snapshot_equality", "SELECT count(*) FILTER (q = 50) AS missing, count(*) FILTER (q = 1) AS added FROM items", *ITEM_VIEWS)
add("snapshot_invariants", """SELECT 'receipts' AS metric, CAST(count(*) AS DOUBLE) AS value FROM receipts UNION ALL SELECT 'items', count(*) FROM items
  UNION ALL SELECT 'rules', count(*) FROM rules UNION ALL SELECT 'identities', count(DISTINCT identity) FROM items
  UNION ALL SELECT 'total_spend', CAST(sum(price) AS DOUBLE) FROM items
  UNION ALL SELECT 'category:' || coalesce(category, ''), count(*) FROM items GROUP BY ALL""", RECEIPTS, PARTS, ITEMS, RULES)

# --- ingest and streams -------------------------------------------------------------------
PAGED = "paged AS (SELECT obs.*, receipt_id AS page FROM obs)"
HALVES = "halves AS (SELECT *, CAST(page % 2 AS BIGINT) AS batch FROM paged)"
RIMI = "store IN ('AUTOMOBILE', 'BUILDING')"
add("parse_receipts", f"""SELECT 'R-' || page AS receipt_number, name, CAST(q AS DOUBLE) AS quantity, CASE WHEN {RIMI} THEN 'gab' ELSE 'piece' END AS quantity_unit,
    listed / 100.0 AS unit_price, CAST(price AS DOUBLE) AS price FROM paged""", *OBS_VIEWS, PAGED)
add("parse_receipt_heads", f"""SELECT 'R-' || page AS receipt_number, date, CASE WHEN {RIMI} THEN 'RIMI' ELSE 'MAXIMA' END AS store, CAST(sum(price) AS DOUBLE) AS total
  FROM paged GROUP BY ALL""", *OBS_VIEWS, PAGED)
add("ingest_receipts", f"""SELECT coalesce(rule_category, predicted) AS category,
    CASE WHEN rule_category IS NOT NULL THEN 'inherited' WHEN predicted = '{U}' THEN 'fallback' ELSE 'rule' END AS category_source,
    CASE WHEN p_type = 'PROMO' THEN 'rejected' ELSE 'parser' END AS price_parse_source,
    CASE p_type WHEN 'PROMO' THEN 'unknown' WHEN 'SMALL' THEN 'eur_per_piece' WHEN 'LARGE' THEN 'eur_per_l' ELSE 'eur_per_kg' END AS normalized_price_unit,
    count(*) AS lines, CAST(sum(price) AS DOUBLE) AS spend
  FROM (SELECT p.*, CASE r.category WHEN 'напитки' THEN '{V.SOFT_DRINKS}' ELSE r.category END AS rule_category
    FROM paged p LEFT JOIN rules r ON r.product_key = lower(replace(p.name, '#', ' ')) WHERE store <> 'MACHINERY') GROUP BY ALL
  UNION ALL SELECT 'receipts', 'receipts', 'receipts', 'receipts', count(DISTINCT page), CAST(sum(price) AS DOUBLE) FROM paged WHERE store <> 'MACHINERY'""",
    *OBS_VIEWS, RULES, PAGED)
add("nested_receipts", """SELECT error, count(DISTINCT page) AS receipts, CASE WHEN error = '' THEN count(*) END AS lines
  FROM (SELECT *, CASE WHEN store = 'FURNITURE' THEN 'not_synthetic' ELSE '' END AS error FROM paged) GROUP BY error""", *OBS_VIEWS, PAGED)
add("ingest_stream", """SELECT 'receipts' AS kind, count(DISTINCT page) AS rows, CAST(sum(price) AS DOUBLE) AS amount FROM paged
  UNION ALL SELECT 'items', count(*), CAST(sum(price) AS DOUBLE) FROM paged""", *OBS_VIEWS, PAGED)
add("sweep_receipts", """SELECT batch, 'receipts' AS kind, count(DISTINCT page) AS rows, CAST(sum(price) AS DOUBLE) AS amount FROM halves GROUP BY batch
  UNION ALL SELECT batch, 'items', count(*), CAST(sum(price) AS DOUBLE) FROM halves GROUP BY batch""", *OBS_VIEWS, PAGED, HALVES)
add("load_receipts", "SELECT count(DISTINCT page) AS receipts, count(*) AS items FROM paged WHERE store <> 'FURNITURE'", *OBS_VIEWS, PAGED)
add("stream_dedupe", "SELECT event_type, count(DISTINCT event_id) AS events, count(DISTINCT event_id) AS distinct_events FROM events GROUP BY event_type")
add("stream_enrich", f"""SELECT coalesce(rule_category, predicted) AS category,
    CASE WHEN rule_category IS NOT NULL THEN 'inherited' WHEN predicted = '{U}' THEN 'fallback' ELSE 'rule' END AS category_source,
    CASE WHEN p_type = 'PROMO' THEN 'rejected' WHEN flag = 'N' THEN 'parser' WHEN p_type = 'SMALL' THEN 'inferred_piece' ELSE 'package_name' END AS price_parse_source,
    count(*) AS lines, CAST(sum(price) AS DOUBLE) AS spend
  FROM (SELECT i.*, CASE r.category WHEN 'напитки' THEN '{V.SOFT_DRINKS}' ELSE r.category END AS rule_category
    FROM items i LEFT JOIN rules r ON r.product_key = lower(replace(i.name, '#', ' '))) GROUP BY ALL""", *ITEM_VIEWS, RULES)


def classifier_sql(source: str, name: str) -> str:
    """The classifier as SQL over `source`, one row per name: columns name and predicted."""
    patterns = V.keyword_patterns()
    order = V.CATEGORY_PRIORITY
    has = {c: " OR ".join(f"contains(t, '{p}')" for p in patterns[c]) for c in order}
    begins = lambda *w: f"regexp_matches(t, ' ({'|'.join(w)})')"
    word = lambda *w: f"regexp_matches(t, ' ({'|'.join(w)}) ')"
    extra = {V.BABY: f"(regexp_matches(name, '(^|[^0-9])[0-9]{{1,2}}\\s*\\+') AND {begins('biez', 'putr', 'pire')})",
             V.FROZEN: f"({word('frī', 'fri')} AND {begins('kartupeļ', 'kartupel', 'kartup')})",
             V.READY_MEALS: f"({begins('nūd', 'nud')} AND {word('zupa', 'ramyun', 'instant')})",
             V.SERVICE: f"({begins('maisiņ', 'maisin')} AND NOT {begins('atkritum')})"}
    buns = f" AND NOT ({begins('burgeru')} AND contains(t, 'maiz'))"
    number = {c: f"c{i}" for i, c in enumerate(order)}
    hits = ", ".join(f"({has[c]} OR {extra.get(c, 'FALSE')}){buns if c == V.READY_MEALS else ''} AS {number[c]}" for c in order)
    first = lambda c: "least(" + ", ".join(f"coalesce(nullif(instr(t, '{p}'), 0), 1000000)" for p in patterns[c]) + ")"
    n = number
    closed = " OR ".join([
        f"({word('hortex')} AND NOT {n[V.FROZEN]})", f"({begins('humoss')} AND NOT {n[V.SAUCES]})", f"({begins('kuskus')} AND NOT {n[V.READY_MEALS]})",
        f"({begins('vārīt', 'varit')} AND {n[V.PRODUCE]} AND NOT {n[V.READY_MEALS]})",
        f"({begins('salāt', 'salat')} AND {n[V.SAUCES]} AND NOT ({begins('mērc', 'merc', 'majon', 'kečup', 'kecup', 'konserv')} OR contains(t, 'tomātu pasta') OR contains(t, 'tomatu pasta')))",
        begins("pankūk", "pankuk"), f"({word('uzkoda')} AND {n[V.DAIRY]} AND NOT {n[V.SNACKS]})",
        f"({word('pulveris')} AND {n[V.PRODUCE]} AND NOT {n[V.SOFT_DRINKS]})"])
    steps = f"hits AS (SELECT *, {hits} FROM texts), s0 AS (SELECT *, {closed} AS closed FROM hits)"
    for i, (a, b) in enumerate(((V.MEAT, V.DAIRY), (V.MEAT, V.BAKERY), (V.SNACKS, V.DAIRY), (V.SOFT_DRINKS, V.DAIRY))):
        steps += (f", s{i + 1} AS (SELECT * REPLACE ({n[a]} AND NOT ({n[b]} AND {first(a)} > {first(b)}) AS {n[a]}, "
                  f"{n[b]} AND NOT ({n[a]} AND {first(a)} <= {first(b)}) AS {n[b]}) FROM s{i})")
    label = " ".join(f"WHEN {n[c]} THEN '{c}'" for c in order)
    return (f"texts AS (SELECT {name} AS name, {PADDED.format(c=name)} AS t FROM {source}), {steps}, "
            f"labelled AS (SELECT name, CASE WHEN closed THEN '{U}' {label} ELSE '{U}' END AS predicted FROM s4)")


# what a shopper would say, name by name, in the order of `tables.CONTESTED`
CONTESTED = [(n, label) for label, names in (
    (V.MEAT, ["Cāļa šķiņķi grieķu jog. marinādē"]), (V.DAIRY, ["Kausētais siers DZINTARS ar šķiņķi"]), (V.SNACKS, ["Čipsi ar siera garšu", "Zemesrieksti ESTRELLA Čedaras siers"]),
    (V.BAKERY, ["Burgeru maizītes Maiziņš", "Baltmaize kefīra Lielmaize", "Kruasāns ar kakao krēmu"]), (V.SOFT_DRINKS, ["Ledus tēja FUZETEA citr.-citronz."]),
    (V.PETS, ["Konservi kaķiem ar tunci"]), (V.READY_MEALS, ["Sviestm. GIGA ar vist. g. gurķi sieru", "Gaļas salāti ar šķiņķi", "Nūd. zupa NONGSHIM KIMCHI RAMYUN"]),
    (V.FROZEN, ["Saldēti frī kartupeļi AVIKO Steak"]), (V.BABY, ["BIO biez. RŪDOLFS dārz. rīsi vista 6+"]), (V.SERVICE, ["Papīra iepirkumu maisiņš PALDIES"]),
    (V.SAUCES, ["Tomātu pasta SPILVA"]), (U, ["Dārzeņi cepšanai HORTEX", "Humoss ar zaļumiem ATLANTIKA", "Kuskuss ar dārzeņiem GRACI", "Kukurūzas saldās vālītes vārītas",
    "Gurķu-sinepju salāti SPILVA", "Pankūkas ar biezpiena pildīj. MĀJAS", "Siera uzkoda WELL DONE PREMIUM Pizza", "Pulveris Isostar H&P apelsinu"]),
    (V.MEAT, ["Liell. g. uzkoda Beef Jerky Classic WD"]), (V.PRODUCE, ["Ķirbis RIEKSTU"]), (V.HOUSEHOLD, ["Zobu birste COLGATE Ultra Soft 1+1"])) for n in names]
add("classifier_conflicts", f"""SELECT n || ' ' || p_name AS name, label AS predicted FROM part
  JOIN (VALUES {", ".join(f"({i}, '{n}', '{label}')" for i, (n, label) in enumerate(CONTESTED))}) AS said(i, n, label) ON p_partkey % {len(CONTESTED)} = i""")

add("classify_text_lines", "SELECT predicted, count(*) AS lines FROM labelled GROUP BY predicted",
    "document_lines AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)", classifier_sql("document_lines", "line"))

# --- the ranked insight and what follows from it ------------------------------------------
APRIL = "d >= DATE '1998-04-01' AND d < DATE '1998-05-01'"
STORY_VIEWS = (*STORY_OBS, "story AS MATERIALIZED (" + SQL["story_items"].split(DEVIATION + "\n", 1)[1] + ")",
    f"""s AS (SELECT CAST(coalesce(sum(total) FILTER ({MAY}), 0) AS DOUBLE) AS spend, CAST(coalesce(sum(total) FILTER ({APRIL}), 0) AS DOUBLE) AS before,
    CAST(coalesce(sum(total) FILTER ({MAY}), 0) - coalesce(sum(total) FILTER ({APRIL}), 0) AS DOUBLE) AS delta,
    count(*) FILTER ({MAY}) AS n, count(*) FILTER ({APRIL}) AS b FROM receipts)""",
    f"""cats AS (SELECT label, CAST(coalesce(sum(price) FILTER ({MAY}), 0) AS DOUBLE) AS c, CAST(coalesce(sum(price) FILTER ({APRIL}), 0) AS DOUBLE) AS p FROM obs
    WHERE ({MAY}) OR ({APRIL}) GROUP BY label)""",
    f"""covered AS (SELECT sum(c) AS c, sum(p) AS p, coalesce(sum(c) FILTER (label = '{U}'), 0) AS oc, coalesce(sum(p) FILTER (label = '{U}'), 0) AS op FROM cats)""",
    f"""moved AS (SELECT label, c - p AS move FROM cats WHERE label <> '{U}' AND (SELECT s.n >= 3 AND s.b >= 3 AND abs(s.delta) >= greatest(10, 0.1 * s.before)
      AND v.c >= 0.8 * s.spend AND v.p >= 0.8 * s.before AND v.oc <= 0.3 * v.c AND v.op <= 0.3 * v.p AND v.c > 0 AND v.p > 0 FROM s, covered v)
      AND sign(c - p) = (SELECT sign(delta) FROM s) AND abs(c - p) >= (SELECT greatest(10, 0.4 * abs(delta)) FROM s) ORDER BY abs(c - p) DESC, label LIMIT 1)""",
    f"""offers AS (
      SELECT * FROM (SELECT 'unusual_purchase' AS type, 1 AS priority, identity AS subject_key, amount AS metric_value, 'EUR' AS metric_unit, [receipt_id] AS evidence
        FROM story WHERE unusual ORDER BY amount DESC, identity, receipt_id LIMIT 1)
      UNION ALL SELECT * FROM (SELECT 'unusual_purchase', 1, 'receipt:' || id, CAST(total AS DOUBLE), 'EUR', [id] FROM receipts, s
        WHERE {MAY} AND total >= 100 AND total * 2 >= 3 * (SELECT CASE WHEN count(*) >= 5 THEN CAST(2 * median(CAST(total * 100 AS BIGINT)) AS BIGINT) END FROM receipts
            WHERE d >= DATE '1998-01-31' AND d < DATE '1998-05-01' AND total > 0) / 100.0
          AND (total >= 0.25 * spend OR (delta <> 0 AND total >= 0.5 * abs(delta))) ORDER BY total DESC, id LIMIT 1)
      UNION ALL SELECT 'category_impact', 2, label, round(move, 2), 'EUR', (SELECT list(receipt_id) FROM (SELECT receipt_id FROM obs WHERE {MAY} AND label = (SELECT label FROM moved)
          GROUP BY receipt_id ORDER BY sum(price) DESC, receipt_id LIMIT 3)) FROM moved
      UNION ALL SELECT 'visit_frequency', 3, 'receipt_frequency', n - b, 'receipts', (SELECT list(id) FROM (SELECT id FROM receipts WHERE {MAY} ORDER BY date DESC, id DESC LIMIT 3))
        FROM s WHERE b > 0 AND n + b >= 5 AND abs(n - b) >= 3 AND abs(n - b) >= 0.4 * b AND delta <> 0 AND abs(delta) >= greatest(10, 0.1 * before)
          AND sign(n - b) = sign(delta) AND abs(n - b) * before / b >= 0.4 * abs(delta)
      UNION ALL SELECT * FROM (SELECT 'normalized_price', 4, identity || ':' || normalized_price_unit, deviation_percent, 'percent', [receipt_id] FROM story, s
        WHERE abs(deviation_percent) >= 15 AND status IN ('CHEAPER_THAN_USUAL', 'MORE_EXPENSIVE_THAN_USUAL') AND NOT category_conflict
          AND (amount >= 0.1 * spend OR price_effect >= 3) ORDER BY abs(deviation_percent) DESC, amount DESC, identity, receipt_id, line_id LIMIT 1)
      UNION ALL SELECT 'calm_month', 5, CASE WHEN n = 0 THEN 'empty' WHEN b > 0 THEN 'stable' ELSE 'no_baseline' END, CASE WHEN delta <> 0 THEN delta ELSE spend END, 'EUR', [] FROM s)""",
    """insight AS MATERIALIZED (SELECT * FROM offers ORDER BY priority, CASE WHEN priority = 1 THEN -metric_value END, starts_with(subject_key, 'receipt:') LIMIT 1)""")
add("ranked_insight", """SELECT type, subject_key, CAST(metric_value AS DOUBLE) AS metric_value, metric_unit,
    coalesce(array_to_string(list_sort(evidence), ','), '') AS evidence FROM insight""", *STORY_VIEWS)
add("story_signature", f"""SELECT type, subject_key, sha256(concat_ws('|', type, subject_key, CAST(CAST(round_even(metric_value / 5, 0) * 5 AS BIGINT) AS VARCHAR),
    coalesce(array_to_string(list_sort(evidence), ','), ''), CAST((SELECT coalesce(arg_max(id, (date, id)), 0) FROM receipts WHERE {MAY}) AS VARCHAR))) AS story_signature FROM insight""", *STORY_VIEWS)
SHOWN = f"""ranked AS (SELECT id, date, store, total, row_number() OVER (ORDER BY date, id) - 1 AS rk, count(*) OVER () AS n FROM receipts WHERE {MAY}),
picks AS (
  SELECT id, 0 AS pick FROM ranked WHERE list_contains((SELECT evidence FROM insight), id)
  UNION ALL SELECT id, 3 FROM (SELECT id FROM ranked ORDER BY total DESC, id LIMIT 2)
  UNION ALL SELECT id, 5 FROM ranked WHERE rk = n - 1 UNION ALL SELECT id, 6 FROM ranked WHERE rk = 0
  UNION ALL SELECT id, 7 FROM ranked WHERE n > 4 AND rk = round_even((n - 1) * 0.25, 0) UNION ALL SELECT id, 8 FROM ranked WHERE n > 4 AND rk = round_even((n - 1) * 0.5, 0)
  UNION ALL SELECT id, 9 FROM ranked WHERE n > 4 AND rk = round_even((n - 1) * 0.75, 0) UNION ALL SELECT id, rk + 100 FROM ranked WHERE rk < 6),
shown AS (SELECT r.id, date, store, total FROM ranked r JOIN (SELECT id, min(pick) AS pick FROM picks GROUP BY id) p ON p.id = r.id ORDER BY pick, total DESC, r.id LIMIT 6)"""
add("story_highlights", "SELECT id AS receipt_id, date, store, CAST(total AS DOUBLE) AS total FROM shown", *STORY_VIEWS, SHOWN)
add("story_remainder", f"""SELECT count(*) AS receipts, CAST(coalesce(sum(total), 0) AS DOUBLE) AS total FROM receipts
  WHERE {MAY} AND id NOT IN (SELECT id FROM shown)""", *STORY_VIEWS, SHOWN)
add("briefing", f"""SELECT -1.0 AS rank, 'decision' AS finding, CASE WHEN n = 0 THEN 'empty' WHEN b = 0 THEN 'no_baseline' WHEN changed THEN 'changed' ELSE 'stable' END AS subject,
    CASE WHEN n = 0 OR (b > 0 AND NOT changed AND (SELECT count(*) FROM findings) = 0) THEN 1.0 ELSE 0.0 END AS value FROM t
  UNION ALL SELECT * FROM (SELECT * FROM findings ORDER BY rank LIMIT 3)""", RECEIPTS, PARTS, ITEMS, OBS, QUEUE,
    f"""t AS (SELECT *, b > 0 AND abs(delta) >= 5 AND abs(delta) >= 0.0495 * before AS changed FROM (
      SELECT count(*) FILTER ({MAY}) AS n, count(*) FILTER ({APRIL}) AS b, coalesce(sum(total) FILTER ({APRIL}), 0) AS before,
        coalesce(sum(total) FILTER ({MAY}), 0) - coalesce(sum(total) FILTER ({APRIL}), 0) AS delta FROM receipts))""",
    f"""leader AS (SELECT label, CAST(c - p AS DOUBLE) AS delta FROM (SELECT label, coalesce(sum(price) FILTER ({MAY}), 0) AS c, coalesce(sum(price) FILTER ({APRIL}), 0) AS p
      FROM obs WHERE ({MAY}) OR ({APRIL}) GROUP BY label) ORDER BY abs(c - p) DESC, c DESC, label LIMIT 1)""",
    """findings AS (SELECT 0.0 AS rank, 'category_movement' AS finding, label AS subject, l.delta AS value FROM leader l, t WHERE b > 0 AND abs(l.delta) >= greatest(5, 0.05 * before)
      UNION ALL SELECT 1.0, 'visit_frequency', 'receipts', n - b FROM t WHERE b > 0 AND n <> b
      UNION ALL SELECT CAST(priority + 10 AS DOUBLE), 'operation', key, n FROM queue WHERE severity IN ('critical', 'high'))""")
add("parse_free_text", """SELECT 'MAXIMA' AS store, CASE WHEN trim(text) = '' THEN 'empty_text' WHEN regexp_matches(text, '[0-9]+,[0-9]{2}\\s+X\\s+[0-9,]+') THEN 'ok' ELSE 'no_items' END AS status,
    count(*) AS documents FROM documents GROUP BY ALL""")

SPOILED = [("Piens 1, 5L", "ocr_decimal_corruption", "corrected"), ("Siers lkg", "ocr_lkg", "rejected"), ("Sula 500m1", "ocr_m1", "rejected"),
           ("Čeks", "receipt_header", "rejected"), ("Kase Nr. 12", "cashier_line", "rejected"), ("Rīsi 8x125g", "multipack", "unresolved"),
           ("sviestu250g", "glued_tokens", "rejected"), ("Olas 6gab. 300g", "ambiguous_package_size", "unresolved"), ("Piens — ", "unknown", "corrected"),
           ("Piens 1L", "unknown", "unchanged"), ("Sula 2, 25L", "ocr_decimal_corruption", "rejected"), ("Cepumi 3+1", "multipack", "unresolved"),
           ("Maxima", "unknown", "unchanged")]
add("parser_audit_examples", f"""SELECT contamination, row_number() OVER (PARTITION BY contamination ORDER BY receipt_id, id, name) AS rank, receipt_id, id, name, action FROM (
    SELECT said.contamination, said.action, l_orderkey AS receipt_id, CAST(l_linenumber AS BIGINT) AS id, n || ' ' || p_name AS name FROM lineitem JOIN part ON l_partkey = p_partkey
    JOIN (VALUES {", ".join(f"({i}, '{n}', '{c}', '{a}')" for i, (n, c, a) in enumerate(SPOILED))}) AS said(i, n, contamination, action) ON p_partkey % {len(SPOILED)} = i)
  QUALIFY rank <= 5""")
add("parser_audit", """SELECT contamination, CASE contamination WHEN 'multipack' THEN 'unresolved' ELSE 'unchanged' END AS action,
    count(*) AS lines, count(DISTINCT name) AS names, min(name) AS example
  FROM (SELECT name, CASE WHEN regexp_matches(name, '(?i)\\b\\d+\\s*[xх×]\\s*\\d+([.,]\\d+)?\\s*(kg|g|ml|l)\\b|\\b\\d+\\s*\\+\\s*\\d+\\b') THEN 'multipack' ELSE 'unknown' END AS contamination
    FROM (SELECT name FROM items UNION ALL SELECT unnest(string_split(text, chr(10))) FROM documents))
  GROUP BY contamination""", *ITEM_VIEWS)
