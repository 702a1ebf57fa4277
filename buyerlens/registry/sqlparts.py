"""SQL fragments shared by the check statements."""

from __future__ import annotations

from buyerlens.config import NUMERIC_COLUMNS, PURCHASE_COLUMNS, SPEND_COLUMNS

PARTS: dict[str, tuple[tuple[str, ...], str]] = {}
TOPS = tuple(f"top{i}" for i in range(7))
SHARES = tuple(f"cat_share_{c}" for c in (*TOPS, "unknown"))
BASE = (
    "recency_days", "n_events", "n_views", "n_carts", "n_purch", "n_sessions", "n_active_days",
    "total_purch_value", "mean_purch_value", "max_purch_value", "mean_view_price",
    "cart_abandon_rate", "conversion",
)
FEATURES = (*BASE, *SHARES)
LS = "TIMESTAMP '2024-01-30 00:00:00'"
FS = "TIMESTAMP '2024-01-01 00:00:00'"
LE = "TIMESTAMP '2024-01-30 23:59:59'"


def part(name: str, sql: str, *needs: str) -> None:
    PARTS[name] = (needs, sql)


def stmt(needs: str, body: str) -> str:
    """A statement over the named fragments and everything they need."""
    seen: list[str] = []

    def visit(name: str) -> None:
        if name in seen:
            return
        for n in PARTS[name][0]:
            visit(n)
        seen.append(name)

    for n in needs.split():
        visit(n)
    if not seen:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({PARTS[n][1]})" for n in seen) + "\n" + body


def r(expr: str, alias: str | None = None) -> str:
    """Rounded double without negative zero."""
    out = f"(round(CAST({expr} AS DOUBLE), 6) + 0.0)"
    return f"{out} AS {alias}" if alias else out


def split_case(key: str, seed: str = "7") -> str:
    """Hashed 60/20/20 split of a key."""
    slot = f"(CAST('0x' || substr(md5('{seed}:' || {key}), 1, 8) AS BIGINT) % 100)"
    return f"CASE WHEN {slot} < 60 THEN 'train' WHEN {slot} < 80 THEN 'val' ELSE 'test' END"


part(
    "ev",
    """SELECT event_id, user_id, date_trunc('second', ts) AS ts,
  CASE WHEN event_type = 'click' THEN 'cart' ELSE event_type END AS event_type,
  CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS product_id,
  CAST(regexp_extract(props, '[0-9]+') AS BIGINT) % 20 AS category_id,
  CASE WHEN event_id % 3 <> 0 AND CAST(regexp_extract(props, '[0-9]+') AS BIGINT) % 20 <> 19 THEN
    'top' || ((CAST(regexp_extract(props, '[0-9]+') AS BIGINT) % 20) % 7) || '.sub' ||
    (CAST(regexp_extract(props, '[0-9]+') AS BIGINT) % 20) END AS category_code,
  CASE WHEN event_id % 5 <> 0 THEN
    'brand' || (CAST(regexp_extract(props, '[0-9]+') AS BIGINT) % 11) END AS brand,
  value AS price,
  CASE WHEN event_id % 97 <> 0 THEN user_id || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) END
    AS user_session
FROM events""",
)
part(
    "evf",
    f"""SELECT *, split_part(category_code, '.', 1) AS top_cat,
  ts >= {FS} AND ts < {LS} AS in_feat, ts >= {LS} AND ts <= {LE} AS in_label,
  event_type = 'view' AS is_view, event_type = 'cart' AS is_cart,
  event_type = 'purchase' AS is_purch
FROM ev""",
    "ev",
)
part(
    "lookup",
    """SELECT category_id, min(top_cat) AS top_cat_lookup FROM evf
WHERE top_cat IS NOT NULL GROUP BY category_id""",
    "evf",
)
part(
    "nextp",
    """SELECT user_id, category_id AS next_cat_id FROM (
  SELECT user_id, category_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, product_id) AS rn
  FROM evf WHERE in_label AND is_purch AND category_id IS NOT NULL) WHERE rn = 1""",
    "evf",
)
_counts = ",\n  ".join(
    f"CAST(count(*) FILTER (in_feat AND top_cat = '{c}') AS DOUBLE) AS cnt_{c}" for c in TOPS
)
part(
    "agg",
    f"""SELECT user_id,
  count(*) FILTER (in_feat) AS n_events,
  count(*) FILTER (in_feat AND is_view) AS n_views,
  count(*) FILTER (in_feat AND is_cart) AS n_carts,
  count(*) FILTER (in_feat AND is_purch) AS n_purch,
  count(DISTINCT user_session) FILTER (in_feat)
    + CAST(count(*) FILTER (in_feat AND user_session IS NULL) > 0 AS BIGINT) AS n_sessions,
  count(DISTINCT CAST(ts AS DATE)) FILTER (in_feat) AS n_active_days,
  max(ts) FILTER (in_feat) AS last_ts,
  coalesce(sum(price) FILTER (in_feat AND is_purch), 0) AS total_purch_value,
  coalesce(avg(price) FILTER (in_feat AND is_purch), 0) AS mean_purch_value,
  coalesce(max(price) FILTER (in_feat AND is_purch), 0) AS max_purch_value,
  coalesce(avg(price) FILTER (in_feat AND is_view), 0) AS mean_view_price,
  coalesce(bool_or(in_label AND is_purch), false) AS label_purchase,
  coalesce(bool_or(in_label), false) AS label_any_event,
  {_counts},
  CAST(count(*) FILTER (in_feat AND top_cat IS NULL) AS DOUBLE) AS cnt_unknown
FROM evf GROUP BY user_id HAVING count(*) FILTER (in_feat) >= 5""",
    "evf",
)
_shares = ",\n  ".join(f"cnt_{c} / n_events AS cat_share_{c}" for c in (*TOPS, "unknown"))
part(
    "ut",
    f"""SELECT a.user_id,
  date_diff('second', last_ts, {LS}) / 86400.0 AS recency_days,
  n_events, n_views, n_carts, n_purch, n_sessions, n_active_days,
  total_purch_value, mean_purch_value, max_purch_value, mean_view_price,
  CASE WHEN n_carts > 0 THEN 1.0 - CAST(n_purch AS DOUBLE) / n_carts ELSE 0.0 END AS cart_abandon_rate,
  CASE WHEN n_views > 0 THEN CAST(n_purch AS DOUBLE) / n_views ELSE 0.0 END AS conversion,
  {_shares},
  label_purchase, label_any_event, NOT label_any_event AS label_churned,
  CASE WHEN label_purchase THEN coalesce(top_cat_lookup, 'unknown') END AS label_next_cat
FROM agg a LEFT JOIN nextp n ON a.user_id = n.user_id
LEFT JOIN lookup l ON l.category_id = n.next_cat_id""",
    "agg",
    "nextp",
    "lookup",
)
_code = " ".join(f"WHEN label_next_cat = '{c}' THEN {i}" for i, c in enumerate(TOPS))
part(
    "uts",
    f"""SELECT *, {split_case('user_id')} AS split,
  CASE WHEN label_next_cat IS NULL THEN NULL {_code} WHEN label_next_cat = 'unknown' THEN 8
    ELSE 7 END AS next_code
FROM ut""",
    "ut",
)
part(
    "utl",
    "SELECT user_id, split, name, value FROM (SELECT user_id, split, unnest(["
    + ", ".join(f"{{'name': '{c}', 'value': CAST({c} AS DOUBLE)}}" for c in FEATURES)
    + "], recursive := true) FROM uts)",
    "uts",
)
part(
    "utm",
    """SELECT name, avg(value) AS mean,
  CASE WHEN stddev_pop(value) = 0 THEN 1.0 ELSE stddev_pop(value) END AS scale
FROM utl WHERE split = 'train' GROUP BY name""",
    "utl",
)
part(
    "utz",
    """SELECT user_id, split, name, value, (value - mean) / scale AS z
FROM utl JOIN utm USING (name)""",
    "utl",
    "utm",
)
_cons = {
    "rfm_R": "recency_days",
    "rfm_F": "n_purch",
    "rfm_M": "total_purch_value",
    "price_sensitivity": "-mean_view_price",
    **{f"affinity_{c}": f"cat_share_{c}" for c in TOPS},
}
CONSTRUCTS = tuple(_cons)
part(
    "ucl",
    "SELECT user_id, split, name, value FROM (SELECT user_id, split, unnest(["
    + ", ".join(f"{{'name': '{c}', 'value': CAST({e} AS DOUBLE)}}" for c, e in _cons.items())
    + "], recursive := true) FROM uts)",
    "uts",
)
part(
    "ucz",
    """SELECT user_id, split, u.name, value, (value - mean) / scale AS z FROM ucl u JOIN (
  SELECT name, avg(value) AS mean,
    CASE WHEN stddev_pop(value) = 0 THEN 1.0 ELSE stddev_pop(value) END AS scale
  FROM ucl WHERE split = 'train' GROUP BY name) m ON u.name = m.name""",
    "ucl",
)
_types = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
_spend = ", ".join(
    f"coalesce(sum(l_extendedprice) FILTER (p_type = '{t}'), 0) AS {c}"
    for t, c in zip(_types, SPEND_COLUMNS, strict=True)
)
part("cutd", "SELECT CAST(max(o_orderdate) AS DATE) - 90 AS cut FROM orders")
part(
    "cust",
    f"""SELECT c.c_custkey AS ID, 1940 + c.c_custkey % 60 AS Year_Birth, r_name AS Education,
  c_mktsegment AS Marital_Status,
  CASE WHEN c.c_custkey % 90 <> 0 THEN c_acctbal END AS Income,
  c.c_custkey % 3 AS Kidhome, CAST(c_nationkey % 2 AS BIGINT) AS Teenhome,
  strftime(first_order, '%d-%m-%Y') AS Dt_Customer, CAST(cut - last_order AS BIGINT) AS Recency,
  o.* EXCLUDE (o_custkey, first_order, last_order),
  l.* EXCLUDE (k),
  CASE WHEN c.c_custkey IN (SELECT o_custkey FROM orders, cutd WHERE CAST(o_orderdate AS DATE) > cut)
    THEN 1 ELSE 0 END AS Response
FROM customer c
JOIN (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS first_order,
    CAST(max(o_orderdate) AS DATE) AS last_order,
    count(*) FILTER (o_orderpriority = '1-URGENT') AS NumWebPurchases,
    count(*) FILTER (o_orderpriority = '2-HIGH') AS NumCatalogPurchases,
    count(*) FILTER (o_orderpriority = '3-MEDIUM') AS NumStorePurchases,
    count(*) FILTER (o_orderpriority = '4-NOT SPECIFIED') AS NumWebVisitsMonth,
    CAST(max(CAST(month(o_orderdate) = 1 AS INT)) AS BIGINT) AS AcceptedCmp1,
    CAST(max(CAST(month(o_orderdate) = 3 AS INT)) AS BIGINT) AS AcceptedCmp2,
    CAST(max(CAST(month(o_orderdate) = 5 AS INT)) AS BIGINT) AS AcceptedCmp3,
    CAST(max(CAST(month(o_orderdate) = 7 AS INT)) AS BIGINT) AS AcceptedCmp4,
    CAST(max(CAST(month(o_orderdate) = 9 AS INT)) AS BIGINT) AS AcceptedCmp5
  FROM orders, cutd WHERE CAST(o_orderdate AS DATE) <= cut GROUP BY o_custkey) o
  ON o.o_custkey = c.c_custkey
LEFT JOIN (SELECT o_custkey AS k, {_spend},
    count(*) FILTER (l_discount >= 0.07) AS NumDealsPurchases,
    CAST(coalesce(max(CAST(l_returnflag = 'R' AND l_discount >= 0.1 AS INT)), 0) AS BIGINT) AS Complain
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey, cutd
  WHERE CAST(o_orderdate AS DATE) <= cut GROUP BY o_custkey) l ON l.k = c.c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey, cutd""",
    "cutd",
)
_num0 = [c for c in NUMERIC_COLUMNS if c not in ("Age", "Customer_Tenure_Days")]
_zero = (*SPEND_COLUMNS, "NumDealsPurchases", "Complain")
part(
    "eng",
    "SELECT ID, Response, 2000 - Year_Birth AS Age, "
    "CAST(DATE '2001-12-31' - CAST(strptime(Dt_Customer, '%d-%m-%Y') AS DATE) AS BIGINT) "
    "AS Customer_Tenure_Days, "
    + ", ".join(f"coalesce({c}, 0) AS {c}" if c in _zero else c for c in _num0)
    + """, Education,
  CASE WHEN Marital_Status IN ('FURNITURE', 'MACHINERY') THEN 'Other' ELSE Marital_Status END
    AS Marital_Status FROM cust""",
    "cust",
)
part(
    "engs",
    """SELECT *, CASE WHEN rk <= round(n * 0.2) THEN 'test'
    WHEN rk <= round(n * (0.2 + 0.2)) THEN 'val' ELSE 'train' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY Response ORDER BY md5('7:' || ID), ID) AS rk,
    CAST(count(*) OVER (PARTITION BY Response) AS DOUBLE) AS n FROM eng)""",
    "eng",
)
part(
    "engl",
    "SELECT ID, split, name, value FROM (SELECT ID, split, unnest(["
    + ", ".join(f"{{'name': '{c}', 'value': CAST({c} AS DOUBLE)}}" for c in NUMERIC_COLUMNS)
    + "], recursive := true) FROM engs)",
    "engs",
)
part(
    "med",
    "SELECT name, quantile_cont(value, 0.5) AS median FROM engl WHERE split = 'train' GROUP BY name",
    "engl",
)
part(
    "filled",
    "SELECT ID, split, e.name, coalesce(value, median) AS value FROM engl e JOIN med m ON e.name = m.name",
    "engl",
    "med",
)
part(
    "bounds",
    """SELECT name, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM filled
WHERE split = 'train' AND name IN ('Income', 'Age') GROUP BY name""",
    "filled",
)
part(
    "wins",
    """SELECT ID, split, f.name, CASE WHEN lo IS NULL THEN value ELSE least(greatest(value, lo), hi) END
  AS value FROM filled f LEFT JOIN bounds b ON f.name = b.name""",
    "filled",
    "bounds",
)
part(
    "engm",
    """SELECT name, avg(value) AS mean,
  CASE WHEN stddev_pop(value) = 0 THEN 1.0 ELSE stddev_pop(value) END AS scale
FROM wins WHERE split = 'train' GROUP BY name""",
    "wins",
)
part(
    "hot",
    """SELECT ID, split, k || '_' || lv AS name, CAST(v = lv AS DOUBLE) AS value FROM (
  SELECT ID, split, 'Education' AS k, Education AS v FROM engs UNION ALL
  SELECT ID, split, 'Marital_Status', Marital_Status FROM engs) a
JOIN (SELECT DISTINCT 'Education' AS k2, Education AS lv FROM engs WHERE split = 'train' UNION
  SELECT DISTINCT 'Marital_Status', Marital_Status FROM engs WHERE split = 'train') b ON k = k2""",
    "engs",
)
part(
    "engz",
    """SELECT ID, split, w.name, (value - mean) / scale AS value FROM wins w JOIN engm m ON w.name = m.name
UNION ALL SELECT ID, split, name, value FROM hot""",
    "wins",
    "engm",
    "hot",
)
_freq = " + ".join(PURCHASE_COLUMNS)
_mon = " + ".join(SPEND_COLUMNS)
_ccons = {
    "rfm_R": "Recency",
    "rfm_F": f"({_freq})",
    "rfm_M": f"({_mon})",
    "price_sensitivity": f"NumDealsPurchases / greatest({_freq}, 1.0)",
    **{
        f"affinity_{f}": f"{c} / greatest({_mon}, 1.0)"
        for f, c in zip(("wines", "fruits", "meat", "fish", "sweet", "gold"), SPEND_COLUMNS, strict=True)
    },
}
part(
    "ccl",
    "SELECT ID, split, name, value FROM (SELECT ID, split, unnest(["
    + ", ".join(f"{{'name': '{c}', 'value': CAST({e} AS DOUBLE)}}" for c, e in _ccons.items())
    + "], recursive := true) FROM engs)",
    "engs",
)
