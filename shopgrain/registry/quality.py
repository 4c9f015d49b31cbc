"""Cleaning and data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import redact
from ..operators import clean, quality
from ..operators.customers import customer_features
from ..sources.tables import TRANSACTION_SCHEMA, read_table, transactions
from .base import CFG, CUST, TX, rounded

#: An order id starts with it, and the join of lines and orders deals them out by it.
_ORDER_KEY = ("l_orderkey",)
_ORDER = ["l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


def _raw(s, d, keep=()):
    """Transactions with the defects that cleaning repairs, derived from the rows themselves."""
    c = F.col
    tx = transactions(s, d, keep=keep)
    n = c("product_id").cast("bigint")
    return tx.withColumns({
        "order_date": F.when(n % 97 == 0, "not-a-date").otherwise(c("order_date").cast("string")),
        "category": F.when(n % 41 == 0, F.lit(None)).when(n % 3 == 0, F.lower("category")).when(n % 3 == 1, F.concat(F.lit("  "), "category", F.lit(" "))).otherwise(c("category")),
        "region": F.when(n % 43 == 0, F.lit("")).otherwise(c("region")),
        "returned": F.when(c("returned") == 1, F.when(n % 2 == 0, "Yes").otherwise(" Y")).otherwise(F.when(n % 2 == 0, "No").otherwise("0")),
        "quantity": F.when(n % 53 == 0, F.lit(None)).otherwise(c("quantity")),
        "price": F.when(n % 59 == 0, -c("price")).otherwise(c("price")),
        "total_amount": F.when(n % 61 == 0, F.lit(None)).otherwise(c("total_amount")),
    })


_RAW = TX + """, raw AS (SELECT order_id, customer_id, product_id,
  CASE WHEN p % 97 = 0 THEN NULL ELSE order_date END AS order_date,
  CASE WHEN p % 41 = 0 THEN 'Unknown' ELSE upper(left(category, 1)) || lower(substr(category, 2)) END AS category,
  CASE WHEN p % 43 = 0 THEN 'Unknown' ELSE array_to_string(list_transform(string_split(lower(region), ' '), lambda x: upper(left(x, 1)) || substr(x, 2)), ' ') END AS region,
  array_to_string(list_transform(string_split(lower(customer_gender), ' '), lambda x: upper(left(x, 1)) || substr(x, 2)), ' ') AS customer_gender,
  array_to_string(list_transform(string_split(lower(payment_method), ' '), lambda x: upper(left(x, 1)) || substr(x, 2)), ' ') AS payment_method,
  CASE WHEN p % 59 = 0 THEN -price ELSE price END AS price, discount, CASE WHEN p % 53 = 0 THEN NULL ELSE quantity END AS quantity,
  CASE WHEN p % 61 = 0 THEN NULL ELSE total_amount END AS total_amount, shipping_cost, profit_margin, customer_age, delivery_time_days, returned
  FROM (SELECT *, CAST(product_id AS BIGINT) AS p FROM tx)),
once AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY order_id
  ORDER BY price, discount, quantity, total_amount, shipping_cost, profit_margin, returned) AS rn FROM raw) WHERE rn = 1),
dated AS (SELECT * FROM once WHERE order_date IS NOT NULL)"""

def _users(s, d):
    return read_table(s, d, "events").select(F.col("user_id").cast("string").alias("customer_id"))


def _customers(s, d):
    return read_table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("customer_id"))


def _buyers(s, d):
    return read_table(s, d, "orders").select(F.col("o_custkey").cast("string").alias("customer_id"))


QUERIES = {
    "dedup_keep_first": lambda s, d: clean.dedup_keep_first(read_table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], _ORDER).select(
        "l_orderkey", "l_linenumber", *_ORDER[:3], "l_quantity"),
    "clean_transactions": lambda s, d: rounded(clean.clean_transactions(_raw(s, d, _ORDER_KEY), CFG, within=_ORDER_KEY), 4, exact=("price",)).drop("delivery_time_days"),
    "impute_stats": lambda s, d: clean.impute_stats(clean.parse_dates(_raw(s, d)), ["quantity", "discount"], ["payment_method", "region"]),
    "negative_money": lambda s, d: clean.negative_money_counts(_raw(s, d)),
    "schema_violations": lambda s, d: quality.schema_violations(_raw(s, d), TRANSACTION_SCHEMA).where("column_name <> 'delivery_time_days'"),
    "sanity_checks": lambda s, d: rounded(quality.sanity_checks(transactions(s, d), customer_features(transactions(s, d), CFG))),
    "missing_patterns": lambda s, d: rounded(quality.missing_patterns(_raw(s, d).select("category", "quantity", "total_amount", "delivery_time_days"))),
    "missingness_profile": lambda s, d: rounded(quality.missingness_profile(_raw(s, d).select("category", "quantity", "total_amount", "price"))),
    "imputation_plan": lambda s, d: rounded(quality.imputation_plan(
        quality.missingness_profile(_raw(s, d).select("category", "quantity", "total_amount", "price")), {"quantity", "total_amount", "price"})
        .select("column_name", "missing", "missing_pct", "strategy")),
    "missing_impact": lambda s, d: rounded(quality.missing_impact(_raw(s, d).select("order_id", "customer_id", "category", "quantity", "total_amount"))),
    "quality_score": lambda s, d: rounded(quality.quality_score(clean.parse_dates(_raw(s, d)).drop("delivery_time_days"), _raw(s, d), CFG)),
    "data_quality_report": lambda s, d: rounded(quality.data_quality_report(transactions(s, d))),
    "fingerprint": lambda s, d: quality.fingerprint(transactions(s, d, ["order_id", "total_amount"])).select("rows", "fingerprint"),
    "row_loss": lambda s, d: rounded(clean.row_loss(_raw(s, d), clean.parse_dates(_raw(s, d)), CFG)),
    "iqr_outliers": lambda s, d: rounded(quality.iqr_outliers(transactions(s, d, ["total_amount", "quantity", "discount", "shipping_cost"]),
                                         ["total_amount", "quantity", "discount", "shipping_cost"], CFG)),
    "key_overlap": lambda s, d: rounded(quality.key_overlap(_users(s, d), _customers(s, d))),
    "shared_keys": lambda s, d: quality.shared_keys(_users(s, d), _customers(s, d), "customer_id"),
    "leftover_keys": lambda s, d: quality.leftover_keys(_customers(s, d), _buyers(s, d), "customer_id"),
    "fraud_input_checks": lambda s, d: rounded(quality.fraud_input_checks(transactions(s, d), customer_features(transactions(s, d), CFG))),
    "cohort_input_checks": lambda s, d: rounded(quality.cohort_input_checks(
        transactions(s, d), customer_features(transactions(s, d), CFG), CFG, window=("1995-01-01", "2001-08-01"), today="2001-08-01")),
    "redact_pii": lambda s, d: read_table(s, d, "documents").select("doc_id", redact(F.col("text")).alias("text")),
}

_CHECK = "SELECT '{n}' AS check_name, CASE WHEN {ok} THEN 'PASS' ELSE '{bad}' END AS status, '{sev}' AS severity, CAST({v} AS DOUBLE) AS observed FROM {t}"


def _checks(items):
    return " UNION ALL ".join(
        _CHECK.format(n=n, sev=sev, bad="FAIL" if sev == "error" else "WARN", v=v, ok=ok, t=t) for n, sev, v, ok, t in items
    )


def _sum(cond):
    return f"count(*) FILTER (WHERE {cond})"


def _zero(n, sev, cond, t="tx"):
    v = _sum(cond)
    return (n, sev, v, f"{v} = 0", t)


_DUP_O = "(count(*) - count(DISTINCT order_id))"
_DUP_C = "(count(*) - count(DISTINCT customer_id))"
_SANITY = [
    ("null_columns", "warning", "1", "false", "(SELECT 1)"),
    _zero("positive_price", "error", "price <= 0"), _zero("discount_range", "error", "discount < 0 OR discount > 1"),
    _zero("positive_quantity", "error", "quantity <= 0"), _zero("positive_amount", "warning", "total_amount <= 0"),
    _zero("binary_returned", "error", "returned NOT IN (0, 1)"), _zero("age_range", "warning", "customer_age < 18 OR customer_age > 120"),
    _zero("amount_formula", "warning", "abs(total_amount - price * quantity * (1 - discount)) > 0.01"),
    _zero("extreme_margin", "warning", "profit_margin > total_amount * 10"),
    ("shipping_above_amount", "warning", _sum("shipping_cost > total_amount"), f"{_sum('shipping_cost > total_amount')} * 100.0 <= count(*) * 2.0", "tx"),
    ("unique_order_id", "error", _DUP_O, f"{_DUP_O} = 0", "tx"),
    _zero("recency_not_negative", "error", "recency_days < 0", "cust"), _zero("frequency_positive", "error", "frequency <= 0", "cust"),
    _zero("monetary_not_negative", "error", "monetary < 0", "cust"), _zero("loyalty_in_unit_range", "error", "loyalty_score < 0 OR loyalty_score > 1", "cust"),
    ("customer_tables_agree", "error", "count(*)", "count(*) = (SELECT count(DISTINCT customer_id) FROM tx)", "cust"),
    _zero("net_not_above_gross", "error", "net_monetary > monetary", "cust"),
    _zero("binary_last_return", "error", "last_order_was_return NOT IN (0, 1)", "cust"),
    _zero("preferred_age_range", "warning", "preferred_age < -1 OR preferred_age > 120 OR (preferred_age > 0 AND preferred_age < 18)", "cust"),
    ("unique_customer_id", "error", _DUP_C, f"{_DUP_C} = 0", "cust"),
]
_FRAUD_IN = [
    ("customer_overlap", "error", "100", "true", "(SELECT 1)"), _zero("key_nulls", "error", "order_id IS NULL"),
    _zero("binary_returned", "error", "returned NOT IN (0, 1)"), _zero("discount_range", "error", "discount < 0 OR discount > 1"),
    _zero("positive_amount", "error", "total_amount <= 0"), ("unique_order_id", "error", _DUP_O, f"{_DUP_O} = 0", "tx"),
]
_COHORT_IN = [
    ("customer_count", "error", "count(DISTINCT customer_id)", "true", "tx"), ("customers_known", "error", "0", "true", "(SELECT 1)"),
    _zero("no_future_dates", "error", "order_date > DATE '2001-08-01'"), _zero("binary_returned", "error", "returned NOT IN (0, 1)"),
    _zero("no_null_customers", "error", "customer_id IS NULL"), _zero("no_negative_amounts", "warning", "total_amount < 0"),
    ("date_window", "warning", "CAST(min(order_date) < DATE '1995-01-01' AS INTEGER) + CAST(max(order_date) > DATE '2001-08-01' AS INTEGER)",
     "min(order_date) >= DATE '1995-01-01' AND max(order_date) <= DATE '2001-08-01'", "tx"),
]
_NN = ["order_id", "customer_id", "product_id", "category", "region", "customer_gender", "payment_method", "price", "discount",
       "quantity", "total_amount", "shipping_cost", "profit_margin", "customer_age"]
_RAWNULL = TX + """, rawn AS (SELECT *, CAST(product_id AS BIGINT) AS p,
  CASE WHEN CAST(product_id AS BIGINT) % 41 = 0 THEN NULL ELSE category END AS c2,
  CASE WHEN CAST(product_id AS BIGINT) % 53 = 0 THEN NULL ELSE quantity END AS q2,
  CASE WHEN CAST(product_id AS BIGINT) % 61 = 0 THEN NULL ELSE total_amount END AS t2,
  CASE WHEN CAST(product_id AS BIGINT) % 59 = 0 THEN -price ELSE price END AS p2 FROM tx)"""
_NULLS = {"category": "c2", "quantity": "q2", "total_amount": "t2", "price": "p2"}


def _nn(col):
    src = _NULLS.get(col, col)
    return f"SELECT '{col}' AS column_name, 'not_null' AS rule, count(*) FILTER (WHERE {src} IS NULL) AS violations FROM rawn"


def _rule(col, rule, cond):
    return f"SELECT '{col}', '{rule}', count(*) FILTER (WHERE {cond}) FROM rawn"


_RULES = [("price", "ge_0", "p2 < 0"), ("discount", "ge_0", "discount < 0"), ("discount", "le_1", "discount > 1"), ("quantity", "ge_1", "q2 < 1"),
          ("total_amount", "ge_0", "t2 < 0"), ("shipping_cost", "ge_0", "shipping_cost < 0"), ("customer_age", "ge_18", "customer_age < 18")]
_PROF = ", prof AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {s} IS NULL) AS missing FROM rawn" for c, s in _NULLS.items()) + ")"
_OUT = """SELECT '{c}' AS column_name, round(q1, 6) AS q1, round(q3, 6) AS q3, round(lo, 6) AS lower, round(hi, 6) AS upper,
  count(*) FILTER (WHERE {c} < lo OR {c} > hi) AS outliers, round(count(*) FILTER (WHERE {c} < lo OR {c} > hi) * 100.0 / count(*), 6) AS outlier_pct,
  CAST(round(min({c}) FILTER (WHERE {c} < lo OR {c} > hi), 6) AS DOUBLE) AS outlier_min, CAST(round(max({c}) FILTER (WHERE {c} < lo OR {c} > hi), 6) AS DOUBLE) AS outlier_max
FROM tx, (SELECT q1, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (
  SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM tx)) GROUP BY q1, q3, lo, hi"""

ORACLES = {
    "dedup_keep_first": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS rn FROM lineitem) WHERE rn = 1""",
    "clean_transactions": f"""WITH {_RAW}, q AS (SELECT CAST(trunc(quantile_cont(CAST(quantity AS DOUBLE), 0.5)) AS INTEGER) AS mq, quantile_cont(total_amount, 0.5) AS mt FROM dated)
SELECT order_id, customer_id, product_id, order_date, category, region, customer_gender, payment_method, greatest(price, 0) AS price,
  round(discount, 4) AS discount, coalesce(quantity, mq) AS quantity, round(greatest(coalesce(total_amount, mt), 0), 4) AS total_amount,
  round(shipping_cost, 4) AS shipping_cost, round(profit_margin, 4) AS profit_margin, customer_age, returned FROM dated, q""",
    "impute_stats": f"""WITH {TX}, r AS (SELECT *, CAST(product_id AS BIGINT) AS p FROM tx WHERE CAST(product_id AS BIGINT) % 97 <> 0),
m AS (SELECT payment_method AS v FROM r GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
g AS (SELECT CASE WHEN p % 43 = 0 THEN '' ELSE region END AS v FROM r GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT 'quantity' AS column_name, printf('%.1f', quantile_cont(CAST(quantity AS DOUBLE), 0.5) FILTER (WHERE p % 53 <> 0)) AS fill_value, 'median' AS statistic, count(*) FILTER (WHERE p % 53 = 0) AS nulls FROM r
UNION ALL SELECT 'discount', CAST(quantile_cont(discount, 0.5) AS VARCHAR), 'median', 0 FROM r
UNION ALL SELECT 'payment_method', (SELECT v FROM m), 'mode', 0 UNION ALL SELECT 'region', (SELECT v FROM g), 'mode', 0""",
    "negative_money": f"""WITH {TX} SELECT 'total_amount' AS column_name, 0 AS negatives UNION ALL SELECT 'shipping_cost', 0
UNION ALL SELECT 'price', count(*) FROM tx WHERE CAST(product_id AS BIGINT) % 59 = 0 AND price > 0""",
    "schema_violations": f"WITH {_RAWNULL} " + " UNION ALL ".join([_nn(c) for c in _NN + ["order_date"]] + [_rule(*r) for r in _RULES]),
    "sanity_checks": f"WITH {CUST} " + _checks(_SANITY),
    "missing_patterns": f"""WITH {_RAWNULL}, f AS (SELECT concat_ws(',', CASE WHEN c2 IS NULL THEN 'category' END, CASE WHEN q2 IS NULL THEN 'quantity' END,
  CASE WHEN t2 IS NULL THEN 'total_amount' END, 'delivery_time_days') AS pattern FROM rawn)
SELECT pattern, count(*) AS rows, CAST(len(string_split(pattern, ',')) AS INTEGER) AS null_columns, round(count(*) * 100.0 / (SELECT count(*) FROM tx), 6) AS pct
FROM f GROUP BY pattern ORDER BY 2 DESC, 1 LIMIT 10""",
    "missingness_profile": f"""WITH {_RAWNULL}{_PROF}, t AS (SELECT count(*) AS n, count(*) FILTER (WHERE c2 IS NULL OR q2 IS NULL OR t2 IS NULL) AS a FROM rawn)
SELECT column_name, missing, n AS rows, round(missing * 100.0 / n, 6) AS missing_pct, round(100 - a * 100.0 / n, 6) AS complete_rows_pct,
  round(100 - (SELECT sum(missing) FROM prof) * 100.0 / (n * 4), 6) AS complete_cells_pct FROM prof, t""",
    "imputation_plan": f"""WITH {_RAWNULL}{_PROF} SELECT column_name, missing, round(missing * 100.0 / (SELECT count(*) FROM tx), 6) AS missing_pct,
  'PREDICTIVE_IMPUTATION' AS strategy FROM prof WHERE missing > 0""",
    "missing_impact": f"""WITH {_RAWNULL} SELECT CAST(max(CASE WHEN t2 IS NULL THEN 1 ELSE 0 END) AS INTEGER) AS critical_columns_affected,
  round(count(*) FILTER (WHERE c2 IS NULL OR q2 IS NULL OR t2 IS NULL) * 100.0 / count(*), 6) AS potential_data_loss_pct, 'CRITICAL' AS priority FROM rawn""",
    "quality_score": f"""WITH {_RAWNULL}, k AS (SELECT * FROM rawn WHERE p % 97 <> 0), a AS (SELECT count(*) AS f, (SELECT count(*) FROM tx) AS i,
  count(*) FILTER (WHERE c2 IS NULL) + count(*) FILTER (WHERE q2 IS NULL) + count(*) FILTER (WHERE t2 IS NULL) AS nulls,
  count(*) FILTER (WHERE p2 < 0) + count(*) FILTER (WHERE discount < 0 OR discount > 1) + count(*) FILTER (WHERE q2 <= 0) AS violations FROM k),
b AS (SELECT *, (1 - nulls / (f * 16)) * 100 AS completeness, (1 - violations / f) * 100 AS compliance_rate, f / i * 100 AS retention_rate FROM a)
SELECT f AS final_rows, violations, i AS initial_rows, round(completeness, 6) AS completeness, round(compliance_rate, 6) AS compliance_rate,
  round(retention_rate, 6) AS retention_rate, i - f AS rows_removed,
  round(completeness / 100 * 40 + compliance_rate / 100 * 30 + retention_rate / 100 * 30, 6) AS quality_score FROM b""",
    "data_quality_report": f"""WITH {TX} SELECT count(*) AS rows, count(*) AS null_cells, min(order_date) AS first_date, max(order_date) AS last_date,
  round(sum(amt) / 10000.0, 6) AS total_revenue, round(avg(returned) * 100, 6) AS return_rate,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM tx)) AS duplicate_rows, 17 AS columns, count(DISTINCT customer_id) AS customers,
  count(DISTINCT product_id) AS products, CAST(max(order_date) - min(order_date) AS INTEGER) AS span_days,
  CASE WHEN count(*) = (SELECT count(*) FROM (SELECT DISTINCT * FROM tx)) THEN 90 ELSE 80 END AS score FROM tx""",
    "fingerprint": f"""WITH {TX} SELECT count(*) AS rows, substr(md5(concat_ws('_', count(*), printf('%.2f', sum(amt) / 10000.0), printf('%.2f', min(total_amount)),
  printf('%.2f', max(total_amount)))), 1, 8) AS fingerprint FROM tx""",
    "row_loss": f"""WITH {TX}, a AS (SELECT count(*) AS b, count(*) FILTER (WHERE CAST(product_id AS BIGINT) % 97 <> 0) AS k FROM tx)
SELECT k AS rows_after, b AS rows_before, round((b - k) * 100.0 / b, 6) AS loss_pct, (b - k) * 100.0 / b > 5 AS too_much FROM a""",
    "iqr_outliers": f"WITH {TX} " + " UNION ALL ".join(_OUT.format(c=c) for c in ("total_amount", "quantity", "discount", "shipping_cost")),
    "key_overlap": """WITH a AS (SELECT DISTINCT user_id AS k FROM events), b AS (SELECT DISTINCT c_custkey AS k FROM customer),
s AS (SELECT (SELECT count(*) FROM a) AS l, (SELECT count(*) FROM b) AS r, (SELECT count(*) FROM a JOIN b USING (k)) AS m)
SELECT l AS left_keys, r AS right_keys, m AS shared, l - m AS left_only, r - m AS right_only, round(m * 100.0 / l, 6) AS overlap_pct FROM s""",
    "shared_keys": "SELECT CAST(user_id AS VARCHAR) AS customer_id FROM events INTERSECT SELECT CAST(c_custkey AS VARCHAR) FROM customer",
    "leftover_keys": "SELECT CAST(c_custkey AS VARCHAR) AS customer_id FROM customer EXCEPT SELECT CAST(o_custkey AS VARCHAR) FROM orders",
    "fraud_input_checks": f"WITH {TX} " + _checks(_FRAUD_IN),
    "cohort_input_checks": f"WITH {TX} " + _checks(_COHORT_IN),
    "redact_pii": r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'C\d{5}', '[REDACTED_CUSTOMER_ID]', 'g'),
  '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b', '[REDACTED_EMAIL]', 'g'), '\b\d{3}[-.]?\d{3}[-.]?\d{4}\b', '[REDACTED_PHONE]', 'g'),
  '\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b', '[REDACTED_CC]', 'g') AS text FROM documents""",
}
