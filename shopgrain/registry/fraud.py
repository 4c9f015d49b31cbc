"""Risk-feature and churn-dataset queries without model fits."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import churn as ch
from ..operators import fraud as op
from ..operators import segments as sg
from ..operators.customers import customer_features
from ..session import materialized
from ..sources.tables import read_table, transactions
from .base import CFG, CUST, TX, rounded
from .segments import SEG, TIER_CTE


#: Lines of a part of the written transactions, about.
_PART_LINES = 100_000
_TX_COLUMNS = ("order_id", "customer_id", "order_date", "category", "region", "customer_gender", "payment_method", "discount", "quantity", "total_amount", "profit_margin", "customer_age", "returned")


def _tx(s, d, *more):
    """The transactions written once, as the risk features and what is joined to them read them several times: their joins shuffle all lines.

    A customer's lines lie together, so that each later aggregate by customer hands on one partial state for a customer and not one for nearly every line. Parts are small enough for Spark to
    leave them whole; it splits those with a customer of very many lines.
    """
    parts = max(int(s.conf.get("spark.sql.shuffle.partitions")), read_table(s, d, "lineitem").count() // _PART_LINES)
    return materialized(transactions(s, d, [*_TX_COLUMNS, *more]).hint("rebalance", parts, F.col("customer_id")))


def _features(s, d, tx=None, cust=None):
    tx = _tx(s, d) if tx is None else tx
    return materialized(op.fraud_features(tx, customer_features(tx, CFG) if cust is None else cust, CFG))


def _scored(s, d, tx=None, cust=None):
    """Rule scores with tiers on the normalised rule score, and typologies."""
    r = op.rule_scores(_features(s, d, tx, cust), CFG).withColumn("composite_fraud_score", F.col("rule_fraud_score_norm"))
    return op.typology(op.assign_risk_tiers(r, CFG), CFG)


def _segments(s, d, cust=None):
    seg = sg.rfm_segments(sg.rfm_scores(customer_features(transactions(s, d), CFG) if cust is None else cust))
    return seg.select("customer_id", F.col("rfm_segment").alias("segment_name"))


def _pred(s, d, tx=None):
    """A deterministic score in place of a model's: the return rate at the cutoff."""
    f = _cutoff(s, d, tx)
    return f.select("customer_id", "churn", "monetary", F.col("return_rate").alias("churn_probability"))


def _cutoff(s, d, tx=None):
    tx = transactions(s, d, ["customer_id", "order_id", "order_date", "total_amount", "returned", "discount", "category"]) if tx is None else tx
    return ch.cutoff_features(tx, ch.resolve_cutoff(tx, CFG), CFG)


def _merged(s, d):
    tx = _tx(s, d)
    cust = customer_features(tx, CFG)
    return op.join_risk_labels(_scored(s, d, tx, cust), _segments(s, d, cust), ch.risk_levels(_pred(s, d, tx), CFG))


def _exposure(s, d):
    tx = _tx(s, d, "price")
    return op.exposure(tx, _scored(s, d, tx))


def _event_days(s, d):
    e = read_table(s, d, "events")
    return e.select(F.col("user_id").cast("string").alias("customer_id"), F.col("ts").cast("date").alias("order_date"))


_RULE_COLS = [f"score_{r[0]}" for r in op.RULES]
_FLAGS = ["type_return_abuser", "type_discount_exploiter", "type_velocity", "type_margin_exploiter", "type_high_value", "typology_count", "type_combined", "primary_typology"]
_TIERF = ["return_rate", "max_orders_7d", "category_hhi"]

_FEATCOLS = [
    "avg_order_value", "max_order_value", "min_order_value", "total_revenue", "avg_quantity", "order_value_cv", "return_rate", "returned_value", "high_discount_return_rate",
    "discount_usage_rate", "max_discount_rate", "avg_discount", "max_discount", "high_value_rate_p95", "high_value_rate_p99", "negative_margin_rate", "avg_profit_margin",
    "min_profit_margin", "gap_cv", "category_hhi", "payment_concentration", "order_rate_per_day", "aov_zscore", "monetary", "loyalty_score"]
_FEATINT = ["customer_id", "order_count", "max_quantity", "tenure_days", "high_value_orders_p99", "max_orders_7d", "max_orders_30d", "min_order_gap_days", "velocity_burst_flag",
            "n_payment_methods", "always_max_discount", "all_negative_margins", "recency_days", "frequency"]
# Features with a square root or a mean of means; the others are single quotients of exact sums.
_NOISY = ("order_value_cv", "gap_cv", "aov_zscore", "loyalty_score")

QUERIES = {
    "fraud_features": lambda s, d: rounded(_features(s, d), exact=tuple(c for c in _FEATCOLS if c not in _NOISY)),
    "velocity": lambda s, d: rounded(op.velocity(transactions(s, d, ["customer_id", "order_date"]), CFG)),
    "velocity_events": lambda s, d: rounded(op.velocity(_event_days(s, d), CFG)),
    "hhi": lambda s, d: rounded(op.concentration(transactions(s, d, ["customer_id", "category", "payment_method"]))),
    "amount_thresholds": lambda s, d: rounded(op.amount_thresholds(transactions(s, d, ["total_amount"]))),
    "rule_scores": lambda s, d: op.rule_scores(_features(s, d), CFG).select("customer_id", *_RULE_COLS, "rule_fraud_score", "rule_fraud_score_norm"),
    "rule_contributions": lambda s, d: rounded(op.rule_contributions(op.rule_scores(_features(s, d), CFG))),
    "rule_score_histogram": lambda s, d: op.score_histogram(op.rule_scores(_features(s, d), CFG)),
    "risk_tiers": lambda s, d: _scored(s, d).select("customer_id", "risk_tier"),
    "typology": lambda s, d: _scored(s, d).select("customer_id", *_FLAGS),
    "exposure": lambda s, d: rounded(_exposure(s, d), 3),
    "tier_crosstab": lambda s, d: rounded(op.crosstab(_merged(s, d), "segment_name", "risk_tier")),
    "segment_fraud": lambda s, d: op.segment_fraud(_merged(s, d)),
    "tier_profile": lambda s, d: rounded(op.tier_profile(_scored(s, d), _TIERF)),
    "feature_summary": lambda s, d: rounded(op.feature_summary(_features(s, d), _TIERF + ["order_value_cv"]), 4),
    "top_risk_customers": lambda s, d: rounded(op.top_risk_customers(_scored(s, d), _TIERF, 50)),
    "interventions": lambda s, d: rounded(op.interventions(_scored(s, d)), 4),
    "high_risk_transactions": lambda s, d: op.high_risk_transactions(transactions(s, d, ["order_id", "customer_id"]), _scored(s, d)),
    "min_max_features": lambda s, d: rounded(op.min_max(_features(s, d).select("customer_id", "order_value_cv", "return_rate"), ["order_value_cv", "return_rate"])),
    "cutoff_features": lambda s, d: rounded(_cutoff(s, d), exact=("avg_order_value",)),
    "recency_at_cutoff": lambda s, d: ch.recency_at_cutoff(transactions(s, d, ["customer_id", "order_date"]), dt.date(2001, 2, 2)),
    "churn_labels": lambda s, d: ch.churn_labels(
        ch.with_history(transactions(s, d, ["customer_id"]).distinct(), transactions(s, d, ["customer_id", "order_date"]), dt.date(2001, 2, 2)),
        transactions(s, d, ["customer_id", "order_date"]), dt.date(2001, 2, 2)),
    "risk_tiers_quantile": lambda s, d: rounded(ch.risk_levels(_pred(s, d), CFG).select("customer_id", "churn_probability", "risk_level")),
    "risk_summary": lambda s, d: rounded(ch.risk_summary(ch.risk_levels(_pred(s, d), CFG))),
    "campaign_sizing": lambda s, d: rounded(ch.campaign_sizing(ch.risk_levels(_pred(s, d), CFG)), 3),
    "campaign_mix": lambda s, d: rounded(ch.campaign_mix(ch.risk_levels(_pred(s, d), CFG), _segments(s, d))),
    "segment_churn": lambda s, d: rounded(ch.segment_churn(_cutoff(s, d).select("customer_id", "churn"), _segments(s, d))),
    "stratified_split": lambda s, d: ch.stratified_split(_cutoff(s, d), cfg=CFG).select("customer_id", "churn", "is_train"),
    "churn_dataset": lambda s, d: rounded(ch.churn_dataset(transactions(s, d), CFG, "all"), exact=("avg_order_value",)),
}

_VEL = """vday AS (SELECT customer_id, CAST(order_date - DATE '1970-01-01' AS BIGINT) AS day FROM {src}),
vwin AS (SELECT customer_id, day, count(*) OVER (PARTITION BY customer_id ORDER BY day RANGE BETWEEN CURRENT ROW AND 7 FOLLOWING) AS w7,
  count(*) OVER (PARTITION BY customer_id ORDER BY day RANGE BETWEEN CURRENT ROW AND 30 FOLLOWING) AS w30,
  day - lag(day) OVER (PARTITION BY customer_id ORDER BY day) AS gap FROM vday),
vel AS (SELECT customer_id, max(w7) AS max_orders_7d, max(w30) AS max_orders_30d,
  CASE WHEN count(*) > 2 AND sum(gap) > 0 THEN stddev_samp(gap) / avg(gap) ELSE 0.0 END AS gap_cv, coalesce(min(gap), 0) AS min_order_gap_days,
  CAST(max(w7) >= 3 AS INTEGER) AS velocity_burst_flag FROM vwin GROUP BY 1)"""
_HHI = """cc AS (SELECT customer_id, category, count(*) AS n FROM tx GROUP BY 1, 2), pc AS (SELECT customer_id, payment_method, count(*) AS n FROM tx GROUP BY 1, 2),
hhi AS (SELECT customer_id, h AS category_hhi, k AS n_payment_methods, p AS payment_concentration FROM
  (SELECT customer_id, sum(n * n) / (sum(n) * sum(n)) AS h FROM cc GROUP BY 1) JOIN
  (SELECT customer_id, count(*) AS k, max(n) / sum(n) AS p FROM pc GROUP BY 1) USING (customer_id))"""
_FEAT = f"""{CUST}, {_VEL.format(src='tx')}, {_HHI},
thr AS (SELECT quantile_cont(total_amount, 0.95) AS p95, quantile_cont(total_amount, 0.99) AS p99 FROM tx),
fb AS (SELECT customer_id, count(*) AS order_count, sum(amt) / 10000.0 / count(*) AS avg_order_value, max(total_amount) AS max_order_value, min(total_amount) AS min_order_value,
  sum(amt) / 10000.0 AS total_revenue, avg(quantity) AS avg_quantity, max(quantity) AS max_quantity,
  CAST(greatest(max(order_date) - min(order_date), 1) AS INTEGER) AS tenure_days, coalesce(stddev_samp(total_amount) / avg(total_amount), 0) AS order_value_cv,
  avg(returned) AS return_rate, coalesce(sum(amt) FILTER (WHERE returned = 1), 0) / 10000.0 AS returned_value,
  coalesce(avg(returned) FILTER (WHERE discount >= 0.08), 0) AS high_discount_return_rate, avg(CASE WHEN discount > 0 THEN 1 ELSE 0 END) AS discount_usage_rate,
  avg(CASE WHEN discount >= 0.1 THEN 1 ELSE 0 END) AS max_discount_rate, CAST(sum(CAST(round(discount * 10000) AS BIGINT)) AS DOUBLE) / 10000 / count(*) AS avg_discount, max(discount) AS max_discount,
  count(*) FILTER (WHERE total_amount >= p99) AS high_value_orders_p99, avg(CASE WHEN total_amount >= p95 THEN 1 ELSE 0 END) AS high_value_rate_p95,
  avg(CASE WHEN total_amount >= p99 THEN 1 ELSE 0 END) AS high_value_rate_p99, avg(CASE WHEN profit_margin < 0 THEN 1 ELSE 0 END) AS negative_margin_rate,
  CAST(sum(CAST(round(profit_margin * 10000) AS BIGINT)) AS DOUBLE) / 10000 / count(*) AS avg_profit_margin, min(profit_margin) AS min_profit_margin FROM tx, thr GROUP BY 1),
feat AS (SELECT fb.*, vel.* EXCLUDE (customer_id), hhi.* EXCLUDE (customer_id), order_count / tenure_days AS order_rate_per_day,
  CAST(max_discount_rate >= 0.8 AS INTEGER) AS always_max_discount, CAST(negative_margin_rate >= 1 AS INTEGER) AS all_negative_margins,
  (fb.avg_order_value - avg(fb.avg_order_value) OVER ()) / stddev_pop(fb.avg_order_value) OVER () AS aov_zscore,
  coalesce(recency_days, 0) AS recency_days, coalesce(frequency, 0) AS frequency, coalesce(monetary, 0) AS monetary, coalesce(loyalty_score, 0) AS loyalty_score
  FROM fb JOIN vel USING (customer_id) JOIN hhi USING (customer_id) LEFT JOIN (SELECT customer_id, recency_days, frequency, monetary, loyalty_score FROM cust) USING (customer_id))"""


def _part(name, feature, thr, weight, floor):
    limit, w = getattr(CFG.fraud, thr), getattr(CFG.fraud, weight)
    return f"least(greatest(({feature} - {floor}) / {limit - floor}, 0), 1) * {w} AS score_{name}"


_RS = f"""{_FEAT}, parts AS (SELECT *, {', '.join(_part(*r) for r in op.RULES)} FROM feat),
summed AS (SELECT *, {' + '.join(_RULE_COLS)} AS rule_fraud_score FROM parts),
rs AS (SELECT *, rule_fraud_score / max(rule_fraud_score) OVER () AS rule_fraud_score_norm FROM summed),
flg AS (SELECT *, CASE WHEN rule_fraud_score_norm >= 0.8 THEN 'Critical' WHEN rule_fraud_score_norm >= 0.6 THEN 'High' WHEN rule_fraud_score_norm >= 0.35 THEN 'Medium' ELSE 'Low' END AS risk_tier,
  CAST(return_rate >= 0.2 AS INTEGER) AS type_return_abuser, CAST(max_discount_rate >= 0.8 AND avg_discount > 0.15 AS INTEGER) AS type_discount_exploiter,
  velocity_burst_flag AS type_velocity, CAST(negative_margin_rate >= 0.5 AS INTEGER) AS type_margin_exploiter, CAST(high_value_rate_p99 > 0.2 AS INTEGER) AS type_high_value FROM rs),
prf0 AS (SELECT *, type_return_abuser + type_discount_exploiter + type_velocity + type_margin_exploiter + type_high_value AS typology_count FROM flg),
prf AS (SELECT *, CAST(typology_count >= 3 AS INTEGER) AS type_combined, CASE WHEN typology_count >= 3 THEN 'Combined Attack' WHEN type_return_abuser = 1 THEN 'Return Abuse'
  WHEN type_discount_exploiter = 1 THEN 'Discount Exploitation' WHEN type_velocity = 1 THEN 'Velocity Anomaly' WHEN type_margin_exploiter = 1 THEN 'Margin Exploitation'
  WHEN type_high_value = 1 THEN 'High-Value Anomaly' ELSE 'Unclassified' END AS primary_typology FROM prf0)"""

_CUT = """cd AS (SELECT max(order_date) - 180 AS c FROM tx),
pc0 AS (SELECT customer_id, count(*) FILTER (WHERE order_date <= c) AS hist, max(order_date) FILTER (WHERE order_date <= c) AS lastd, min(order_date) FILTER (WHERE order_date <= c) AS firstd,
  max(c) AS c, 1 - max(CASE WHEN order_date > c THEN 1 ELSE 0 END) AS churn FROM tx, cd GROUP BY 1),
lb AS (SELECT tx.* FROM tx, cd WHERE order_date <= c AND order_date >= c - 365),
la AS (SELECT customer_id, count(*) AS f, max(order_date) AS r, sum(amt) / 10000.0 AS m, coalesce(sum(amt) FILTER (WHERE returned = 1), 0) / 10000.0 AS b, count(DISTINCT category) AS div,
  avg(returned) AS rr, arg_max(returned, (order_date, order_id)) AS lr, avg(CASE WHEN discount > 0 THEN 1 ELSE 0 END) AS du FROM lb GROUP BY 1),
cf AS (SELECT customer_id, coalesce(f, 0) AS frequency, CAST(c - firstd AS INTEGER) AS tenure_days, CAST(c - lastd AS INTEGER) AS recency_days, CAST(c - r AS INTEGER) AS _recent,
  coalesce(m, 0) AS monetary, coalesce(div, 0) AS category_diversity, coalesce(rr, 0) AS return_rate, coalesce(lr, 0) AS last_order_was_return, coalesce(du, 0) AS discount_usage_rate,
  churn, coalesce(m, 0) - coalesce(b, 0) AS net_monetary, m / f AS avg_order_value FROM pc0 LEFT JOIN la USING (customer_id) WHERE hist >= 1),
qc AS (SELECT quantile_cont(return_rate, 0.33) AS lo, quantile_cont(return_rate, 0.67) AS hi FROM cf),
rk AS (SELECT customer_id, churn, monetary, return_rate AS churn_probability, CASE WHEN return_rate <= lo THEN 'Low' WHEN return_rate <= hi THEN 'Medium' ELSE 'High' END AS risk_level FROM cf, qc)"""
_SEGNM = SEG[len(CUST):]
_MERGED = f"{_RS}{_SEGNM}, {_CUT}, mg AS (SELECT prf.customer_id, rule_fraud_score_norm AS sc, risk_tier, rfm_segment AS segment_name, churn_probability, risk_level FROM prf JOIN seg USING (customer_id) LEFT JOIN rk USING (customer_id))"
_FS = "SELECT '{c}' AS feature, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round({c}_s, 4) AS skewness, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS median, round(quantile_cont(CAST({c} AS DOUBLE), 0.95), 4) AS p95"


def _summary(c):
    return f"""SELECT '{c}' AS feature, round(max(mu), 4) AS mean, round(stddev_samp({c}), 4) AS std,
  round(avg(pow({c} - mu, 3)) / pow(sqrt(avg(pow({c} - mu, 2))), 3), 4) AS skewness, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS median,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.95), 4) AS p95 FROM feat, (SELECT avg({c}) AS mu FROM feat)"""


_EXP = """h AS (SELECT customer_id, risk_tier IN ('Critical', 'High') AS hot FROM prf),
e AS (SELECT hot, CASE WHEN returned = 1 THEN amt ELSE 0 END AS r, CASE WHEN returned = 0 AND discount > 0 THEN CAST(round(price * quantity * discount * 10000) AS BIGINT) ELSE 0 END AS d,
  CASE WHEN returned = 0 AND discount = 0 AND profit_margin < 0 THEN CAST(round(-profit_margin * 10000) AS BIGINT) ELSE 0 END AS m, amt,
  returned = 1 AND discount > 0 AS o1, returned = 1 AND profit_margin < 0 AS o2, returned = 0 AND discount > 0 AND profit_margin < 0 AS o3 FROM tx JOIN h USING (customer_id))"""

_SPLIT = f"""hs AS (SELECT *, 1.0 / (coalesce(recency_days, 999) + 1)::DOUBLE AS inv, ('0x' || substr(md5(customer_id || ':{CFG.churn.seed}'), 1, 12))::BIGINT AS h FROM cf),
rh AS (SELECT *, rank() OVER (PARTITION BY churn ORDER BY h) + count(*) OVER (PARTITION BY churn, h) - 1 AS upto, count(*) OVER (PARTITION BY churn) AS total FROM hs),
sp AS (SELECT *, upto > floor(total * {CFG.churn.test_size}) AS is_train FROM rh)"""

ORACLES = {
    "fraud_features": f"WITH {_FEAT} SELECT {', '.join(_FEATINT)}, {', '.join(f'round({c}, 6) AS {c}' if c in _NOISY else c for c in _FEATCOLS)} FROM feat",
    "velocity": f"WITH {TX}, {_VEL.format(src='tx')} SELECT * EXCLUDE (gap_cv), round(gap_cv, 6) AS gap_cv FROM vel",
    "velocity_events": f"WITH ev AS (SELECT CAST(user_id AS VARCHAR) AS customer_id, CAST(ts AS DATE) AS order_date FROM events), {_VEL.format(src='ev')} SELECT * EXCLUDE (gap_cv), round(gap_cv, 6) AS gap_cv FROM vel",
    "hhi": f"WITH {TX}, {_HHI} SELECT customer_id, round(category_hhi, 6) AS category_hhi, n_payment_methods, round(payment_concentration, 6) AS payment_concentration FROM hhi",
    "amount_thresholds": f"WITH {TX} SELECT round(quantile_cont(total_amount, 0.95), 6) AS p95, round(quantile_cont(total_amount, 0.99), 6) AS p99 FROM tx",
    "rule_scores": f"WITH {_RS} SELECT customer_id, {', '.join(_RULE_COLS)}, rule_fraud_score, rule_fraud_score_norm FROM rs",
    "rule_contributions": f"WITH {_RS} " + " UNION ALL ".join(f"SELECT '{c}' AS rule, round(avg({c}), 6) AS mean_score FROM rs" for c in _RULE_COLS),
    "rule_score_histogram": f"WITH {_RS} SELECT CAST(least(floor(rule_fraud_score_norm * 5), 4) AS INTEGER) AS bin, count(*) AS customers FROM rs GROUP BY 1",
    "risk_tiers": f"WITH {_RS} SELECT customer_id, risk_tier FROM prf",
    "typology": f"WITH {_RS} SELECT customer_id, {', '.join(_FLAGS)} FROM prf",
    "exposure": f"""WITH {_RS}, {_EXP}, a AS (SELECT sum(r) FILTER (WHERE hot) AS rh, sum(d) FILTER (WHERE hot) AS dh, sum(m) FILTER (WHERE hot) AS mh, sum(amt) FILTER (WHERE hot) AS ah,
  sum(r) AS ra, sum(d) AS da, sum(m) AS ma, sum(amt) AS aa, count(*) FILTER (WHERE hot AND o1) AS c1, count(*) FILTER (WHERE hot AND o2) AS c2, count(*) FILTER (WHERE hot AND o3) AS c3 FROM e),
k AS (SELECT count(*) FILTER (WHERE hot) AS n, count(*) AS t FROM h)
SELECT n AS high_risk_customers, round(n * 100.0 / t, 3) AS high_risk_pct, round(coalesce(ah, 0) / 10000.0, 3) AS revenue_high_risk, round(coalesce(ah, 0) * 100 / aa, 3) AS revenue_high_risk_pct,
  round(coalesce(rh, 0) / 10000.0, 3) AS return_exposure_high_risk, round(coalesce(dh, 0) / 10000.0, 3) AS discount_exposure_high_risk, round(coalesce(mh, 0) / 10000.0, 3) AS neg_margin_exposure_high_risk,
  round(ra / 10000.0, 3) AS return_exposure_all, round(da / 10000.0, 3) AS discount_exposure_all, round(ma / 10000.0, 3) AS neg_margin_exposure_all,
  c1 AS overlap_return_discount, c2 AS overlap_return_negmargin, c3 AS overlap_discount_negmargin, round(coalesce(rh + dh + mh, 0) / 10000.0, 3) AS total_exposure_high_risk,
  round((ra + da + ma) / 10000.0, 3) AS total_exposure_all, c1 + c2 + c3 AS total_overlap_orders FROM a, k""",
    "tier_crosstab": f"""WITH {_MERGED}, g AS (SELECT coalesce(segment_name, 'All') AS segment_name, coalesce(risk_tier, 'All') AS risk_tier, count(*) AS customers FROM mg GROUP BY CUBE (mg.segment_name, mg.risk_tier))
SELECT *, round(customers * 100.0 / max(customers) FILTER (WHERE risk_tier = 'All') OVER (PARTITION BY segment_name), 6) AS row_pct FROM g""",
    "segment_fraud": f"""WITH {_MERGED} SELECT segment_name, count(*) AS customers, round(avg(sc), 4) AS avg_fraud_score,
  round(avg(CASE WHEN risk_tier IN ('Critical', 'High') THEN 1 ELSE 0 END) * 100, 4) AS high_critical_pct, round(avg(churn_probability), 4) AS avg_churn_prob,
  count(*) FILTER (WHERE risk_tier IN ('Critical', 'High') AND risk_level = 'High') AS double_risk_count FROM mg GROUP BY 1""",
    "tier_profile": f"""WITH {_RS}, g AS (SELECT risk_tier, count(*) AS customers, {', '.join(f'avg({c}) AS avg_{c}' for c in _TIERF)} FROM prf GROUP BY 1)
SELECT risk_tier, customers, round(customers * 100.0 / sum(customers) OVER (), 6) AS pct, {', '.join(f'round(avg_{c}, 6) AS avg_{c}, round(avg_{c} / max(avg_{c}) OVER (), 6) AS radar_{c}' for c in _TIERF)} FROM g""",
    "feature_summary": f"WITH {_FEAT} " + " UNION ALL ".join(_summary(c) for c in _TIERF + ["order_value_cv"]),
    "top_risk_customers": f"""WITH {_RS}, t AS (SELECT * FROM prf ORDER BY rule_fraud_score_norm DESC, customer_id LIMIT 50)
SELECT customer_id, round(rule_fraud_score_norm, 6) AS composite_fraud_score, {', '.join(f'round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), 6) AS {c}' for c in _TIERF)} FROM t""",
    "interventions": f"""WITH {_RS}, dim(risk_tier, action, review_hours) AS (VALUES ('Critical', 'manual_verification', 24), ('High', 'priority_review', 72), ('Medium', 'enhanced_monitoring', 168))
SELECT risk_tier, primary_typology, count(*) AS customers, round(avg(rule_fraud_score_norm), 4) AS avg_score, action, review_hours FROM prf JOIN dim USING (risk_tier) GROUP BY 1, 2, 5, 6""",
    "high_risk_transactions": f"WITH {_RS} SELECT order_id, customer_id FROM tx WHERE customer_id IN (SELECT customer_id FROM prf WHERE risk_tier IN ('Critical', 'High'))",
    "min_max_features": f"""WITH {_FEAT} SELECT customer_id, {', '.join(f'round({c}, 6) AS {c}, round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), 6) AS {c}_scaled' for c in ('order_value_cv', 'return_rate'))} FROM feat""",
    "cutoff_features": f"""WITH {TX}, {_CUT} SELECT customer_id, frequency, tenure_days, recency_days, _recent, round(monetary, 6) AS monetary, category_diversity, round(return_rate, 6) AS return_rate,
  last_order_was_return, round(discount_usage_rate, 6) AS discount_usage_rate, churn, round(net_monetary, 6) AS net_monetary, avg_order_value FROM cf""",
    "recency_at_cutoff": f"WITH {TX} SELECT customer_id, CAST(DATE '2001-02-02' - max(order_date) AS INTEGER) AS recency_days FROM tx WHERE order_date <= DATE '2001-02-02' GROUP BY 1",
    "churn_labels": f"""WITH {TX} SELECT customer_id, CASE WHEN max(order_date) > DATE '2001-02-02' THEN 0 ELSE 1 END AS churn FROM tx GROUP BY 1 HAVING min(order_date) <= DATE '2001-02-02'""",
    "risk_tiers_quantile": f"WITH {TX}, {_CUT} SELECT customer_id, round(churn_probability, 6) AS churn_probability, risk_level FROM rk",
    "risk_summary": f"WITH {TX}, {_CUT} SELECT risk_level, count(*) AS customers, round(avg(churn_probability), 6) AS avg_probability, round(avg(churn), 6) AS actual_churn, round(sum(monetary), 6) AS revenue FROM rk GROUP BY 1",
    "campaign_sizing": f"""WITH {TX}, {_CUT}, g AS (SELECT risk_level, count(*) AS customers, sum(CAST(round(monetary * 10000) AS BIGINT)) / 10000.0 AS rev, CASE risk_level WHEN 'High' THEN 0.3 WHEN 'Medium' THEN 0.5 ELSE 0.85 END::DOUBLE AS k FROM rk GROUP BY 1)
SELECT risk_level, customers, round(rev, 3) AS revenue_at_risk, round(rev / customers, 3) AS avg_revenue, round(rev * k, 3) AS expected_saved, round(rev * 0.1::DOUBLE, 3) AS campaign_cost,
  round(rev * k - rev * 0.1::DOUBLE, 3) AS net_benefit FROM g""",
    "stratified_split": f"WITH {TX}, {_CUT}, {_SPLIT} SELECT customer_id, churn, is_train FROM sp",
    "churn_dataset": f"""WITH {TX}, {_CUT}, {_SPLIT},
e AS (SELECT min(inv) AS ri, max(inv) - min(inv) AS rd, min(frequency) AS fi, max(frequency) - min(frequency) AS fd, min(monetary) AS mi, max(monetary) - min(monetary) AS md FROM sp WHERE is_train)
SELECT customer_id, churn, is_train, recency_days, frequency, round(monetary, 6) AS monetary, round(net_monetary, 6) AS net_monetary, avg_order_value, tenure_days,
  round((coalesce((inv - ri) / nullif(rd, 0), 0) + coalesce((frequency - fi) / nullif(fd, 0)::DOUBLE, 0) + coalesce((monetary - mi) / nullif(md, 0), 0)) / 3, 6) AS loyalty_score,
  round(discount_usage_rate, 6) AS discount_usage_rate, category_diversity, round(return_rate, 6) AS return_rate, last_order_was_return FROM sp, e""",
    "campaign_mix": f"""WITH {SEG}, {_CUT}, g AS (SELECT risk_level, rfm_segment AS segment_name, count(*) AS customers FROM rk JOIN seg USING (customer_id) GROUP BY 1, 2)
SELECT *, round(customers * 100.0 / sum(customers) OVER (PARTITION BY risk_level), 6) AS pct FROM g""",
    "segment_churn": f"WITH {SEG}, {_CUT} SELECT rfm_segment AS segment_name, count(*) AS customers, round(avg(cf.churn), 6) AS churn_rate FROM cf JOIN seg USING (customer_id) GROUP BY 1",
}
