"""The six flows from raw orders to stored results. Each returns its result tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import DEFAULT, Config
from ..operators import (
    anomaly, churn, classify, clean, clustering, cohorts, features, forecast, fraud, hypothesis, quality, sales, segments,
)
from ..operators.customers import portfolio_kpis
from ..session import materialized
from ..sources import cache, readers, writers


def prepare(spark: SparkSession, csv_path: str, folder: str, cfg: Config = DEFAULT) -> dict[str, DataFrame]:
    """CSV to cleaned transactions and customer features, with the quality tables of both."""
    raw = clean.require_rows(readers.read_raw_csv(spark, csv_path, validate=False))
    profile = quality.missingness_profile(raw)
    tx = writers.write_verified(clean.clean_transactions(raw, cfg), f"{folder}/transactions.parquet")
    cust = writers.write_verified(cache.cached_customers(tx, f"{folder}/cache", cfg), f"{folder}/customers.parquet")
    return {
        "transactions": tx, "customers": cust, "missingness": profile, "row_loss": clean.row_loss(raw, tx, cfg),
        "checks": quality.sanity_checks(tx, cust), "quality": quality.quality_score(tx, raw, cfg),
    }


def time_trends(tx: DataFrame, cfg: Config = DEFAULT) -> dict[str, DataFrame]:
    whole = sales.complete_months(tx, cfg)
    monthly = sales.yoy_growth(sales.monthly_sales(whole), cfg)
    return {"monthly": monthly, "seasonality": sales.seasonality(whole), "trend_metrics": sales.trend_metrics(monthly)}


def sales_tables(tx: DataFrame, cust: DataFrame, cfg: Config = DEFAULT, dashboard_categories: int = 7) -> dict[str, DataFrame]:
    """Every sales result, the forecast and the dashboard tables drawn from them."""
    out = time_trends(tx, cfg)
    whole = sales.complete_months(tx, cfg)
    weekly = materialized(forecast.weekly_series(whole))
    grid = materialized(forecast.forecast_grid(weekly, cfg))
    metrics = forecast.forecast_metrics(grid, cfg)
    trend = sales.rolling_trend(sales.weekly_sales(whole), cfg.sales.trend_weeks)
    out |= {
        "category": sales.category_performance(tx), "pareto": sales.category_pareto(tx), "region": sales.region_performance(tx),
        "payment": sales.payment_performance(tx), "discount_tiers": sales.discount_tiers(tx, cfg),
        "discount_customers": sales.discount_customers(tx), "discount_summary": sales.discount_summary(tx, cfg),
        "forecast": metrics, "forecast_series": forecast.history_and_forecast(weekly, grid, metrics), "rolling_trend": trend,
        "forecast_verdicts": forecast.forecast_verdicts(metrics, trend, cfg), "performance_matrix": sales.performance_matrix(tx),
    }
    out["kpis"] = sales.kpi_rollup({
        "time_trends": out["trend_metrics"], "discount": out["discount_summary"], "trend": trend, "portfolio": portfolio_kpis(tx, cust)})
    out["top_categories"] = out["category"].orderBy(F.desc("revenue"), "category").limit(dashboard_categories)
    return out


def segmentation(tx: DataFrame, cust: DataFrame, folder: str | None = None, cfg: Config = DEFAULT, k: int | None = None,
                 restarts: int | None = None, stability_runs: int | None = None) -> dict[str, DataFrame]:
    """Scores, rule segments, k-means with a voted k, profiles, names, tests and export."""
    scored = materialized(segments.rfm_segments(segments.ensure_rfm_scores(cust)))
    vectors = materialized(clustering.cluster_vectors(scored, cfg))
    out = {"rule_segments": segments.segment_profile(scored)}
    if k is None:
        out["k_sweep"] = clustering.k_sweep(vectors, cfg, restarts)
        out["choice"] = clustering.choose_k(out["k_sweep"], cfg)
        k = out["choice"].first()["k"]
    labels = clustering.assign_clusters(vectors, clustering.best_kmeans(vectors, k, cfg, restarts))
    labelled = materialized(segments.attach_labels(scored, labels))
    named = materialized(segments.segment_names(segments.cluster_profiles(labelled, "cluster", cfg)))
    with_names = labelled.join(named.select("cluster", "segment_name"), "cluster")
    out |= {
        "labels": with_names, "profiles": named, "sizes": clustering.cluster_sizes(labels), "silhouette": clustering.silhouette_by_cluster(labels),
        "stability": clustering.stability(vectors, k, cfg, stability_runs), "insights": segments.segment_insight_flags(named),
        "kruskal": hypothesis.kruskal_wallis(labelled, "monetary", "cluster"), "levene": hypothesis.levene(labelled, "monetary", "cluster"),
        "anova": hypothesis.anova(labelled, "monetary", "cluster"), "comparison": segments.segment_comparison(tx, with_names, "segment_name"),
    }
    if folder:
        writers.export_segments(with_names, named, folder, cfg)
    return out


def validate_segments(df: DataFrame, values: list[str], group: str = "cluster", alpha: float = 0.05) -> DataFrame:
    """One row per feature: Levene decides between ANOVA and Kruskal-Wallis, with effect size and verdict.

    All features are tested together, as (feature, value) rows; the results are joined by feature.
    """
    long = df.select(group, *[F.col(v).cast("double").alias(v) for v in values]).unpivot([group], values, "feature", "value")
    long = materialized(long)
    an = hypothesis.anova(long, "value", group, by=["feature"]).select("feature", F.col("statistic").alias("f"), F.col("p_value").alias("f_p"), "eta_squared")
    kw = hypothesis.kruskal_wallis(long, "value", group, by=["feature"]).select("feature", F.col("statistic").alias("h"), F.col("p_value").alias("h_p"))
    lev = hypothesis.levene(long, "value", group, by=["feature"]).select("feature", F.col("p_value").alias("levene_p"))
    uneven = F.col("levene_p") < alpha
    out = lev.join(an, "feature").join(kw, "feature").select(
        "feature", "levene_p", F.when(uneven, "Kruskal-Wallis").otherwise("ANOVA").alias("test"),
        F.when(uneven, F.col("h")).otherwise(F.col("f")).alias("statistic"), F.when(uneven, F.col("h_p")).otherwise(F.col("f_p")).alias("p_value"), "eta_squared")
    return out.withColumn("effect", F.when(F.col("eta_squared") >= 0.14, "Large").when(F.col("eta_squared") >= 0.06, "Medium").otherwise("Small")).withColumn(
        "significant", F.col("p_value") < alpha)


def churn_flow(tx: DataFrame, folder: str | None = None, cfg: Config = DEFAULT, strategies: tuple[str, ...] = ("base", "composite"),
               trees: int = 200, boosts: int = 200) -> dict[str, DataFrame]:
    """Dataset and models per strategy, the strategy choice, scores, risk levels and campaign numbers."""
    spark = tx.sparkSession
    data = {s: materialized(churn.churn_dataset(tx, cfg, s)) for s in strategies}
    fits, metrics, vifs = {}, None, None
    for s, d in data.items():
        cols = churn.feature_columns(s)
        fits[s] = classify.train_models(d, cols, cfg, trees, boosts)
        m = classify.evaluate_all(fits[s], d.where("not is_train"), cols).withColumn("strategy", F.lit(s))
        v = features.vif_by_strategy(d.where("is_train"), {s: cols}, cfg.churn.vif_threshold)
        metrics = m if metrics is None else metrics.unionByName(m)
        vifs = v if vifs is None else vifs.unionByName(v)
    metrics = materialized(metrics)
    best = metrics.groupBy("strategy").agg(F.max("f1").alias("f1"), F.max_by("model", "f1").alias("model"))
    chosen = churn.pick_strategy(vifs.join(best, "strategy")).first()
    s, name = chosen["strategy"], chosen["model"]
    cols = churn.feature_columns(s)
    scored = materialized(classify.score(fits[s][name], data[s], cols, keep=["customer_id", "churn", "monetary"]))
    risk = churn.risk_levels(scored, cfg)
    out = {
        "metrics": classify.compare_models(metrics.where(F.col("strategy") == s), cfg), "vif": vifs, "predictions": scored, "risk": risk,
        "risk_summary": churn.risk_summary(risk), "campaigns": churn.campaign_sizing(risk, cfg),
        "importance": classify.feature_importance(fits[s][name], cols, name, spark),
        "checks": quality.temporal_split_checks(data[s], len(cols), cfg.churn.observation_days, cfg),
    }
    if folder:
        writers.export_predictions(risk, folder)
        writers.export_deliverables(out["importance"], risk, out["campaigns"], folder)
        writers.export_model(fits[s][name], cols, metrics.where((F.col("strategy") == s) & (F.col("model") == name)), folder)
    return out


def fraud_flow(tx: DataFrame, cust: DataFrame, named: DataFrame | None = None, predictions: DataFrame | None = None,
               folder: str | None = None, cfg: Config = DEFAULT) -> dict[str, DataFrame]:
    """Input contract, features, rules, both anomaly models, tiers, typologies, exposure and output contract."""
    feats = materialized(fraud.fraud_features(tx, cust, cfg))
    cols = list(cfg.fraud.model_features)
    z = features.z_scores(feats, cols).select("customer_id", *cols)
    both = anomaly.ensemble(fraud.rule_scores(feats, cfg), anomaly.isolation_forest(z, cols, cfg), anomaly.local_outlier_factor(z, cols, cfg))
    profile = materialized(fraud.typology(fraud.composite_score(both, cfg), cfg))
    out = {
        "input_checks": quality.fraud_input_checks(tx, cust), "profile": profile, "exposure": fraud.exposure(tx, profile),
        "tiers": fraud.tier_profile(profile, ["return_rate", "max_orders_7d", "category_hhi"]), "interventions": fraud.interventions(profile),
        "agreement": hypothesis.flag_agreement(profile, "iso_anomaly_flag", "lof_anomaly_flag"), "output_checks": quality.fraud_output_checks(profile, cfg),
    }
    if named is not None:
        merged = fraud.join_risk_labels(profile, named, predictions)
        out |= {"crosstab": fraud.crosstab(merged, "segment_name", "risk_tier"), "segment_fraud": fraud.segment_fraud(merged)}
    if folder:
        writers.save_fraud_profile(profile, folder)
    return out


def cohort_flow(tx: DataFrame, cust: DataFrame, folder: str | None = None, cfg: Config = DEFAULT) -> dict[str, DataFrame]:
    """Cells, retention and revenue curves, LTV, segments, tests, scenarios and both contracts."""
    c = cfg.cohort
    cells = materialized(cohorts.cohort_cells(tx, cfg))
    tiers = segments.loyalty_tiers(cust, cfg)
    agg = cohorts.aggregate_retention(cells)
    seg = cohorts.segment_retention(tx, tiers, "loyalty_tier", cfg)
    ltv = cohorts.segment_ltv(tx, tiers, "loyalty_tier", c.segment_windows, cfg)
    out = {
        "input_checks": quality.cohort_input_checks(tx, cust, cfg), "cells": cells, "sizes": cohorts.cohort_sizes(tx), "retention": agg,
        "dropout": cohorts.dropout_rates(agg), "revenue_retention": cohorts.revenue_retention(cells), "aov": cohorts.aov_by_period(cells),
        "benchmarks": cohorts.ltv_benchmarks(cells, c.benchmark_windows), "projection": cohorts.ltv_projection(cells, c.ltv_window),
        "outliers": cohorts.retention_outliers(cells, cfg), "stability": cohorts.retention_stability(cells), "segment_retention": seg, "segment_ltv": ltv,
        "first_category_retention": cohorts.segment_retention(tx, cohorts.first_category(tx), "first_category", cfg),
        "test": cohorts.cohort_chi_square(cells), "scenarios": cohorts.uplift_scenarios(cells, cfg), "summary": cohorts.cohort_summary(cells),
        "insights": cohorts.cohort_insight_flags(cells, seg, cfg), "output_checks": quality.cohort_output_checks(cells, cfg),
    }
    if folder:
        writers.save_cohorts(cells, out["summary"], ltv, folder)
    return out
