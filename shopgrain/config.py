"""Thresholds and defaults of every operator, as one frozen tree of dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field

# Business thresholds, labels and weights that results depend on.


@dataclass(frozen=True)
class CleaningConfig:
    numeric_imputation: str = "median"
    categorical_imputation: str = "mode"
    unknown_value: str = "Unknown"
    empty_values: tuple[str, ...] = ("", "Nan", "None", "nan", "null", "NULL")
    auto_fix_negatives: bool = True
    max_loss_pct: float = 5.0


@dataclass(frozen=True)
class CustomerConfig:
    churn_days: int = 120
    weight_recency: float = 0.3
    weight_frequency: float = 0.4
    weight_monetary: float = 0.3
    loyal_orders: int = 5
    super_loyal_orders: int = 10
    at_risk_multiplier: float = 0.75
    cache_ttl_hours: int = 24


@dataclass(frozen=True)
class QualityConfig:
    completeness_weight: float = 40.0
    compliance_weight: float = 30.0
    retention_weight: float = 30.0
    iqr_multiplier: float = 1.5
    missing_critical_pct: float = 50.0
    missing_low_pct: float = 5.0
    alpha: float = 0.05


@dataclass(frozen=True)
class SalesConfig:
    complete_months_only: bool = True
    incomplete_month_cutoff: str | None = "2025-09-01"
    incomplete_month_days: int = 28
    yoy_periods: int = 12
    min_months_for_yoy: int = 13
    discount_levels: tuple[int, ...] = (0, 5, 10, 15, 20, 30)
    trend_weeks: int = 13
    train_ratio: float = 0.8
    arima_orders: tuple[tuple[int, int, int], ...] = (
        (1, 1, 1), (2, 1, 1), (1, 1, 2), (2, 1, 2), (0, 1, 1), (1, 1, 0),
    )
    mape_excellent: float = 10.0
    mape_good: float = 20.0


@dataclass(frozen=True)
class SegmentConfig:
    loyalty_labels: tuple[str, ...] = ("Bronze", "Silver", "Gold", "Platinum")
    risk_active: int = 60
    risk_at_risk: int = 120
    risk_inactive: int = 180
    features: tuple[str, ...] = (
        "recency_days", "frequency", "monetary", "avg_order_value", "loyalty_score",
    )
    k_values: tuple[int, ...] = (2, 3, 4, 5, 6, 7, 8)
    min_k: int = 3
    max_k: int = 8
    fallback_k: int = 4
    restarts: int = 50
    max_iter: int = 300
    seed: int = 42
    stability_iterations: int = 50
    stability_fraction: float = 0.8


@dataclass(frozen=True)
class ChurnConfig:
    cutoff_date: str | None = None
    observation_days: int = 180
    lookback_days: int | None = 365
    min_orders: int = 1
    test_size: float = 0.2
    seed: int = 42
    vif_threshold: float = 5.0
    quantile_low: float = 0.33
    quantile_high: float = 0.67
    threshold_low: float = 0.30
    threshold_high: float = 0.70
    campaign_cost_pct: float = 0.10
    retention_high: float = 0.30
    retention_medium: float = 0.50
    retention_low: float = 0.85
    min_accuracy: float = 0.75
    min_precision: float = 0.70
    min_recall: float = 0.70
    min_f1: float = 0.70
    min_auc: float = 0.80


@dataclass(frozen=True)
class FraudConfig:
    high_discount: float = 0.15
    max_discount: float = 0.30
    always_max_share: float = 0.80
    burst_orders: int = 3
    return_rate_high: float = 0.20
    discount_rate_high: float = 0.80
    velocity_order_count: float = 3.0
    negative_margin_rate_high: float = 0.50
    high_value_p99_rate: float = 0.20
    category_hhi_threshold: float = 0.90
    avg_discount_floor: float = 0.15
    weight_return_abuse: float = 0.20
    weight_discount_exploitation: float = 0.15
    weight_high_discount_returns: float = 0.20
    weight_velocity_anomaly: float = 0.15
    weight_margin_exploitation: float = 0.15
    weight_order_value_anomaly: float = 0.10
    weight_category_concentration: float = 0.05
    blend_rule: float = 0.40
    blend_isolation: float = 0.30
    blend_lof: float = 0.30
    tier_critical: float = 0.80
    tier_high: float = 0.60
    tier_medium: float = 0.35
    max_high_critical_pct: float = 15.0
    contamination: float = 0.05
    trees: int = 200
    tree_sample: int = 256
    neighbors: int = 20
    seed: int = 42
    model_features: tuple[str, ...] = (
        "return_rate", "high_discount_return_rate", "discount_usage_rate", "max_discount_rate",
        "always_max_discount", "negative_margin_rate", "max_orders_7d", "velocity_burst_flag",
        "gap_cv", "high_value_rate_p95", "high_value_rate_p99", "category_hhi", "order_value_cv",
        "aov_zscore", "n_payment_methods", "payment_concentration",
    )


@dataclass(frozen=True)
class CohortConfig:
    incomplete_cutoff: str = "2025-09-01"
    min_cohort_size: int = 30
    healthy_month1: float = 0.25
    critical_dropout: float = 0.70
    ltv_window: int = 12
    outlier_z: float = 1.5
    spearman_threshold: float = 0.3
    alpha: float = 0.05
    benchmark_windows: tuple[int, ...] = (1, 3, 6, 12)
    segment_windows: tuple[int, ...] = (3, 6, 12)
    increments: tuple[float, ...] = (0.05, 0.10, 0.15)
    scenario_periods: tuple[int, ...] = (1, 3)
    count_tolerance: float = 0.02


@dataclass(frozen=True)
class Config:
    cleaning: CleaningConfig = field(default_factory=CleaningConfig)
    customer: CustomerConfig = field(default_factory=CustomerConfig)
    quality: QualityConfig = field(default_factory=QualityConfig)
    sales: SalesConfig = field(default_factory=SalesConfig)
    segment: SegmentConfig = field(default_factory=SegmentConfig)
    churn: ChurnConfig = field(default_factory=ChurnConfig)
    fraud: FraudConfig = field(default_factory=FraudConfig)
    cohort: CohortConfig = field(default_factory=CohortConfig)


DEFAULT = Config()
