"""Feature vectors for models: median fill, scaling, VIF, PCA."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import PCA, MinMaxScaler, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, functions as F

from ..functions.expr import one_row, to_rows
from ..functions.ranks import quantiles


def finite_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Infinite and NaN values become null."""
    def clean(c):
        v = F.col(c).cast("double")
        return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)

    return df.withColumns({c: clean(c) for c in columns})


def median_fill(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Fill nulls with exact medians of ``fit_on`` (default: the frame itself)."""
    cols = list(columns)
    df = finite_columns(df, cols)
    fit = df if fit_on is None else finite_columns(fit_on, cols)
    long = fit.select(*cols).unpivot([], cols, "_c", "_v")
    med = quantiles(long, "_v", {"m": 0.5}, by=["_c"]).agg(*[F.max(F.when(F.col("_c") == c, F.col("m"))).alias(c) for c in cols])
    d = df.withColumn("_m", one_row(med))
    return d.withColumns({c: F.coalesce(F.col(c), F.col(f"_m.{c}"), F.lit(0.0)) for c in cols}).drop("_m")


def scaled_vectors(df: DataFrame, columns: Sequence[str], method: str = "standard", fit_on: DataFrame | None = None, output: str = "features") -> DataFrame:
    """Assemble ``columns`` and scale them with statistics of ``fit_on``."""
    cols = list(columns)
    asm = VectorAssembler(inputCols=cols, outputCol="_raw")
    fit = asm.transform(df if fit_on is None else fit_on)
    if method == "standard":
        model = StandardScaler(withMean=True, withStd=True, inputCol="_raw", outputCol=output).fit(fit)
    else:
        model = MinMaxScaler(inputCol="_raw", outputCol=output).fit(fit)
    return model.transform(asm.transform(df)).drop("_raw")


def z_scores(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns as population z-scores; a constant column becomes 0."""
    cols = list(columns)
    s = one_row(df.agg(*[g(c).alias(f"{p}_{c}") for c in cols for p, g in (("m", F.avg), ("s", F.stddev_pop))]))
    d = df.withColumn("_s", s)
    z = {c: F.coalesce(F.try_divide(F.col(c) - F.col(f"_s.m_{c}"), F.col(f"_s.s_{c}")), F.lit(0.0)) for c in cols}
    return d.withColumns(z).drop("_s")


def distribution_after_scaling(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, std, population skewness and excess kurtosis of each scaled feature."""
    cols = list(columns)
    z = z_scores(df, cols)
    wide = z.agg(*[g(c).alias(f"{n}_{c}") for c in cols for n, g in (("mean", F.avg), ("std", F.stddev_pop), ("skewness", F.skewness), ("kurtosis", F.kurtosis))])
    names = ["mean", "std", "skewness", "kurtosis"]
    return to_rows(wide, [[F.lit(c), *[F.col(f"{n}_{c}") for n in names]] for c in cols], ["feature", *names])


def vif(df: DataFrame, columns: Sequence[str], threshold: float = 5.0) -> DataFrame:
    """Variance inflation factors from the inverse correlation matrix.

    The d x d matrix (d features) is all that reaches the driver. Constant features are left out.
    """
    spark = df.sparkSession
    cols = list(columns)
    sd = df.agg(*[F.stddev_pop(F.col(c).cast("double")).alias(c) for c in cols]).first()
    live = [c for c in cols if sd[c]]
    if len(live) < 2:
        return spark.createDataFrame([(c, 1.0, True) for c in live], "feature string, vif double, passed boolean")
    vec = VectorAssembler(inputCols=live, outputCol="v", handleInvalid="skip").transform(df.select(*[F.col(c).cast("double").alias(c) for c in live]))
    r = Correlation.corr(vec, "v").first()[0].toArray()
    # Perfect collinearity makes the matrix singular: those factors are infinite.
    eig = np.linalg.eigvalsh(r)
    inv = np.diag(np.linalg.pinv(r)) if eig[0] < 1e-12 else np.diag(np.linalg.inv(r))
    out = []
    for i, c in enumerate(live):
        rest = np.delete(np.arange(len(live)), i)
        singular = eig[0] < 1e-12 and np.linalg.matrix_rank(r) == np.linalg.matrix_rank(r[np.ix_(rest, rest)])
        v = float("inf") if singular else float(inv[i])
        out.append((c, v, v < threshold))
    return spark.createDataFrame(out, "feature string, vif double, passed boolean").orderBy(F.desc("vif"))


def vif_by_strategy(df: DataFrame, strategies: dict[str, list[str]], threshold: float = 5.0) -> DataFrame:
    out = None
    for name, cols in strategies.items():
        v = vif(df, cols, threshold).agg(F.max("vif").alias("max_vif"), F.count("*").alias("features"), F.bool_and("passed").alias("vif_pass"))
        v = v.select(F.lit(name).alias("strategy"), "*")
        out = v if out is None else out.unionByName(v)
    return out


def pca(df: DataFrame, k: int = 2, features: str = "features") -> tuple[DataFrame, list[float]]:
    """Projection columns pc1..pck and the explained variance shares."""
    model = PCA(k=k, inputCol=features, outputCol="_pc").fit(df)
    arr = vector_to_array("_pc")
    out = model.transform(df).withColumns({f"pc{i + 1}": arr[i] for i in range(k)}).drop("_pc")
    return out, [float(x) for x in model.explainedVariance]
