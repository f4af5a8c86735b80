"""Kernels of regression and shrinkage (N1-N33): column builders, aggregates, and loops over sufficient statistics."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def soft(beta: Column, lam: float | Column) -> Column:
    """The soft threshold."""
    return F.signum(beta) * F.greatest(F.abs(beta) - lam, F.lit(0.0))


def adaptive_soft(beta: Column, lam: float, weight: Column) -> Column:
    return soft(beta, lam * weight)


def relaxed(beta: Column, lam: float, phi: float) -> Column:
    """Selection by one threshold, shrinkage by a part of it."""
    return F.when(F.abs(beta) > lam, soft(beta, lam * phi)).otherwise(0.0)


def scad(beta: Column, lam: float, a: float = 3.7) -> Column:
    """The SCAD penalty, in its three regions."""
    b = F.abs(beta)
    mid = (2 * a * lam * b - b * b - lam * lam) / (2 * (a - 1))
    return F.when(b <= lam, lam * b).when(b <= a * lam, mid).otherwise(lam * lam * (a + 1) / 2)


def group_shrink(norm: Column, lam: float) -> Column:
    return F.when(norm > 0, F.greatest(1 - lam / norm, F.lit(0.0))).otherwise(0.0)


def cw_shrink(r2: Column, p: float, n: float) -> Column:
    """Curds-and-whey factor of a canonical correlation."""
    return r2 / (r2 + p / n * (1 - r2))


def keep_top(rank: Column, r: int) -> Column:
    return F.when(rank < r, 1).otherwise(0)


def f_nested(rss0: Column, rss1: Column, p0: int, p1: int, n: Column) -> Column:
    return ((rss0 - rss1) / (p1 - p0)) / (rss1 / (n - p1 - 1))


def normal_pdf(x: Column, mean: float = 0.0, sd: float = 1.0) -> Column:
    z = (x - mean) / sd
    return F.exp(-z * z / 2) / (sd * math.sqrt(2 * math.pi))


def f_pdf(x: Column, d1: float, d2: float) -> Column:
    """The density of F with d1 and d2 degrees of freedom."""
    const = math.lgamma((d1 + d2) / 2) - math.lgamma(d1 / 2) - math.lgamma(d2 / 2) + d1 / 2 * math.log(d1 / d2)
    return F.when(x > 0, F.exp(F.lit(const) + (d1 / 2 - 1) * F.log(x) - (d1 + d2) / 2 * F.log1p(d1 / d2 * x))).otherwise(0.0)


def aic(rss: Column, n: Column, k: Column) -> Column:
    return n * F.log(rss / n) + 2 * k


def ridge_df(squares: Column, lam: float) -> Column:
    """Effective degrees of freedom from an array of squared singular values."""
    return F.aggregate(squares, F.lit(0.0), lambda a, d: a + d / (d + lam))


def vif(x: str, z: str) -> Column:
    return 1 / (1 - F.corr(x, z) ** 2)


def ols(x: str, y: str, name: str = "ols") -> Column:
    """struct(slope, intercept, rss) of a simple regression, as one aggregate."""
    n, sxx = F.regr_count(y, x), F.regr_sxx(y, x)
    rss = F.regr_syy(y, x) - F.regr_sxy(y, x) ** 2 / sxx
    return F.struct(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), rss.alias("rss"), n.alias("n")).alias(name)


def partial_slope(y: str, x: str, z: str) -> Column:
    """The slope of y on x with z held fixed, from second moments: both sides residualised on z."""
    sxy, sxz, syz = F.covar_samp(x, y), F.covar_samp(x, z), F.covar_samp(y, z)
    return (sxy - sxz * syz / F.var_samp(z)) / (F.var_samp(x) - sxz**2 / F.var_samp(z))


def moments(df: DataFrame, xs: list[str], y: str) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Centred Gram matrix, cross products, total sum of squares and count: one aggregate, of fixed size."""
    cols = [*xs, y]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = df.dropna(subset=cols).agg(F.count(F.lit(1)).alias("n"), *(F.covar_pop(cols[i], cols[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    n, k = row["n"], len(xs)
    full = np.zeros((k + 1, k + 1))
    for i, j in pairs:
        full[i, j] = full[j, i] = (row[f"c{i}_{j}"] or 0.0) * n
    return full[:k, :k], full[:k, k], full[k, k], n


def lasso(gram: np.ndarray, cross: np.ndarray, lams: list[float], sweeps: int = 500, tol: float = 1e-10) -> list[np.ndarray]:
    """Cyclic coordinate descent from the Gram matrix, each penalty started at the last one's solution."""
    beta, path = np.zeros(len(cross)), []
    for lam in lams:
        for _ in range(sweeps):
            before = beta.copy()
            for j in range(len(beta)):
                rho = cross[j] - gram[j] @ beta + gram[j, j] * beta[j]
                beta[j] = np.sign(rho) * max(abs(rho) - lam, 0.0) / gram[j, j] if gram[j, j] > 0 else 0.0
            if np.abs(beta - before).max(initial=0.0) < tol:
                break
        path.append(beta.copy())
    return path


def stagewise(gram: np.ndarray, cross: np.ndarray, eps: float, steps: int) -> np.ndarray:
    """Small steps along the variable most correlated with the residual, until none gains."""
    beta, path = np.zeros(len(cross)), []
    for _ in range(steps):
        gap = cross - gram @ beta
        j = int(np.argmax(np.abs(gap)))
        if abs(gap[j]) <= eps * gram[j, j] / 2:
            break
        beta[j] += eps * np.sign(gap[j])
        path.append(beta.copy())
    return np.array(path).reshape(-1, len(cross))


def best_subsets(gram: np.ndarray, cross: np.ndarray, total: float) -> list[tuple[int, int, float]]:
    """(size, mask, rss): the best subset of each size, over all of them; for a stated, small number of variables."""
    best: dict[int, tuple[float, int]] = {}
    for mask in range(1 << len(cross)):
        on = [j for j in range(len(cross)) if mask >> j & 1]
        rss = total - (cross[on] @ np.linalg.solve(gram[np.ix_(on, on)], cross[on]) if on else 0.0)
        best[len(on)] = min(best.get(len(on), (math.inf, 0)), (float(rss), mask))
    return [(k, m, r) for k, (r, m) in sorted(best.items())]


def mse(bias2: Column, variance: Column) -> Column:
    return bias2 + variance


def argmin(x: str, y: str) -> Column:
    """The x of the smallest y, the smallest x among equals."""
    return F.min(F.struct(F.col(y).alias("y"), F.col(x).alias("x")))["x"]


def ellipse(x: str, y: str) -> Column:
    """struct(major, minor, angle): the axes of the covariance of two columns, as eigenvalues, and the major one's angle."""
    a, b, c = F.var_pop(x), F.var_pop(y), F.covar_pop(x, y)
    mid, root = (a + b) / 2, F.sqrt(((a - b) / 2) ** 2 + c * c)
    return F.struct((mid + root).alias("major"), (mid - root).alias("minor"), (F.atan2(2 * c, a - b) / 2).alias("angle"))


def product(a: DataFrame, b: DataFrame, rank: int | None = None) -> DataFrame:
    """(i, j, v): the product of matrices as cells (i, k, v) and (k, j, v), of their first ``rank`` inner places only."""
    a = a if rank is None else a.where(F.col("k") < rank)
    cells = a.select("i", "k", F.col("v").alias("__a")).join(b.select("k", "j", F.col("v").alias("__b")), "k")
    return cells.groupBy("i", "j").agg(F.sum(F.col("__a") * F.col("__b")).alias("v"))


def deviation(a: DataFrame, b: DataFrame, at: list[str]) -> DataFrame:
    """(frobenius, sup): the norms of the difference of two tables of v by place; a place that one lacks counts as 0 there."""
    both = a.withColumnRenamed("v", "__a").join(b.withColumnRenamed("v", "__b"), at, "full")
    gap = F.coalesce("__a", F.lit(0.0)) - F.coalesce("__b", F.lit(0.0))
    return both.agg(F.sqrt(F.sum(gap * gap)).alias("frobenius"), F.max(F.abs(gap)).alias("sup"))


def interpolate(knots: DataFrame, at: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """``at`` with y on the lines between the knots of its key (one per x); beyond the outer knots, the outer one's y.

    One union and two windows over key and place, so that no pair is made; null without knots."""
    both = knots.select(*by, x, F.struct(F.col(x).alias("x"), F.col(y).alias("y")).alias("__k")).withColumn("__q", F.lit(0)).unionByName(at.select(*by, x).withColumn("__q", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(x, "__q")
    lo = F.last("__k", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    hi = F.first("__k", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    got = both.withColumns({"__lo": lo, "__hi": hi}).where("__q = 1")
    line = F.col("__lo.y") + (F.col("__hi.y") - F.col("__lo.y")) * (F.col(x) - F.col("__lo.x")) / (F.col("__hi.x") - F.col("__lo.x"))
    value = F.when(F.col("__lo.x") == F.col(x), F.col("__lo.y")).when(F.col("__lo").isNull(), F.col("__hi.y")).when(F.col("__hi").isNull(), F.col("__lo.y")).otherwise(line)
    return got.select(*by, x, value.alias(y))


def hashed_normal(key: Column, seed: int = 0) -> Column:
    """A standard normal draw that depends on the key and seed only, whatever the partitions (Box-Muller)."""
    unit = lambda s: (F.pmod(F.xxhash64(key, F.lit(seed), F.lit(s)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return F.sqrt(-2 * F.log(unit(1))) * F.cos(2 * math.pi * unit(2))
