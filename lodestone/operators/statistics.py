"""Statistical tests. Spark reduces each sample to one small row (counts, moments, rank sums); the p-value is finished
on the driver. `<name>_statistics` give that row as a DataFrame, `<name>` the finished result as a dictionary.

Samples are DataFrames with the column named; missing values are dropped. Paired tests take two columns of one
DataFrame (align data sets by combine_horizontal first).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import special as sp
from .relational import average_ranks, quoted, running_sums

Result = dict[str, Any]


def band(value: float, limits: Sequence[float], names: Sequence[str]) -> str:
    return names[sum(abs(value) >= x for x in limits)]


def values(df: DataFrame, column: str) -> DataFrame:
    x = quoted(column).cast("double")
    return df.select(x.alias("x")).where("x is not null and not isnan(x)")


def pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    both = df.select(quoted(a).cast("double").alias("x"), quoted(b).cast("double").alias("y"))
    return both.where("x is not null and y is not null and not isnan(x) and not isnan(y)")


def _two(a: DataFrame, column_a: str, b: DataFrame, column_b: str) -> DataFrame:
    return values(a, column_a).withColumn("g", F.lit(1)).unionByName(values(b, column_b).withColumn("g", F.lit(2)))


def shapiro_wilk(df: DataFrame, column: str, alpha: float = 0.05, most: int = 5000) -> Result:
    """Normality by Shapiro and Wilk, for 3 to `most` values, which come to the driver."""
    x = [r.x for r in values(df, column).limit(most + 1).collect()]
    if len(x) < 3 or len(x) > most:
        raise ValueError(f"3 to {most} values are needed")
    w, p = sp.shapiro_wilk(x)
    return {"statistic": w, "p_value": p, "n": len(x), "is_normal": p > alpha}


def _standardised(df: DataFrame, column: str) -> DataFrame:
    """Different values with c, c_upto (their counts, running) and the sample's _n, _mean, _std; z is standardised."""
    clean = values(df, column)
    moments = clean.agg(F.avg("x").alias("_mean"), F.stddev_samp("x").alias("_std"), F.count("*").alias("_n"))
    ranked = running_sums(clean.groupBy("x").agg(F.count("*").alias("c")), "x", ["c"]).crossJoin(F.broadcast(moments))
    return ranked.withColumn("z", (F.col("x") - F.col("_mean")) / F.col("_std"))


def ks_normal_statistics(df: DataFrame, column: str) -> DataFrame:
    """n, mean, std and D against the normal distribution of the sample's mean and std."""
    cdf = normal_cdf(F.col("z"))
    upper, lower = F.col("c_upto") / F.col("_n") - cdf, cdf - (F.col("c_upto") - F.col("c")) / F.col("_n")
    return _standardised(df, column).withColumn("gap", F.greatest(upper, lower)).agg(F.first("_n").alias("n"), F.first("_mean").alias("mean"), F.first("_std").alias("std"), F.max("gap").alias("d"))


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function in built-in functions only: Taylor's series near zero and a continued
    fraction in the tails, to 1e-13 and better."""
    a = F.abs(z)
    # phi(z) * (z + z^3/3 + z^5/15 + ...), nested from the last term
    near = F.aggregate(F.sequence(F.lit(60), F.lit(0), F.lit(-1)), F.lit(1.0), lambda s, k: 1.0 + s * a * a / (2 * k + 3))
    density = F.exp(-0.5 * a * a) / math.sqrt(2 * math.pi)
    tail = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), F.lit(0.0), lambda s, k: k / (a + s))
    upper = F.when(a < 4, 0.5 - density * near * a).otherwise(density / (a + tail))
    return F.when(z > 0, 1 - upper).otherwise(upper)


def ks_normal(df: DataFrame, column: str, alpha: float = 0.05) -> Result:
    r = ks_normal_statistics(df, column).first()
    p = sp.ks_one_sample_sf(r.d, r.n)
    return {"statistic": r.d, "p_value": p, "n": r.n, "mean": r["mean"], "std": r["std"], "is_normal": p > alpha}


#: Critical values of the Anderson-Darling statistic for a normal distribution with both parameters
#: estimated, by level in per cent.
ANDERSON_CRITICAL = {15.0: 0.576, 10.0: 0.656, 5.0: 0.787, 2.5: 0.918, 1.0: 1.092}


def anderson_darling_statistics(df: DataFrame, column: str) -> DataFrame:
    """n and A squared. A value of which there are several takes a run of places; its terms are summed in closed form."""
    cdf, sf = normal_cdf(F.col("z")), normal_cdf(-F.col("z"))
    last, first = F.col("c_upto"), F.col("c_upto") - F.col("c")
    up = last * last - first * first  # sum of 2i - 1 over the places
    down = 2 * F.col("_n") * F.col("c") - up
    told = _standardised(df, column).withColumn("term", up * F.ln(cdf) + down * F.ln(sf))
    return told.agg(F.first("_n").alias("n"), (-F.first("_n") - F.sum("term") / F.first("_n")).alias("a2"))


def anderson_darling(df: DataFrame, column: str, level: float = 5.0) -> Result:
    if level not in ANDERSON_CRITICAL:
        raise ValueError(f"levels: {list(ANDERSON_CRITICAL)}")
    r = anderson_darling_statistics(df, column).first()
    critical = {k: round(v / (1 + 4 / r.n - 25 / r.n**2), 3) for k, v in ANDERSON_CRITICAL.items()}
    return {"statistic": r.a2, "n": r.n, "critical_values": critical, "is_normal": r.a2 < critical[level]}


def paired_ttest_statistics(df: DataFrame, a: str, b: str) -> DataFrame:
    d = F.col("x") - F.col("y")
    return pairs(df, a, b).agg(F.count("*").alias("n"), F.avg(d).alias("mean_difference"), F.stddev_samp(d).alias("std_difference")).withColumn("t", F.try_divide(F.col("mean_difference") * F.sqrt("n"), "std_difference"))


def paired_ttest(df: DataFrame, a: str, b: str, alpha: float = 0.05, alternative: str = "two-sided") -> Result:
    r = paired_ttest_statistics(df, a, b).first()
    if r.n < 2:
        raise ValueError("at least 2 pairs are needed")
    t = math.nan if r.t is None else r.t
    p = sp.two_sided(sp.student_t_sf(t, r.n - 1), sp.student_t_sf(-t, r.n - 1), alternative)
    return {"statistic": t, "p_value": p, "n": r.n, "mean_difference": r.mean_difference, "significant": p <= alpha}


def wilcoxon_statistics(df: DataFrame, a: str, b: str) -> DataFrame:
    """Of the signed ranks without zero differences: n, w_plus, w_minus, ties (sum of t^3 - t), and counts by sign."""
    d = pairs(df, a, b).select((F.col("x") - F.col("y")).alias("d"))
    by = d.where("d != 0").groupBy(F.abs("d").alias("m")).agg(F.count("*").alias("c"), F.count_if(F.col("d") > 0).alias("up"))
    ranked = running_sums(by, "m", ["c"])
    rank = F.col("c_upto") - F.col("c") + (F.col("c") + 1) / 2
    zeros = d.agg(F.count_if(F.col("d") == 0).alias("n_zero"))
    sums = ranked.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum(rank * F.col("up")), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum(rank * (F.col("c") - F.col("up"))), F.lit(0.0)).alias("w_minus"), F.coalesce(F.sum(F.pow("c", F.lit(3)) - F.col("c")), F.lit(0.0)).alias("ties"), F.coalesce(F.sum("up"), F.lit(0)).alias("n_positive"))
    return sums.withColumn("n_negative", F.col("n") - F.col("n_positive")).crossJoin(zeros)


def wilcoxon(df: DataFrame, a: str, b: str, alpha: float = 0.05, alternative: str = "two-sided") -> Result:
    r = wilcoxon_statistics(df, a, b).first()
    if not r.n:
        raise ValueError("all differences are zero")
    if r.n <= 50 and not r.ties and not r.n_zero:
        greater, less = sp.signed_rank_sf(int(r.w_plus), r.n), sp.signed_rank_sf(int(r.w_minus), r.n)
    else:
        z = (r.w_plus - r.n * (r.n + 1) / 4) / math.sqrt(r.n * (r.n + 1) * (2 * r.n + 1) / 24 - r.ties / 48)
        greater, less = sp.normal_sf(z), sp.normal_cdf(z)
    p = sp.two_sided(greater, less, alternative)
    statistic = min(r.w_plus, r.w_minus) if alternative == "two-sided" else r.w_plus
    return {"statistic": statistic, "p_value": p, "n": r.n, "n_positive": r.n_positive, "n_negative": r.n_negative, "n_zero": r.n_zero, "significant": p <= alpha}


def _correlation(r: float | None, n: int, alpha: float) -> Result:
    if n < 3 or r is None or math.isnan(r):
        return {"statistic": r, "p_value": math.nan, "n": n, "significant": False}
    r = max(-1.0, min(1.0, r))
    t = math.inf if abs(r) == 1 else abs(r) * math.sqrt((n - 2) / (1 - r * r))
    p = min(1.0, 2 * sp.student_t_sf(t, n - 2))
    return {"statistic": r, "p_value": p, "n": n, "strength": band(r, (0.3, 0.7), ("weak", "moderate", "strong")), "significant": p <= alpha}


def pearson_statistics(df: DataFrame, a: str, b: str) -> DataFrame:
    return pairs(df, a, b).agg(F.count("*").alias("n"), F.corr("x", "y").alias("r"))


def pearson(df: DataFrame, a: str, b: str, alpha: float = 0.05) -> Result:
    r = pearson_statistics(df, a, b).first()
    return _correlation(r.r, r.n, alpha)


def spearman_statistics(df: DataFrame, a: str, b: str) -> DataFrame:
    return average_ranks(average_ranks(pairs(df, a, b), "x", "rx"), "y", "ry").agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("rho"))


def spearman(df: DataFrame, a: str, b: str, alpha: float = 0.05) -> Result:
    r = spearman_statistics(df, a, b).first()
    return _correlation(r.rho, r.n, alpha)


def welch_statistics(a: DataFrame, column_a: str, b: DataFrame, column_b: str) -> DataFrame:
    """Sizes, means and variances of both samples, t, degrees of freedom, Cohen's d (pooled)."""
    side = lambda df, c, k: values(df, c).agg(F.count("*").alias(f"n{k}"), F.avg("x").alias(f"mean{k}"), F.var_samp("x").alias(f"var{k}"))
    both = side(a, column_a, 1).crossJoin(side(b, column_b, 2))
    n1, n2, v1, v2 = (F.col(c) for c in ("n1", "n2", "var1", "var2"))
    se1, se2, gap = v1 / n1, v2 / n2, F.col("mean1") - F.col("mean2")
    pooled = F.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2))
    return both.select("*", F.try_divide(gap, F.sqrt(se1 + se2)).alias("t"), F.try_divide(F.pow(se1 + se2, F.lit(2)), se1 * se1 / (n1 - 1) + se2 * se2 / (n2 - 1)).alias("df"), F.try_divide(gap, pooled).alias("cohens_d"))


def independent_ttest(a: DataFrame, column_a: str, b: DataFrame, column_b: str, alpha: float = 0.05, alternative: str = "two-sided") -> Result:
    r = welch_statistics(a, column_a, b, column_b).first()
    if min(r.n1, r.n2) < 2:
        raise ValueError("at least 2 values a sample are needed")
    t, df = (math.nan if x is None else x for x in (r.t, r["df"]))
    p = sp.two_sided(sp.student_t_sf(t, df), sp.student_t_sf(-t, df), alternative)
    d = 0.0 if r.cohens_d is None else r.cohens_d
    return {"statistic": t, "p_value": p, "df": df, "cohens_d": d, "effect": band(d, (0.2, 0.5, 0.8), ("negligible", "small", "medium", "large")), "significant": p <= alpha, "n_a": r.n1, "n_b": r.n2, "mean_a": r.mean1, "mean_b": r.mean2}


def mann_whitney_statistics(a: DataFrame, column_a: str, b: DataFrame, column_b: str) -> DataFrame:
    """n1, n2, u (of the first sample), ties and Cliff's delta, from rank sums."""
    by = _two(a, column_a, b, column_b).groupBy("x").agg(F.count("*").alias("c"), F.count_if(F.col("g") == 1).alias("c1"))
    ranked = running_sums(by, "x", ["c"])
    rank = F.col("c_upto") - F.col("c") + (F.col("c") + 1) / 2
    sums = ranked.agg(F.sum("c1").alias("n1"), (F.sum("c") - F.sum("c1")).alias("n2"), F.sum(rank * F.col("c1")).alias("r1"), F.sum(F.pow("c", F.lit(3)) - F.col("c")).alias("ties"))
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    return sums.select("n1", "n2", u.alias("u"), "ties", (F.try_divide(2 * u, F.col("n1") * F.col("n2")) - 1).alias("cliffs_delta"))


def mann_whitney(a: DataFrame, column_a: str, b: DataFrame, column_b: str, alpha: float = 0.05, alternative: str = "two-sided") -> Result:
    r = mann_whitney_statistics(a, column_a, b, column_b).first()
    if not r.n1 or not r.n2:
        raise ValueError("a sample is empty")
    n, most = r.n1 + r.n2, r.n1 * r.n2
    if min(r.n1, r.n2) <= 8 and not r.ties and most <= 10_000:
        greater, less = sp.rank_sum_sf(int(r.u), r.n1, r.n2), sp.rank_sum_sf(int(most - r.u), r.n1, r.n2)
    else:
        sigma = math.sqrt(most / 12 * (n + 1 - r.ties / (n * (n - 1))))
        tail = lambda u: 0.5 if not sigma else sp.normal_sf((u - most / 2 - 0.5) / sigma)
        greater, less = tail(r.u), tail(most - r.u)
    p = sp.two_sided(greater, less, alternative)
    return {"statistic": r.u, "p_value": p, "n_a": r.n1, "n_b": r.n2, "cliffs_delta": r.cliffs_delta, "effect": band(r.cliffs_delta, (0.147, 0.33, 0.474), ("negligible", "small", "medium", "large")), "significant": p <= alpha}


def ks_two_sample_statistics(a: DataFrame, column_a: str, b: DataFrame, column_b: str) -> DataFrame:
    """n1, n2, d_plus (F1 over F2 at most), d_minus and d."""
    by = _two(a, column_a, b, column_b).groupBy("x").agg(F.count_if(F.col("g") == 1).alias("c1"), F.count_if(F.col("g") == 2).alias("c2"))
    totals = by.agg(F.sum("c1").alias("n1"), F.sum("c2").alias("n2"))
    gap = F.col("c1_upto") / F.col("n1") - F.col("c2_upto") / F.col("n2")
    out = running_sums(by, "x", ["c1", "c2"]).crossJoin(F.broadcast(totals)).agg(F.first("n1").alias("n1"), F.first("n2").alias("n2"), F.max(gap).alias("d_plus"), F.max(-gap).alias("d_minus"))
    return out.withColumn("d", F.greatest("d_plus", "d_minus"))


def ks_two_sample(a: DataFrame, column_a: str, b: DataFrame, column_b: str, alpha: float = 0.05, alternative: str = "two-sided") -> Result:
    r = ks_two_sample_statistics(a, column_a, b, column_b).first()
    if not r.n1 or not r.n2:
        raise ValueError("a sample is empty")
    d = {"two-sided": r.d, "greater": r.d_plus, "less": r.d_minus}[alternative]
    p = sp.ks_two_sample_sf(d, r.n1, r.n2, alternative)
    return {"statistic": d, "p_value": p, "n_a": r.n1, "n_b": r.n2, "significant": p <= alpha}


def anova_statistics(df: DataFrame, value: str, group: str) -> DataFrame:
    """groups, n, ss_between, ss_within, f, eta_squared, over groups with values."""
    g = df.select(quoted(group).alias("g"), quoted(value).cast("double").alias("x")).where("x is not null and not isnan(x)").groupBy("g").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    total = g.agg(F.count("*").alias("groups"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.sum(F.col("n") * F.col("v")).alias("ss_within"))
    between = g.crossJoin(F.broadcast(total.select("mean"))).agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("mean"), F.lit(2))).alias("ss_between"))
    both = total.drop("mean").crossJoin(between)
    f = F.try_divide(F.col("ss_between") / (F.col("groups") - 1), F.col("ss_within") / (F.col("n") - F.col("groups")))
    return both.select("groups", "n", "ss_between", "ss_within", f.alias("f"), F.try_divide("ss_between", F.col("ss_between") + F.col("ss_within")).alias("eta_squared"))


def one_way_anova(df: DataFrame, value: str, group: str, alpha: float = 0.05) -> Result:
    r = anova_statistics(df, value, group).first()
    if r.groups < 2:
        raise ValueError("at least 2 groups are needed")
    p = 0.0 if r.f is None else sp.f_sf(r.f, r.groups - 1, r.n - r.groups)
    return {"statistic": r.f, "p_value": p, "groups": r.groups, "n": r.n, "eta_squared": r.eta_squared, "effect": band(r.eta_squared or 0, (0.01, 0.06, 0.14), ("negligible", "small", "medium", "large")), "significant": p <= alpha}


def kruskal_statistics(df: DataFrame, value: str, group: str) -> DataFrame:
    """groups, n, h (corrected for ties) and epsilon squared."""
    clean = df.select(quoted(group).alias("g"), quoted(value).cast("double").alias("x")).where("x is not null and not isnan(x)")
    counts = clean.groupBy("x").agg(F.count("*").alias("c"))
    ranks = running_sums(counts, "x", ["c"]).select("x", (F.col("c_upto") - F.col("c") + (F.col("c") + 1) / 2).alias("rank"))
    sums = clean.groupBy("g", "x").agg(F.count("*").alias("k")).join(ranks, "x").groupBy("g").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("rank")).alias("r"))
    ties = counts.agg((1 - F.try_divide(F.sum(F.pow("c", F.lit(3)) - F.col("c")), F.pow(F.sum("c"), F.lit(3)) - F.sum("c"))).alias("correction"))
    one = sums.agg(F.count("*").alias("groups"), F.sum("n").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s")).crossJoin(ties)
    h = F.try_divide(12 / (F.col("n") * (F.col("n") + 1)) * F.col("s") - 3 * (F.col("n") + 1), F.col("correction"))
    return one.select("groups", "n", h.alias("h"), (h / (F.col("n") - 1)).alias("epsilon_squared"))


def kruskal_wallis(df: DataFrame, value: str, group: str, alpha: float = 0.05) -> Result:
    r = kruskal_statistics(df, value, group).first()
    if r.groups < 2:
        raise ValueError("at least 2 groups are needed")
    p = sp.chi2_sf(r.h, r.groups - 1)
    return {"statistic": r.h, "p_value": p, "groups": r.groups, "n": r.n, "epsilon_squared": r.epsilon_squared, "significant": p <= alpha}


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) of the combinations that occur, without nulls."""
    return df.select(quoted(a).alias("a"), quoted(b).alias("b")).dropna().groupBy("a", "b").agg(F.count("*").alias("n"))


def chi_square_statistics(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, rows, columns, chi2 (with Yates' correction for 2 x 2) and Cramer's V. Empty cells add n_i n_j / n."""
    cells = crosstab(df, a, b)
    rows, columns = cells.groupBy("a").agg(F.sum("n").alias("ra")), cells.groupBy("b").agg(F.sum("n").alias("cb"))
    shape = rows.agg(F.count("*").alias("rows"), F.sum("ra").alias("total")).crossJoin(columns.agg(F.count("*").alias("columns")))
    # The grid has as many cells as there are pairs of categories, which is what a crosstab is.
    grid = rows.crossJoin(columns).join(cells, ["a", "b"], "left").crossJoin(F.broadcast(shape))
    expected = F.col("ra") * F.col("cb") / F.col("total")
    gap = F.abs(F.coalesce("n", F.lit(0)) - expected)
    yates = (F.col("rows") == 2) & (F.col("columns") == 2)
    term = F.pow(F.when(yates, gap - F.least(F.lit(0.5), gap)).otherwise(gap), F.lit(2)) / expected
    out = grid.agg(F.first("total").alias("n"), F.first("rows").alias("rows"), F.first("columns").alias("columns"), F.sum(term).alias("chi2"))
    return out.withColumn("cramers_v", F.sqrt(F.try_divide("chi2", F.col("n") * (F.least("rows", "columns") - 1))))


def chi_square(df: DataFrame, a: str, b: str, alpha: float = 0.05) -> Result:
    r = chi_square_statistics(df, a, b).first()
    dof = (r["rows"] - 1) * (r["columns"] - 1)
    if dof < 1:
        raise ValueError("at least 2 categories a side are needed")
    p = sp.chi2_sf(r.chi2, dof)
    return {"statistic": r.chi2, "p_value": p, "dof": dof, "n": r.n, "cramers_v": r.cramers_v, "significant": p <= alpha}


def _two_by_two(df: DataFrame, a: str, b: str) -> tuple[list[list[int]], list, list]:
    cells = crosstab(df, a, b).limit(5).collect()
    rows, columns = sorted({r.a for r in cells}), sorted({r.b for r in cells})
    if len(rows) != 2 or len(columns) != 2:
        raise ValueError("a 2 x 2 table is needed")
    n = {(r.a, r.b): r.n for r in cells}
    return [[n.get((i, j), 0) for j in columns] for i in rows], rows, columns


def fisher_exact(df: DataFrame, a: str, b: str, alpha: float = 0.05, alternative: str = "two-sided") -> Result:
    (p, q), (r, s) = _two_by_two(df, a, b)[0]
    odds = math.inf if q * r == 0 and p * s else math.nan if q * r == 0 else p * s / (q * r)
    value = sp.fisher_exact_p(p, q, r, s, alternative)
    return {"odds_ratio": odds, "p_value": value, "table": [[p, q], [r, s]], "significant": value <= alpha}


def mcnemar_statistics(df: DataFrame, before: str, after: str, yes: object = 1) -> DataFrame:
    """a, b, c, d of the paired table (b: yes to no, c: no to yes), chi2 with continuity correction, and b / c."""
    both = df.select((quoted(before) == F.lit(yes)).alias("x"), (quoted(after) == F.lit(yes)).alias("y")).dropna()
    x, y = F.col("x"), F.col("y")
    t = both.agg(F.count_if(x & y).alias("a"), F.count_if(x & ~y).alias("b"), F.count_if(~x & y).alias("c"), F.count_if(~x & ~y).alias("d"))
    return t.select("*", F.try_divide(F.pow(F.abs(F.col("b") - F.col("c")) - 1, F.lit(2)), F.col("b") + F.col("c")).alias("chi2"), F.try_divide("b", "c").alias("odds_ratio"))


def mcnemar(df: DataFrame, before: str, after: str, yes: object = 1, alpha: float = 0.05) -> Result:
    r = mcnemar_statistics(df, before, after, yes).first()
    p = 1.0 if r.chi2 is None else sp.chi2_sf(r.chi2, 1)
    return {"statistic": r.chi2, "p_value": p, "table": [[r.a, r.b], [r.c, r.d]], "odds_ratio": r.odds_ratio, "significant": p <= alpha}
