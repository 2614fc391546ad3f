"""Reports over groups (scaffolds, clusters, sources) and over data sets and splits, as DataFrames and dictionaries."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import special as sp
from . import chem, similarity, splitting, statistics
from .relational import need, quantiles, quoted, running_sums

SEVERITIES = ("OK", "LOW", "MEDIUM", "HIGH", "CRITICAL")


def group_counts(df: DataFrame, group: str) -> DataFrame:
    return df.where(quoted(group).isNotNull()).groupBy(quoted(group).alias("g")).agg(F.count("*").alias("n"))


def diversity(df: DataFrame, group: str) -> DataFrame:
    """n_groups, n_rows, ratio, gini and shannon (bits) of the sizes of groups. Sizes are counted again, so the ranks of
    the Gini coefficient come from a running sum over different sizes."""
    sizes = group_counts(df, group).groupBy("n").agg(F.count("*").alias("c"))
    ranked = running_sums(sizes, "n", ["c"])
    last, first = F.col("c_upto"), F.col("c_upto") - F.col("c")
    ranks = (last * (last + 1) - first * (first + 1)) / 2  # sum of the places of equal sizes
    totals = sizes.agg(F.sum("c").alias("n_groups"), F.sum(F.col("c") * F.col("n")).alias("n_rows"))
    share = F.col("n") / F.col("n_rows")
    one = ranked.crossJoin(F.broadcast(totals)).agg(F.first("n_groups").alias("n_groups"), F.first("n_rows").alias("n_rows"), F.sum(ranks * F.col("n")).alias("w"), (-F.sum(F.col("c") * share * F.log2(share))).alias("shannon"))
    gini = F.try_divide(2 * F.col("w"), F.col("n_groups") * F.col("n_rows")) - F.try_divide(F.col("n_groups") + 1, F.col("n_groups"))
    return one.select("n_groups", "n_rows", F.try_divide("n_groups", "n_rows").alias("ratio"), gini.alias("gini"), "shannon")


def frequency_bands(df: DataFrame, group: str) -> DataFrame:
    """(band, n_groups, n_rows) of groups of 1, 2 to 5, 6 to 20 and more rows."""
    n = F.col("n")
    band = F.when(n == 1, "1").when(n <= 5, "2-5").when(n <= 20, "6-20").otherwise(">20")
    return group_counts(df, group).groupBy(band.alias("band")).agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_rows"))


def top_groups(df: DataFrame, group: str, k: int = 10) -> DataFrame:
    """The k largest groups (g, n), ties by name."""
    return group_counts(df, group).orderBy(F.desc("n"), "g").limit(k)


def enrichment_statistics(df: DataFrame, group: str, active: str, least: int = 5) -> DataFrame:
    """(g, n, n_active, rate, overall_n, overall_active) of groups of at least `least` rows; active is 0 or 1."""
    need(df, [group, active])
    clean = df.where(quoted(group).isNotNull() & quoted(active).isNotNull())
    g = clean.groupBy(quoted(group).alias("g")).agg(F.count("*").alias("n"), F.count_if(quoted(active) == 1).alias("n_active"))
    total = g.agg(F.sum("n").alias("overall_n"), F.sum("n_active").alias("overall_active"))
    return g.where(F.col("n") >= least).crossJoin(F.broadcast(total)).withColumn("rate", F.col("n_active") / F.col("n"))


def enrichment(df: DataFrame, group: str, active: str, least: int = 5, alpha: float = 0.05) -> DataFrame:
    """enrichment_statistics with p_value (Fisher's exact test, two-sided, on Arrow batches) and class: enriched at a
    rate over 0.7, depleted under 0.3, if significant."""
    import pyarrow as pa

    def test(batches):
        for batch in batches:
            rows = batch.to_pylist()
            p = [sp.fisher_exact_p(r["n_active"], r["n"] - r["n_active"], r["overall_active"] - r["n_active"], r["overall_n"] - r["n"] - r["overall_active"] + r["n_active"]) for r in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, "p_value"])

    stats = enrichment_statistics(df, group, active, least)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema.fields)
    out = stats.mapInArrow(test, f"{kinds}, p_value double")
    sure = F.col("p_value") < alpha
    return out.withColumn("class", F.when(sure & (F.col("rate") > 0.7), "enriched").when(sure & (F.col("rate") < 0.3), "depleted").otherwise("neutral"))


def scaffold_report(df: DataFrame, group: str, active: str | None = None, k: int = 10) -> dict[str, Any]:
    d = diversity(df, group).first().asDict()
    words = {"gini": ("even", "moderately uneven", "very uneven")[sum((d["gini"] or 0) >= x for x in (0.3, 0.6))], "shannon": ("low", "moderate", "high")[sum((d["shannon"] or 0) >= x for x in (2, 4))]}
    out = {"diversity": d, "interpretation": words, "bands": [r.asDict() for r in frequency_bands(df, group).collect()], "top": [r.asDict() for r in top_groups(df, group, k).collect()]}
    if active:
        out["enrichment"] = [r.asDict() for r in enrichment(df, group, active).where("class != 'neutral'").orderBy("p_value", "g").limit(50).collect()]
    return out


def activity_distribution(df: DataFrame, column: str) -> DataFrame:
    """n, mean, median, std (population), min, max, percentiles, skewness, excess kurtosis, and IQR outliers."""
    clean = statistics.values(df, column)
    p10, p25, middle, p75, p90 = (F.lit(q).cast("double") for q in quantiles(clean, [F.col("x")], [0.1, 0.25, 0.5, 0.75, 0.9])[0])
    spread = p75 - p25
    outside = (F.col("x") < p25 - 1.5 * spread) | (F.col("x") > p75 + 1.5 * spread)
    return clean.agg(F.count("*").alias("n"), F.avg("x").alias("mean"), middle.alias("median"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"), p10.alias("p10"), p25.alias("p25"), p75.alias("p75"), p90.alias("p90"), F.skewness("x").alias("skewness"), F.kurtosis("x").alias("kurtosis"), F.count_if(outside).alias("n_outliers"))


def missing_values(df: DataFrame) -> DataFrame:
    """(column, n_missing, pct_missing) of every column, in one pass."""
    number = {f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")}
    gone = lambda c: quoted(c).isNull() | F.isnan(quoted(c)) if c in number else quoted(c).isNull()
    one = df.agg(F.count("*").alias("_n"), *[F.struct(F.lit(c).alias("column"), F.count_if(gone(c)).alias("n_missing")).alias(f"c{k}") for k, c in enumerate(df.columns)])
    return one.select("_n", F.explode(F.array(*[F.col(f"c{k}") for k in range(len(df.columns))])).alias("s")).select("s.column", "s.n_missing", F.coalesce(F.try_divide(100 * F.col("s.n_missing"), F.col("_n")), F.lit(0.0)).alias("pct_missing"))


def quality_report(df: DataFrame, key: str, activity: str | None = None, numbers: Sequence[str] = ()) -> dict[str, Any]:
    """Rows, missing values, duplicate keys, the distribution of the activity, and its correlations with numbers."""
    n = df.count()
    distinct = df.select(quoted(key)).where(quoted(key).isNotNull()).distinct().count()
    there = df.where(quoted(key).isNotNull()).count()
    out: dict[str, Any] = {"n_rows": n, "missing": [r.asDict() for r in missing_values(df).collect()], "n_duplicate_keys": there - distinct}
    if activity:
        out["activity"] = activity_distribution(df, activity).first().asDict()
        out["correlations"] = {c: {"pearson": statistics.pearson(df, activity, c), "spearman": statistics.spearman(df, activity, c)} for c in numbers}
    issues = [f"{r['column']}: {r['pct_missing']:.1f} % missing" for r in out["missing"] if r["pct_missing"] > 5]
    if out["n_duplicate_keys"]:
        issues.append(f"{out['n_duplicate_keys']} rows with a repeated key")
    return out | {"issues": issues}


def near_rows(df: DataFrame, others: DataFrame, key: str, vector: str, similar: float = 0.9, metric: str = "tanimoto") -> int:
    """How many different (key, vector) of df have one of others at least so similar; of all pairs, block by block."""
    side = lambda d: d.where(quoted(vector).isNotNull()).select(F.xxhash64(quoted(key), quoted(vector)).alias("id"), quoted(vector).alias("v")).dropDuplicates(["id"])
    return similarity.nearest_neighbors(side(df), side(others), "id", "v", 1, metric, exclude_self=False).where(F.col("sim") >= similar).count()


def shared_but_stereo(a: DataFrame, b: DataFrame, smiles: str) -> int:
    """How many different molecules without stereo marks are in both, where one has marks and the SMILES differ. Marks
    are not perceived: one molecule with marks in two spellings counts, too."""

    def side(df: DataFrame, name: str) -> DataFrame:
        plain = chem.STEPS["flatten_stereo"][1]
        flat = chem.clean(df.select(F.trim(quoted(smiles)).alias("s")).distinct(), "s", "flatten_stereo")
        return flat.where(quoted(plain).isNotNull()).select(quoted(plain).alias("k"), F.col("s").alias(name), F.col("s").rlike(r"[@/\\]").alias(f"{name}_marks")).distinct()

    return side(a, "x").join(side(b, "y"), "k").where("x <> y AND (x_marks OR y_marks)").select("k").distinct().count()


def split_report(df: DataFrame, key: str, label: str, split: str = "split", group: str | None = None, numbers: Sequence[str] = (), alpha: float = 0.05, least: int = 50, vector: str | None = None, similar: float = 0.9, metric: str = "tanimoto", smiles: str | None = None) -> dict[str, Any]:
    """Checks of a split: sizes, exact duplicates (CRITICAL), group leakage, drift of numbers and of the label; with a
    vector, rows whose nearest one in another split is at least `similar` (HIGH); with smiles, molecules in two splits
    that differ in stereo marks only (MEDIUM). The report's severity is the worst of its checks'."""
    names = sorted(r[0] for r in df.select(quoted(split)).distinct().collect())
    part = {s: df.where(quoted(split) == s) for s in names}
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    sizes = [r.asDict() for r in splitting.split_characteristics(df, split, label).collect()]
    checks: dict[str, dict[str, Any]] = {"sizes": {"splits": sizes, "severity": "MEDIUM" if any(s["n"] < least or s["share"] < 0.1 for s in sizes) else "OK"}}
    shared = {f"{a}-{b}": splitting.shared_keys(part[a], part[b], key).count() for a, b in pairs}
    checks["duplicates"] = {"shared": shared, "severity": "CRITICAL" if any(shared.values()) else "OK"}
    if vector:
        near = {f"{a}-{b}": {"of_first": near_rows(part[a], part[b], key, vector, similar, metric), "of_second": near_rows(part[b], part[a], key, vector, similar, metric)} for a, b in pairs}
        checks["similarity"] = {"near": near, "threshold": similar, "severity": "HIGH" if any(n for x in near.values() for n in x.values()) else "OK"}
    if smiles:
        stereo = {f"{a}-{b}": shared_but_stereo(part[a], part[b], smiles) for a, b in pairs}
        checks["stereo"] = {"shared": stereo, "severity": "MEDIUM" if any(stereo.values()) else "OK"}
    if group:
        rows = [r.asDict() for r in splitting.group_leakage(df, group, split).collect()]
        checks["groups"] = {"pairs": rows, "severity": max((r["severity"] for r in rows), key=SEVERITIES.index, default="OK")}
    drift = {f"{a}-{b}:{c}": statistics.ks_two_sample(part[a], c, part[b], c, alpha) for a, b in pairs for c in numbers}
    checks["properties"] = {"tests": drift, "severity": "MEDIUM" if any(t["significant"] for t in drift.values()) else "OK"}
    classes = df.agg(F.count_distinct(quoted(label))).first()[0]
    if classes <= 2:
        test = statistics.chi_square(df, split, label, alpha) if classes == 2 and len(names) > 1 else None
        checks["label"] = {"test": test, "severity": "MEDIUM" if test and test["significant"] else "OK"}
    else:
        tests = {f"{a}-{b}": statistics.ks_two_sample(part[a], label, part[b], label, alpha) for a, b in pairs}
        checks["label"] = {"tests": tests, "severity": "MEDIUM" if any(t["significant"] for t in tests.values()) else "OK"}
    return {"checks": checks, "n_checks": len(checks), "severity": max((c["severity"] for c in checks.values()), key=SEVERITIES.index)}
