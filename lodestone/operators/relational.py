"""Relational operators on data sets. Where the order of rows matters, `order` names the columns that fix it."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import assignment, to_sql
from ..plans.tables import materialise

ROW_ID = "_row_id"
#: Rows that one task may sort to finish a quantile; the accuracy of the sketches before that, and a margin above it.
QUANTILE_ROWS = 100_000
_SKETCH = 10_000
_SKETCH_MARGIN = 3 / _SKETCH


def quoted(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def need(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}; there are {df.columns}")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing numbers become NULL, which aggregates pass over."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[F.when(~F.isnan(quoted(c)), quoted(c)).alias(c) if c in floats else quoted(c) for c in df.columns])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = ROW_ID) -> DataFrame:
    """df with a dense row number from 0 in the given order.

    Numbers come from a range partitioning: each partition ranks its own rows and adds the rows before it, so no task
    sees more than its share (an unpartitioned window would see all). The partition sizes, one long each, are the only
    thing joined. The places are written down once: partitions are cut by samples and merged as the run goes, so two
    evaluations need not agree."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_number", F.monotonically_increasing_id())
    dealt = materialise(dealt)
    part, within = F.shiftright("_number", 33), F.col("_number").bitwiseAND((1 << 33) - 1)
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return dealt.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + within).drop("_number", "_part", "_before")


def quantiles(df: DataFrame, columns: Sequence[Column], probabilities: Sequence[float], rows: int = QUANTILE_ROWS) -> list[list[float | None]]:
    """The exact quantiles of each column, linear between neighbours; None without values. Nulls are passed over.

    Each wanted place is enclosed by two values of a sketch, and the rows below, at, between and above them are counted,
    in one pass for all; that leaves about a thousandth of the rows each time, until `rows` or fewer lie between, which
    one task sorts. So no task holds more, however many rows or different values there are."""
    data = df.select(*[c.cast("double").alias(f"_{k}") for k, c in enumerate(columns)])
    counts = data.agg(*[F.count(c).alias(c) for c in data.columns]).first()
    places = [[p * (counts[k] - 1) for p in probabilities] for k in range(len(columns))]
    wanted = sorted({(k, at) for k, x in enumerate(places) if counts[k] for place in x for at in (math.floor(place), math.ceil(place))})
    found: dict[tuple[int, int], float] = {}
    #: the open interval that holds the place, the rows up to it and those in it
    open_ = {t: (None, None, 0, counts[t[0]]) for t in wanted}

    def inside(t: tuple[int, int]) -> Column:
        x, (low, high, _, _) = F.col(f"_{t[0]}"), open_[t]
        kept = x.isNotNull()
        kept = kept if low is None else kept & (x > low)
        return F.when(kept if high is None else kept & (x < high), x)

    while open_:
        few = [t for t, (_, _, _, n) in open_.items() if n <= rows]
        if few:
            row = data.agg(*[F.sort_array(F.collect_list(inside(t)))[t[1] - open_[t][2]].alias(f"v{i}") for i, t in enumerate(few)]).first()
            for i, t in enumerate(few):
                found[t] = row[f"v{i}"]
                del open_[t]
        many = list(open_)
        if not many:
            break
        around = [[min(1.0, max(0.0, (t[1] - below) / n + e)) for e in (-_SKETCH_MARGIN, _SKETCH_MARGIN)] for t in many for _, _, below, n in [open_[t]]]
        edges = data.agg(*[F.percentile_approx(inside(t), F.array(*map(F.lit, a)), F.lit(_SKETCH)).alias(f"e{i}") for i, (t, a) in enumerate(zip(many, around, strict=True))]).first()
        counted = []
        for i, t in enumerate(many):
            x, (a, b) = inside(t), edges[f"e{i}"]
            counted += [F.count_if(c).alias(f"c{i}_{j}") for j, c in enumerate((x < a, x == a, (x > a) & (x < b), (x == b) & F.lit(a != b)))]
        row = data.agg(*counted).first()
        for i, t in enumerate(many):
            (low, high, below, n), (a, b) = open_[t], edges[f"e{i}"]
            under, at_a, between, at_b = (row[f"c{i}_{j}"] for j in range(4))
            for value, span, size in ((None, (low, a), under), (a, None, at_a), (None, (a, b), between), (b, None, at_b), (None, (b, high), n - under - at_a - between - at_b)):
                if t[1] < below + size:
                    if span is None:
                        found[t] = value
                        del open_[t]
                    else:
                        open_[t] = (*span, below, size)
                    break
                below += size
    out: list[list[float | None]] = []
    for k, x in enumerate(places):
        values = []
        for place in x:
            low, high = math.floor(place), math.ceil(place)
            a, b = found.get((k, low)), found.get((k, high))
            values.append(a if a is None or low == high or a == b else (high - place) * a + (place - low) * b)
        out.append(values)
    return out


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float]) -> DataFrame:
    """(the keys, n, q0, q1, ...): exact quantiles of each group, linear between neighbours. Nulls and NaN are passed
    over, and groups without values have no row; null keys are a group.

    Different values are counted, dealt by range of (keys, value) and numbered by running sums over that order, less
    the rows of the groups before; of each group only the values at the wanted places are kept, by aggregates. So a
    group may hold all rows: no task sees more than a range of its values."""
    need(df, [*keys, value])
    names = [f"_k{i}" for i in range(len(keys))]
    x = quoted(value).cast("double")
    counts = df.select(*[quoted(c).alias(n) for c, n in zip(keys, names, strict=True)], x.alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)").groupBy(*names, (F.col("_v") + 0.0).alias("_v")).agg(F.count("*").alias("_n"))
    placed = materialise(running_sums(counts.withColumn("_o", F.struct(*names, "_v")), "_o", ["_n"]))
    groups = placed.groupBy(*names).agg(F.sum("_n").alias("n"), F.min(F.col("_n_upto") - F.col("_n")).alias("_start"))
    same = [F.col(f"l.{n}").eqNullSafe(F.col(f"r.{n}")) for n in names]
    rows = placed.alias("l").join(groups.alias("r"), same).select(*[f"r.{n}" for n in names], "r.n", "l._v", (F.col("l._n_upto") - F.col("r._start")).alias("_upto"), "l._n")
    wanted = []
    for k, p in enumerate(probabilities):
        place = F.lit(float(p)) * (F.col("n") - 1)
        for side, at in (("a", F.floor(place)), ("b", F.ceil(place))):
            wanted.append(F.max(F.when((F.col("_upto") > at) & (F.col("_upto") - F.col("_n") <= at), F.col("_v"))).alias(f"_{side}{k}"))
    found = rows.groupBy(*names, "n").agg(*wanted)
    out = []
    for k, p in enumerate(probabilities):
        place = F.lit(float(p)) * (F.col("n") - 1)
        share, a, b = place - F.floor(place), F.col(f"_a{k}"), F.col(f"_b{k}")
        out.append(F.when(a == b, a).otherwise(a * (1 - share) + b * share).alias(f"q{k}"))
    return found.select(*[F.col(n).alias(c) for c, n in zip(keys, names, strict=True)], "n", *out)


def head(df: DataFrame, n: int, order: Sequence[str | Column]) -> DataFrame:
    """The first n rows."""
    return df.orderBy(*order).limit(n)


def full(df: DataFrame, max_rows: int, order: Sequence[str | Column]) -> tuple[DataFrame, bool]:
    """At most max_rows rows, and whether there are more."""
    return head(df, max_rows, order), df.limit(max_rows + 1).count() > max_rows


def summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row a column: numbers have count, n_missing, min, max, mean, median and std; others count, n_missing,
    n_unique, top_value and top_freq (ties to the smaller value). One pass for the numbers."""
    columns = list(columns or df.columns)
    need(df, columns)
    numbers = [c for c in columns if c in numeric_columns(df)]
    others = [c for c in columns if c not in numbers]
    blank = {k: F.lit(None).cast(t) for k, t in (("min", "double"), ("max", "double"), ("mean", "double"), ("median", "double"), ("std", "double"), ("n_unique", "long"), ("top_value", "string"), ("top_freq", "long"))}
    rows = []
    clean = nan_to_null(df.select(*[quoted(c) for c in columns]))
    medians = dict(zip(numbers, [q[0] for q in quantiles(clean, [quoted(c) for c in numbers], [0.5])], strict=True)) if numbers else {}
    for k, c in enumerate(numbers):
        x, middle = quoted(c).cast("double"), F.lit(medians[c]).cast("double")
        rows.append((k, c, F.struct(F.lit(c).alias("column"), F.count(x).alias("count"), (F.count("*") - F.count(x)).alias("n_missing"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), middle.alias("median"), F.stddev_samp(x).alias("std"))))
    out = None
    if rows:
        one = clean.agg(*[s.alias(f"c{k}") for k, _, s in rows])
        long = one.select(F.explode(F.array(*[F.col(f"c{k}") for k, _, _ in rows])).alias("s")).select("s.*")
        out = long.select("column", "count", "n_missing", "min", "max", "mean", "median", "std", *[blank[k].alias(k) for k in ("n_unique", "top_value", "top_freq")])
    for c in others:
        counts = clean.groupBy(quoted(c).cast("string").alias("v")).agg(F.count("*").alias("n"))
        known = F.col("v").isNotNull()
        part = counts.agg(
            F.lit(c).alias("column"), F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("count"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("n_missing"),
            F.count("v").alias("n_unique"), F.min(F.when(known, F.struct((-F.col("n")).alias("m"), "v"))).alias("t"),
        ).select("column", "count", "n_missing", *[blank[k].alias(k) for k in ("min", "max", "mean", "median", "std")], "n_unique", F.col("t.v").alias("top_value"), (-F.col("t.m")).alias("top_freq"))
        out = part if out is None else out.unionByName(part)
    return out


def inspect(df: DataFrame, order: Sequence[str | Column], row_indices: Sequence[int] | None = None, condition: str | None = None, max_rows: int = 100) -> DataFrame:
    """Rows by their places in order, or by a filter expression; at most max_rows."""
    if (row_indices is None) == (condition is None):
        raise ValueError("give row_indices or condition")
    if condition is not None:
        return head(subset(df, condition), max_rows, order)
    n = df.count()
    bad = [i for i in row_indices if not 0 <= i < n]
    if bad:
        raise ValueError(f"row indices out of range 0..{n - 1}: {bad}")
    return numbered(df, order).where(F.col(ROW_ID).isin(list(row_indices)[:max_rows])).orderBy(ROW_ID).drop(ROW_ID)


def drop_where(df: DataFrame, column: str, value: object = None) -> DataFrame:
    """Drop rows whose column is null (value None), or equals value; nulls stay in the latter case."""
    need(df, [column])
    return df.where(quoted(column).isNotNull() if value is None else ~quoted(column).eqNullSafe(F.lit(value)))


def subset(df: DataFrame, condition: str) -> DataFrame:
    return df.where(F.expr(to_sql(condition)))


def drop_duplicate_rows(df: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each combination of columns. min_by keeps one row a key in every partial aggregate, so a hot
    key costs no more than another."""
    need(df, columns)
    keys = [quoted(c) for c in columns]
    row = F.struct(*[quoted(c).alias(c) for c in df.columns])
    return df.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min_by(row, F.struct(*[quoted(c) for c in order])).alias("_r")).select("_r.*")


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.dropna(how="all")


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    need(df, columns)
    if not set(df.columns) - set(columns):
        raise ValueError("no column would be left")
    return df.select(*[quoted(c) for c in df.columns if c not in set(columns)])


def keep_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    need(df, columns)
    return df.select(*[quoted(c) for c in columns])


def transform(df: DataFrame, expression: str) -> DataFrame:
    """Add or replace a column: `name = expression`."""
    column, sql = assignment(expression)
    return df.withColumn(column, F.expr(sql))


def scramble(df: DataFrame, column: str, order: Sequence[str], seed: int = 0) -> DataFrame:
    """df with the values of one column permuted: the k-th row in order takes the value of the k-th in the order of
    md5(seed, row's key)."""
    need(df, [column, *order])
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), *[quoted(c).cast("string") for c in order]))
    values = numbered(df.select(quoted(column).alias("_v"), key.alias("_key"), *[quoted(c) for c in order]), ["_key", *order]).select(ROW_ID, "_v")
    moved = numbered(df, order).join(values, ROW_ID)
    return moved.select(*[F.col("_v").alias(column) if c == column else quoted(c) for c in df.columns])


def combine_vertical(parts: Sequence[DataFrame], duplicates: str = "keep_all", verify_columns: bool = True) -> DataFrame:
    """Union by name; duplicates: keep_all, drop, or raise."""
    if duplicates not in ("keep_all", "drop", "raise"):
        raise ValueError(f"unknown handling of duplicates: {duplicates}")
    if verify_columns and len({frozenset(p.columns) for p in parts}) > 1:
        raise ValueError("the data sets have different columns")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=not verify_columns)
    if duplicates == "keep_all":
        return out
    distinct = out.distinct()
    if duplicates == "raise" and out.groupBy(*[quoted(c) for c in out.columns]).count().where("count > 1").limit(1).count():
        raise ValueError("there are duplicate rows")
    return distinct


def combine_horizontal(left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str], on_mismatch: str = "raise") -> DataFrame:
    """Rows side by side, by their places in order. Different lengths raise, or pad with nulls."""
    both = set(left.columns) & set(right.columns)
    if both:
        raise ValueError(f"columns on both sides: {sorted(both)}")
    if on_mismatch == "raise" and left.count() != right.count():
        raise ValueError("the data sets have different numbers of rows")
    return numbered(left, left_order).join(numbered(right, right_order), ROW_ID, "inner" if on_mismatch == "raise" else "full").drop(ROW_ID)


def merge(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner", suffixes: tuple[str, str] = ("_x", "_y"), key_name: str = "smiles") -> DataFrame:
    """Equi-join on a key that becomes the first column; rows with a null key are dropped; names on both sides get
    suffixes."""
    if how not in ("inner", "left", "right", "outer"):
        raise ValueError(f"unknown join: {how}")
    need(left, [left_key])
    need(right, [right_key])
    shared = (set(left.columns) - {left_key}) & (set(right.columns) - {right_key})
    side = lambda df, key, suffix: df.where(quoted(key).isNotNull()).select(quoted(key).alias("_key"), *[quoted(c).alias(c + suffix if c in shared or c == key_name else c) for c in df.columns if c != key])
    out = side(left, left_key, suffixes[0]).join(side(right, right_key, suffixes[1]), "_key", how)
    return out.withColumnRenamed("_key", key_name)


def filter_ranges(df: DataFrame, ranges: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Rows in all inclusive ranges; nulls and NaN are out."""
    need(df, list(ranges))
    for column, bounds in ranges.items():
        df = df.where(_inside(column, *bounds))
    return df


def _inside(column: str, low: float | None, high: float | None) -> Column:
    x = quoted(column)
    ok = x.isNotNull() & ~F.isnan(x.cast("double"))
    if low is not None:
        ok = ok & (x >= low)
    return ok & (x <= high) if high is not None else ok


def range_removals(df: DataFrame, ranges: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """How many rows each range removes of those that the ranges before it left: filter, n_removed. One pass."""
    need(df, list(ranges))
    passed, aggregates = F.lit(True), []
    for k, (column, bounds) in enumerate(ranges.items()):
        inside = F.coalesce(_inside(column, *bounds), F.lit(False))
        aggregates.append(F.struct(F.lit(column).alias("filter"), F.count_if(passed & ~inside).alias("n_removed")).alias(f"c{k}"))
        passed = passed & inside
    one = df.agg(*aggregates)
    return one.select(F.explode(F.array(*one.columns)).alias("s")).select("s.*")


def correlation_matrix(df: DataFrame, columns: Sequence[str], method: str = "pearson") -> DataFrame:
    """(a, b, n, corr) of all pairs of columns over rows where both are there. Spearman ranks each pair on its own."""
    need(df, columns)
    clean = nan_to_null(df.select(*[quoted(c).cast("double").alias(c) for c in columns]))
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    if method == "pearson":
        both = lambda a, b: quoted(a).isNotNull() & quoted(b).isNotNull()
        one = clean.agg(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count_if(both(a, b)).alias("n"), F.corr(F.when(both(a, b), quoted(a)), F.when(both(a, b), quoted(b))).alias("corr")).alias(f"p{k}") for k, (a, b) in enumerate(pairs)])
        return one.select(F.explode(F.array(*one.columns)).alias("s")).select("s.*")
    if method != "spearman":
        raise ValueError(f"unknown method: {method}")
    out = None
    for a, b in pairs:
        ranked = average_ranks(average_ranks(clean.select(quoted(a).alias("x"), quoted(b).alias("y")).dropna(), "x", "rx"), "y", "ry")
        part = ranked.agg(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count("*").alias("n"), F.corr("rx", "ry").alias("corr"))
        out = part if out is None else out.unionByName(part)
    return out


def average_ranks(df: DataFrame, column: str, name: str, partition: Sequence[str] = ()) -> DataFrame:
    """df with the average rank of column (ties share it). Values are counted first, so the running sum that gives the
    ranks goes over different values, dealt by range, and a hot value is one row of it."""
    x = quoted(column)
    keys = [quoted(c) for c in partition]
    counts = df.where(x.isNotNull()).groupBy(*keys, x.alias("_v")).agg(F.count("*").alias("_n"))
    running = running_sums(counts, "_v", ["_n"], partition)
    ranks = running.select(*keys, "_v", (F.col("_n_upto") - F.col("_n") + (F.col("_n") + 1) / 2).alias(name))
    conditions = df.alias("l").join(ranks.alias("r"), [F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`")) for c in partition] + [F.col(f"l.`{column}`") == F.col("r._v")], "left")
    return conditions.select("l.*", F.col(f"r.`{name}`"))


def running_sums(df: DataFrame, order: str, columns: Sequence[str], partition: Sequence[str] = ()) -> DataFrame:
    """df with `<column>_upto`: the sum of column over rows up to this one in the order of a unique column.

    Without a partition the rows are range-partitioned, summed within each part, and moved up by the sums of the parts
    before (one row a part); with one, a window over the partition does it."""
    if partition:
        w = Window.partitionBy(*[quoted(c) for c in partition]).orderBy(quoted(order)).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(quoted(c)).over(w).alias(f"{c}_upto") for c in columns])
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, quoted(order)).withColumn("_part", F.spark_partition_id())
    dealt = materialise(dealt)
    within = Window.partitionBy("_part").orderBy(quoted(order)).rowsBetween(Window.unboundedPreceding, 0)
    totals = dealt.groupBy("_part").agg(*[F.sum(quoted(c)).alias(f"_s{k}") for k, c in enumerate(columns)])
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_part", *[F.coalesce(F.sum(f"_s{k}").over(ahead), F.lit(0)).alias(f"_b{k}") for k in range(len(columns))])
    local = dealt.select("*", *[F.sum(quoted(c)).over(within).alias(f"_l{k}") for k, c in enumerate(columns)])
    out = local.join(F.broadcast(before), "_part")
    return out.select(*[quoted(c) for c in df.columns], *[(F.col(f"_l{k}") + F.col(f"_b{k}")).alias(f"{c}_upto") for k, c in enumerate(columns)])


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, low, high, n) of equal bins from the least to the largest value; the last bin is closed. Empty bins stay."""
    x = quoted(column).cast("double")
    clean = df.select(x.alias("x")).where("x is not null and not isnan(x)")
    bounds = clean.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1))).cast("int")
    counts = clean.crossJoin(F.broadcast(bounds)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    grid = bounds.where("lo is not null").select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def box_stats(df: DataFrame, column: str, group: str | None = None) -> DataFrame:
    """n, min, q1, median, q3, max of a column, by group."""
    clean = nan_to_null(df.select(quoted(column).cast("double").alias("x"), *([quoted(group).alias("group")] if group else []))).where("x is not null")
    if not group:
        q1, middle, q3 = (F.lit(q).cast("double") for q in quantiles(clean, [F.col("x")], [0.25, 0.5, 0.75])[0])
        return clean.agg(F.count("x").alias("n"), F.min("x").alias("min"), q1.alias("q1"), middle.alias("median"), q3.alias("q3"), F.max("x").alias("max"))
    ends = clean.groupBy("group").agg(F.min("x").alias("min"), F.max("x").alias("max"))
    inner = group_quantiles(clean, ["group"], "x", [0.25, 0.5, 0.75])
    both = inner.alias("l").join(ends.alias("r"), F.col("l.group").eqNullSafe(F.col("r.group")))
    return both.select("l.group", "l.n", "r.min", F.col("l.q0").alias("q1"), F.col("l.q1").alias("median"), F.col("l.q2").alias("q3"), "r.max")


def pivot(df: DataFrame, row: str, column: str, value: str, aggregation: str = "mean") -> DataFrame:
    """One row for each value of row, one column for each of column."""
    how = {"mean": F.avg, "median": F.median, "count": F.count, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum}
    if aggregation not in how:
        raise ValueError(f"unknown aggregation: {aggregation}")
    need(df, [row, column, value])
    return df.where(quoted(column).isNotNull()).groupBy(quoted(row).alias(row)).pivot(column).agg(how[aggregation](quoted(value)))


def density(df: DataFrame, column: str, points: int = 500, bandwidth: str | float = "scott", margin: float = 0.1) -> DataFrame:
    """(x, density): a Gaussian kernel estimate over the range and a margin. Values are counted first, and each is
    spread over the grid, a constant number of rows."""
    clean = df.select(quoted(column).cast("double").alias("v")).where("v is not null and not isnan(v)")
    stats = clean.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.stddev_samp("v").alias("s"), F.count("*").alias("n"))
    factor = {"scott": F.pow("n", F.lit(-0.2)), "silverman": F.pow(F.col("n") * 0.75, F.lit(-0.2))}
    if isinstance(bandwidth, str) and bandwidth not in factor:
        raise ValueError(f"unknown bandwidth: {bandwidth}")
    h = F.col("s") * (factor[bandwidth] if isinstance(bandwidth, str) else F.lit(float(bandwidth)))
    pad = (F.col("hi") - F.col("lo")) * margin
    step = (F.col("hi") - F.col("lo") + 2 * pad) / (points - 1)
    known = stats.select(h.alias("h"), "n", (F.col("lo") - pad).alias("from"), step.alias("step")).where("h > 0")
    counts = clean.groupBy("v").agg(F.count("*").alias("c")).crossJoin(F.broadcast(known))
    spread = counts.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    x = F.col("from") + F.col("i") * F.col("step")
    kernel = F.exp(-0.5 * F.pow((x - F.col("v")) / F.col("h"), F.lit(2))) / (F.col("h") * 2.5066282746310002)
    return spread.groupBy("i").agg(F.first(x).alias("x"), (F.sum(F.col("c") * kernel) / F.first("n")).alias("density")).select("x", "density")
