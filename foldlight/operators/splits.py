"""Folds and hold-outs. Random order is md5 of seed and key, so any engine draws the same split.

Exact ranks over all rows come from hash buckets and offsets (see ranked()), never from one global window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_quantiles

#: Rows of a bucket of ranked(), on average, buckets that are summed up in one window, rows that a task sorts, and
#: counts of buckets that are sent to the rows.
BUCKET_ROWS, SPAN, TASK_ROWS, SENT = 4096, 1024, 1 << 19, 1 << 17


def shuffle_key(key: Column, seed: int) -> Column:
    """md5 of seed and key; a null key counts as an empty text."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit(""))))


def met(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join by equal or equally missing values; without columns to join by, right is one row."""
    if not on:
        return left.crossJoin(F.broadcast(right))  # one row
    same = F.lit(True)
    for c in on:
        same = same & F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`"))
    return left.alias("l").join(right.alias("r"), same, how).select("l.*", *(F.col(f"r.`{c}`") for c in right.columns if c not in on))


def ranked(df: DataFrame, order: Column, by: list[str] | None = None, name: str = "rank", size: str | None = None) -> DataFrame:
    """Adds `name` (from 0) in the order of an md5 text, inside each combination of `by` if given, and with `size` the
    rows of the combination under that name.

    Rows are dealt to even buckets of the order, as many as the largest combination needs, and to tasks of about
    TASK_ROWS; rows before a bucket come from two levels of bucket counts. So no window holds more than about a bucket
    or SPAN buckets' counts.
    """
    by = by or []
    sizes = df.groupBy(*by).agg(F.count("*").alias("__n")).agg(F.max("__n").alias("most"), F.sum("__n").alias("rows"), F.count("*").alias("groups")).first()
    buckets = max(1, -(-(sizes["most"] or 0) // BUCKET_ROWS))
    at = F.floor(F.conv(F.substring("__order", 1, 8), 16, 10).cast("double") / float(1 << 32) * buckets)
    dealt = df.withColumn("__order", order).withColumn("__bucket", at).withColumn("__order", F.unhex("__order"))
    counts = dealt.groupBy(*by, "__bucket").agg(F.count("*").alias("__n")).withColumn("__span", F.floor(F.col("__bucket") / SPAN))
    sums = counts.groupBy(*by, "__span").agg(F.sum("__n").alias("__n"))
    upto = lambda order_, *of: F.coalesce(F.sum("__n").over(Window.partitionBy(*by, *of).orderBy(order_).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum("__n").over(Window.partitionBy(*by))  # one row a span
    spans = sums.withColumns({"__far": upto("__span")} | ({size: whole} if size else {})).drop("__n")
    extra = [size] if size else []
    before = met(counts.withColumn("__near", upto("__bucket", "__span")), spans, [*by, "__span"]).select(*by, "__bucket", *extra, (F.col("__far") + F.col("__near")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(*by, "__bucket").orderBy("__order")) - 1
    before = F.broadcast(before) if buckets * sizes["groups"] <= SENT else before
    if (sizes["rows"] or 0) > TASK_ROWS:
        dealt = dealt.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sizes["rows"] // TASK_ROWS)), *by, "__bucket")
    return met(dealt.withColumn("__inside", inside), before, [*by, "__bucket"]).withColumn(name, F.col("__before") + F.col("__inside")).drop("__order", "__bucket", "__inside", "__before")


def shuffled_folds(df: DataFrame, key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Adds `fold`: sizes differ by one at most."""
    return ranked(df, shuffle_key(F.col(key), seed), name="__rank").withColumn("fold", (F.col("__rank") % folds).cast("int")).drop("__rank")


def stratified_folds(df: DataFrame, key: str, label: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Adds `fold`: balanced inside every class."""
    return ranked(df, shuffle_key(F.col(key), seed), [label], "__rank").withColumn("fold", (F.col("__rank") % folds).cast("int")).drop("__rank")


def dealt_sizes(sizes: list[tuple[int, int]], folds: int) -> list[tuple[int, int, int, list[int]]]:
    """How groups go to the lightest fold (then the lowest), largest first: for (size, how many groups), descending,
    rows (size, first, end, turn): groups number first .. end - 1 of that size take the folds of `turn` in turn."""
    load, out = [0] * folds, []
    for size, many in sizes:
        at = 0
        while at < many:
            low = min(load)
            turn = sorted((k for k in range(folds) if load[k] < low + size), key=lambda k: (load[k], k))
            rest = [x for x in load if x >= low + size]
            cycles = min((min(rest) - low) // size if rest else many, -(-(many - at) // len(turn)))  # until another fold is light enough too
            n = min(many - at, cycles * len(turn))
            out.append((size, at, at + n, turn))
            for i, k in enumerate(turn):
                load[k] += size * (n // len(turn) + (i < n % len(turn)))
            at += n
    return out


def group_folds(df: DataFrame, group: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Adds `fold`: groups stay whole, by size descending (then shuffled), each to the lightest fold (then the
    lowest). The driver deals out counts of groups by size alone (N rows have at most sqrt(2 N) different
    sizes); groups take their fold by their rank among those of their size."""
    sizes = df.groupBy(group).agg(F.count("*").alias("_size"))
    counts = sizes.groupBy("_size").agg(F.count("*").alias("n")).orderBy(F.desc("_size")).collect()
    plan = df.sparkSession.createDataFrame(dealt_sizes([(r["_size"], r["n"]) for r in counts], folds), "_size long, _first long, _end long, _turn array<int>")
    groups = ranked(sizes, shuffle_key(F.col(group), seed), ["_size"])
    mine = groups.join(plan, "_size").where((F.col("rank") >= F.col("_first")) & (F.col("rank") < F.col("_end")))
    table = mine.select(F.col(group).alias("_g"), F.get("_turn", ((F.col("rank") - F.col("_first")) % F.size("_turn")).cast("int")).alias("fold"))
    return df.join(table, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


#: Different class counts of groups that go through the driver.
MOST_KINDS = 20_000


def stratified_group_folds(df: DataFrame, group: str, label: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Adds `fold`: groups stay whole; each goes where it leaves the class counts of folds most even, largest first.

    Groups with the same class counts are one kind: as many as make whole rounds go to all folds alike, the rest
    one by one. The driver holds one row for each kind, groups take their fold by their rank in it. Beyond MOST_KINDS
    kinds, groups whose class counts are alike (within a factor of about 1.4, or whose sizes are) are one kind, with its
    mean counts, so that what the driver holds doesn't grow with the groups; folds are then even on average."""
    counts = df.groupBy(group, label).agg(F.count("*").alias("n")).groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(label).cast("string").alias("c"), "n"))).alias("c"), F.sum("n").alias("n"))
    alike = F.transform("c", lambda x: F.struct(x["c"].alias("c"), F.floor(2 * F.log2(x["n"])).alias("n")))
    for kind in (F.to_json("c"), F.to_json(alike), F.floor(4 * F.log2("n")).cast("string")):
        groups = counts.withColumn("_kind", kind)
        if groups.select("_kind").distinct().count() <= MOST_KINDS:
            break
    each = groups.groupBy("_kind").agg(F.avg("n").alias("n"), F.count("*").alias("many"))
    sums = groups.select("_kind", F.explode("c").alias("x")).groupBy("_kind", "x.c").agg(F.sum("x.n").alias("n"))
    mean = sums.join(each.select("_kind", "many"), "_kind").groupBy("_kind").agg(F.array_sort(F.collect_list(F.struct("c", (F.col("n") / F.col("many")).alias("n")))).alias("c"))  # one entry a class
    rows = each.join(mean, "_kind").orderBy(F.desc("n"), "_kind").collect()
    labels = sorted({x["c"] for r in rows for x in r["c"]}, key=str)
    total = {x: sum(y["n"] * r["many"] for r in rows for y in r["c"] if y["c"] == x) for x in labels}
    have, placed = [dict.fromkeys(labels, 0) for _ in range(folds)], []
    for r in rows:
        own, even = {x["c"]: x["n"] for x in r["c"]}, r["many"] // folds
        for k in range(folds):
            for x, n in own.items():
                have[k][x] += n * even
        rest = []
        for _ in range(r["many"] % folds):

            def uneven(k: int, own: dict[str, int] = own) -> tuple[float, int, int]:
                spread = 0.0
                for x in labels:
                    shares = [(have[j][x] + (own.get(x, 0) if j == k else 0)) / total[x] for j in range(folds)]
                    mean = sum(shares) / folds
                    spread += sum((s - mean) ** 2 for s in shares)
                return round(spread, 12), sum(have[k].values()), k

            k = min(range(folds), key=uneven)
            rest.append(k)
            for x, n in own.items():
                have[k][x] += n
        placed.append((r["_kind"], even * folds, rest))
    plan = df.sparkSession.createDataFrame(placed, "_kind string, _even long, _rest array<int>")
    places = ranked(groups.select(F.col(group).alias("_g"), "_kind"), shuffle_key(F.col("_g"), seed), ["_kind"]).join(plan, "_kind")
    fold = F.when(F.col("rank") < F.col("_even"), (F.col("rank") % folds).cast("int")).otherwise(F.get("_rest", (F.col("rank") - F.col("_even")).cast("int")))
    return df.join(places.select("_g", fold.alias("fold")), F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def regression_strata(df: DataFrame, target: str, folds: int = 5, bins: int = 5) -> DataFrame:
    """Adds `stratum`: quantile bins, fewer until each has a row for every fold; 0 throughout if two bins are too many.
    One pass finds the quantiles of all numbers of bins, another counts their rows. Rows without a value are bin -1."""
    from ..functions.labels import bin_index

    levels = range(bins, 1, -1)
    at = sorted({i / n for n in levels for i in range(n + 1)})
    found = exact_quantiles(df, [], target, at).first() if at else None  # one row
    value = dict(zip(at, found["quantiles"], strict=True)) if found and found["quantiles"] else {}
    edges = {n: sorted({value[i / n] for i in range(n + 1) if value.get(i / n) is not None}) for n in levels}
    stratum = {n: bin_index(F.col(target), F.array(*map(F.lit, e)).cast("array<double>")) for n, e in edges.items()}
    if stratum:
        tried = df.select(F.explode(F.array(*(F.struct(F.lit(n).alias("n"), s.alias("s")) for n, s in stratum.items()))).alias("t")).groupBy("t.n", "t.s").agg(F.count("*").alias("c"))
        held = {r["n"]: r for r in tried.groupBy("n").agg(F.count("*").alias("bins"), F.min("c").alias("least")).collect()}  # one row for each number of bins
        for n in levels:
            if n in held and held[n]["bins"] >= 2 and held[n]["least"] >= folds:
                return df.withColumn("stratum", stratum[n])
    return df.withColumn("stratum", F.lit(0))


def make_folds(df: DataFrame, key: str, folds: int = 5, task: str = "regression", group: str | None = None, label: str | None = None, target: str | None = None, stratify: bool = False, seed: int = 42) -> DataFrame:
    """The splitter by task, groups and stratification."""
    if stratify and task == "regression":
        df, label = regression_strata(df, target, folds), "stratum"
    strata = task == "classification" or stratify
    if group:
        return stratified_group_folds(df, group, label, folds) if strata else group_folds(df, group, folds)
    return stratified_folds(df, key, label, folds, seed) if strata else shuffled_folds(df, key, folds, seed)


def holdout(df: DataFrame, key: str, share: float = 0.2, group: str | None = None, label: str | None = None, seed: int = 42) -> DataFrame:
    """Adds `is_test`: whole groups by shuffled order, or the first rows of each class, or of the table. Rows without
    a group are one group, rows without a label one class."""
    if group:
        groups = ranked(df.select(group).distinct(), shuffle_key(F.col(group), seed), name="__rank")
        n = groups.count()
        return met(df, groups.select(group, (F.col("__rank") < F.ceil(F.lit(n * share))).alias("is_test")), [group])
    rows = ranked(df, shuffle_key(F.col(key), seed), [label] if label else [], "__rank", "__size")
    return rows.withColumn("is_test", F.col("__rank") < F.round(F.col("__size") * share)).drop("__rank", "__size")


def grouped_holdout(df: DataFrame, group: str, label: str, share: float = 0.2) -> DataFrame:
    """Adds `is_test`: of clip(round(1 / share), 3, 10) stratified group folds, the one with the share closest to `share`."""
    folds = stratified_group_folds(df, group, label, min(max(round(1 / share), 3), 10))
    counts = folds.groupBy("fold").agg(F.count("*").alias("n"))
    rows = counts.collect()  # one row a fold
    total = sum(r["n"] for r in rows)
    best = min(rows, key=lambda r: (abs(r["n"] / total - share), r["fold"]))["fold"]
    return folds.withColumn("is_test", F.col("fold") == best).drop("fold")


def lock_holdout(df: DataFrame, key: str, share: float = 0.2, group: str | None = None, label: str | None = None, seeds: list[int] | None = None, seed: int = 42) -> DataFrame:
    """Adds `is_test` by the first way that the given columns allow: the best of `seeds` (group and label), whole
    stratified groups (group and label), whole groups, within classes (label), plain."""
    if group and label and seeds:
        found = best_split(split_search(df, group, label, seeds, share))
        return holdout(df, key, share, group=group, seed=found)
    if group and label:
        return grouped_holdout(df, group, label, share)
    return holdout(df, key, share, group=group, label=label, seed=seed)


def side_counts(df: DataFrame, label: str) -> DataFrame:
    """(is_test, label, n): class counts of each side."""
    return df.groupBy("is_test", label).agg(F.count("*").alias("n"))


def seeded_tries(rows: DataFrame, seeds: list[int]) -> DataFrame:
    return rows.crossJoin(F.broadcast(rows.sparkSession.createDataFrame([(s,) for s in seeds], "seed int")))  # the caller's seeds


def divergence(shares: DataFrame) -> DataFrame:
    """(seed, kl) from class counts (seed, c, test, train)."""
    whole = Window.partitionBy("seed")  # one row a class
    p = F.col("train") / F.sum("train").over(whole) + 1e-9
    q = F.col("test") / F.sum("test").over(whole) + 1e-9
    return shares.withColumn("part", p * F.ln(p / q)).groupBy("seed").agg(F.sum("part").alias("kl"))


def split_search(df: DataFrame, group: str, label: str, seeds: list[int], share: float = 0.2) -> DataFrame:
    """(seed, kl, leaked): divergence of train from test class shares for each seed's group hold-out, and its groups
    on both sides. Works on group x class counts, not rows."""
    counts = df.groupBy(F.col(group).alias("g"), F.col(label).alias("c")).agg(F.count("*").alias("n"))
    groups = counts.select("g").distinct()
    key = F.md5(F.concat(F.col("seed").cast("string"), F.lit("|"), F.coalesce(F.col("g").cast("string"), F.lit(""))))
    first = math.ceil(groups.count() * share)
    sides = ranked(seeded_tries(groups, seeds), key, ["seed"]).select("seed", "g", (F.col("rank") < first).alias("is_test"))
    shares = met(sides, counts, ["g"]).groupBy("seed", "c").agg(F.sum(F.when(F.col("is_test"), F.col("n")).otherwise(0)).alias("test"), F.sum(F.when(~F.col("is_test"), F.col("n")).otherwise(0)).alias("train"))
    both = sides.groupBy("seed", "g").agg(F.count_distinct("is_test").alias("sides")).groupBy("seed").agg(F.count_if(F.col("sides") > 1).alias("leaked"))
    return divergence(shares).join(both, "seed")


def row_split_search(df: DataFrame, key: str, group: str, label: str, seeds: list[int], share: float = 0.2) -> DataFrame:
    """(seed, kl, leaked, score) of each seed's hold-out by rows within classes, which may tear groups apart: a group's
    sides are two bits, joined by OR; score is kl + 100 x the groups on both sides."""
    slim = df.select(F.col(key).alias("k"), F.col(group).alias("g"), F.col(label).alias("c"))
    order = F.md5(F.concat(F.col("seed").cast("string"), F.lit("|"), F.coalesce(F.col("k").cast("string"), F.lit(""))))
    rows = ranked(seeded_tries(slim, seeds), order, ["seed", "c"], size="n").select("seed", "g", "c", (F.col("rank") < F.round(F.col("n") * share)).alias("is_test"))
    shares = rows.groupBy("seed", "c").agg(F.count_if("is_test").alias("test"), F.count_if(~F.col("is_test")).alias("train"))
    sides = rows.groupBy("seed", "g").agg(F.bit_or(F.when(F.col("is_test"), 2).otherwise(1)).alias("sides")).groupBy("seed").agg(F.count_if(F.col("sides") == 3).alias("leaked"))
    return divergence(shares).join(sides, "seed").withColumn("score", F.col("kl") + 100.0 * F.col("leaked"))


def best_split(tries: DataFrame) -> int:
    """The seed with the least divergence among those that tear no group apart; if all do, with the least
    kl + 100 x leaked; the smaller seed on ties."""
    return tries.orderBy(F.col("leaked") > 0, F.col("kl") + 100.0 * F.col("leaked"), "seed").first()["seed"]


def group_leakage(df: DataFrame, group: str, side: str) -> DataFrame:
    """(leaked): groups on both sides."""
    return df.groupBy(group).agg(F.count_distinct(side).alias("sides")).agg(F.count_if(F.col("sides") > 1).alias("leaked"))
