"""Table-to-table operators: predicates built at run time, pages, upserts, facets, change history."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def all_of(conditions: Iterable[Column]) -> Column:
    """The conjunction of conditions; true without any."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Iterable[Column]) -> Column:
    """The disjunction of conditions; false without any."""
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def narrowed(df: DataFrame, **wanted) -> DataFrame:
    """Rows whose columns equal the given values, or are in them where a list is given; None and empty lists ask nothing."""
    asked = {k: v for k, v in wanted.items() if v is not None and v != []}
    return df.where(all_of(F.col(k).isin(v) if isinstance(v, list | tuple | set) else F.col(k) == v for k, v in asked.items()))


def without(df: DataFrame, **unwanted) -> DataFrame:
    """Rows that don't match all of the values together. A null matches nothing, so its row stays."""
    both = all_of(F.col(k).eqNullSafe(F.lit(v)) for k, v in unwanted.items())
    return df.where(~both)


def small(df: DataFrame, most: int = 400_000) -> DataFrame:
    """df, computed once into a table, with the hint to broadcast it if it has at most that many rows, else with that to shuffle both sides; for rows of a few numbers and short names."""
    from .staged import Staging

    table = Staging(df.sparkSession, "small").put(df)
    return F.broadcast(table) if table.count() <= most else table.hint("merge")


def balanced(df: DataFrame, label: str, key: str) -> DataFrame:
    """df with every class thinned to about the size of the smallest by a multiplicative hash of an integer key; null labels go.

    One pass for the counts, whose few rows are broadcast, and one filter: no class is gathered or sorted.
    """
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("_n"))
    share = counts.join(counts.agg(F.min("_n").alias("_least"))).select(F.col(label).alias("_label"), (F.col("_least") / F.col("_n")).alias("_share"))
    place = F.pmod(F.col(key) * F.lit(2654435761), F.lit(1 << 32)) / F.lit(float(1 << 32))
    return df.join(small(share), F.col(label) == F.col("_label")).where(place < F.col("_share")).drop("_label", "_share")


def page(df: DataFrame, number: int, size: int, *order: Column, past_end: str = "empty") -> DataFrame:
    """One page of the rows in the given order, counted from 1, with its row_number. past_end "last" gives the last page for a number beyond it.

    The rows of a page are found by a top-k of at most number * size rows, unless the last page is asked for.
    """
    if past_end == "last":
        last = max(1, -(-df.count() // size))
        number = min(number, last)
    top = df.orderBy(*order).limit(number * size)
    ranked = top.withColumn("row_number", F.row_number().over(Window.orderBy(*order)).cast("long"))
    return ranked.where(F.col("row_number") > (number - 1) * size)


def numbered_pages(df: DataFrame, size: int, *order: Column, within: Sequence[str] = ()) -> DataFrame:
    """All rows with the page that each is on, from 1. `within` numbers pages per group, which keeps the numbering distributed."""
    w = Window.partitionBy(*within).orderBy(*order)
    return df.withColumn("page", (F.floor((F.row_number().over(w) - 1) / size) + 1).cast("long"))


def global_pages(df: DataFrame, size: int, key: str) -> DataFrame:
    """As numbered_pages over the whole table in order of a unique numeric key, without gathering it in one task.

    The key's quantiles cut it into ranges once; rows are ranked within their range, after the counts of the ranges before.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(df.approxQuantile(key, [k / parts for k in range(1, parts)], 0.01)))
    span = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda c: c <= F.col(key)))
    rows = df.withColumn("_range", span)
    counts = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    ranked = rows.withColumn("_local", local).join(F.broadcast(before), "_range")  # one row a range
    return ranked.withColumn("page", (F.floor((F.col("_before") + F.col("_local") - 1) / size) + 1).cast("long")).drop("_range", "_local", "_before")


def numbered_within(df: DataFrame, group: str, key: str, *order: str) -> DataFrame:
    """df with `id`, the place of each row in its group in that order, from 1, though a group may hold most rows.

    key: a number that ascends with the order. Its quantiles cut all groups into the same ranges once; rows are ranked within
    their group and range, after the counts of the group's ranges before.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(df.approxQuantile(key, [k / parts for k in range(1, parts)], 0.01)))
    at = df.sparkSession.createDataFrame([(float(c),) for c in cuts], "_cut double").agg(F.array_sort(F.collect_list("_cut")).alias("_cuts"))  # one row
    rows = df.join(F.broadcast(at)).withColumn("_range", F.size(F.filter("_cuts", lambda c: c <= F.col(key)))).drop("_cuts")
    counts = rows.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = small(counts.select(F.col(group).alias("_group"), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before")))
    ranked = rows.withColumn("_local", F.row_number().over(Window.partitionBy(group, "_range").orderBy(*order)))
    joined = ranked.join(before, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_r")))
    return joined.withColumn("id", (F.col("_before") + F.col("_local")).cast("long")).drop("_range", "_local", "_group", "_r", "_before")


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], keep: Mapping[str, Column] | None = None) -> DataFrame:
    """old with the rows of new put in or over it by key. `keep` gives other merge rules, over columns old_x and new_x.

    Both tables have the same columns and no key twice. Keys match null-safe.
    """
    values = [c for c in old.columns if c not in key]
    a = old.select(*key, *[F.col(c).alias(f"old_{c}") for c in values], F.lit(True).alias("_old"))
    b = new.select(*[F.col(k).alias(f"_{k}") for k in key], *[F.col(c).alias(f"new_{c}") for c in values], F.lit(True).alias("_new"))
    joined = a.join(b, all_of(F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key), "full_outer")
    rules = dict(keep or {})
    chosen = [F.when(F.col("_new").isNull(), F.col(f"old_{c}")).when(F.col("_old").isNull(), F.col(f"new_{c}")).otherwise(rules.get(c, F.col(f"new_{c}"))).alias(c) for c in values]
    return joined.select(*[F.when(F.col("_old").isNull(), F.col(f"_{k}")).otherwise(F.col(k)).alias(k) for k in key], *chosen)


def update_columns(df: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """df with some columns replaced for the keys that new has."""
    b = new.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = df.join(b, F.col(key) == F.col("_key"), "left")
    return joined.select(*[F.when(F.col("_key").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def facets(df: DataFrame, specs: Mapping[str, tuple[str, Column]], counted: str) -> DataFrame:
    """(facet, value, n): for each facet the distinct `counted` by value, over the rows that its own condition keeps.

    One scan and one shuffle: a row becomes a row for each facet that it takes part in, and (facet, value, counted) is made distinct before it is counted.
    """
    each = F.array(*[F.when(condition, F.struct(F.lit(name).alias("facet"), F.col(column).cast("string").alias("value"))) for name, (column, condition) in specs.items()])
    rows = df.select(counted, F.explode(F.filter(each, lambda x: x.isNotNull())).alias("f"))
    distinct = rows.select("f.facet", "f.value", counted).distinct()
    return distinct.groupBy("facet", "value").agg(F.count("*").alias("n"))


def overlapping(a: Column, b: Column) -> Column:
    """Whether two lists share an element; an empty list counts as sharing."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), True).otherwise(F.arrays_overlap(a, b))


def changes_only(df: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """The rows at which the value differs from the one before of the same key, the first included."""
    w = Window.partitionBy(key).orderBy(*order)
    before = F.lag(value).over(w)
    return df.withColumn("_before", before).where(~F.col("_before").eqNullSafe(F.col(value))).drop("_before")


def carried_forward(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """df with the last non-null value up to each row of its group."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def crawled(edges: DataFrame, start: DataFrame, depth: int, prefix: str = "", avoid: Sequence[str] = (), most: int | None = None) -> DataFrame:
    """(node, level) in order of a crawl along (src, dst) from the start nodes: those of the prefix that hold none of the words to avoid, level by level.

    `most` bounds all pages, taken in order of their levels and names. Each level is a table, so neither the plan nor the lineage grows with the depth; a
    crawl ends where a level finds nothing new. Start nodes are filtered like others.
    """
    from .staged import Staging

    spark = edges.sparkSession
    wanted = all_of([F.col("node").startswith(prefix), *(~F.col("node").contains(w) for w in avoid)])
    seen, fronts = Staging(spark, "seen"), Staging(spark, "front")
    front = fronts.put(start.select("node").where(wanted).distinct())
    done = seen.put(front.withColumn("level", F.lit(0).cast("long")))
    for level in range(1, depth + 1):
        if most is not None and done.count() >= most:
            break
        found = edges.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).where(wanted).distinct()
        front = fronts.put(found.join(done.select("node"), "node", "left_anti"))
        if not front.limit(1).count():
            break
        done = seen.put(done.unionByName(front.withColumn("level", F.lit(level).cast("long"))))
    return done if most is None else done.orderBy("level", "node").limit(most)


def reachable(edges: DataFrame, start: DataFrame, depth: int, most: int | None = None) -> DataFrame:
    """(node, level) reached from the start nodes along (src, dst) in at most `depth` steps, each at its least level.

    The frontier is joined with the edges once a level and what was visited is taken out, so the plan has `depth` joins.
    `most` limits the pages of each level, in order of their names.
    """
    seen = start.select(F.col("node"), F.lit(0).cast("long").alias("level")).distinct()
    front = seen
    for level in range(1, depth + 1):
        new = edges.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        new = new.join(seen.select("node"), "node", "left_anti").withColumn("level", F.lit(level).cast("long"))
        if most is not None:
            new = new.orderBy("node").limit(most)
        seen, front = seen.unionByName(new), new
    return seen
