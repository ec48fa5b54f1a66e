"""Mining rewrite rules from articles that mean the same.

The passes change what later passes see, so in a brand they are one sequence of steps, which `Brand` states. `mine_rules` gives the same rules without making a
brand one task: articles that could ever merge, in any pass, are linked by a similarity join of their names, and what isn't linked, however
indirectly, never changes each other's steps. Articles of equal attributes are linked as one class, names that are alike through a node each, so links grow with the
classes and not with pairs of articles. Components of bounded size go through the same steps in `Component`, which looks targets up by name. Larger ones go through each pass in rounds: every
article proposes to the best target that is left to it, and a target decides all proposals whose outcome no earlier article can change any more. Row order is fixed
by name, units, measure, degrees and id.
"""

from __future__ import annotations

import difflib
import functools
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import token_sorted
from .graph import components
from .similar import Names, _ddl, _in_tiles, _tiles
from .staged import Staging

RULE_SCHEMA = "brand string, article_id long, into_id long, reason string, score long, name string, degrees double, measure double, size string, package string"
COLUMNS = ("article_id", "brand", "name", "measure", "degrees", "units", "package", "size", "shops")

#: The similarities that the rounds of filling ask for, then those of the second series, then those of joining what few shops sell.
FILL_LEVELS, AGAIN_LEVELS, SELLER_LEVELS = (88, 70, 60, 50, 40), (95, 90, 85), (93, 80, 70, 60)
#: The order in which attributes are filled.
FILLED = ("package", "degrees", "measure", "size")


def words_sorted(name: str) -> str:
    return " ".join(sorted(re.sub("[^a-z0-9]+", " ", name.lower()).split()))


@functools.lru_cache(1 << 18)
def ratio(a: str, b: str) -> int:
    """0 to 100, twice the matching characters over both lengths."""
    return round(100 * difflib.SequenceMatcher(None, a, b, autojunk=False).ratio())


def _blank(x) -> bool:
    return x is None or x == 0 or x == "" or x != x


class Brand:
    """The articles of a brand while they are merged."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values(["name", "units", "measure", "degrees", "article_id"], kind="stable")
        self.rows = [dict(r, shops=set() if r["shops"] is None else set(r["shops"]), sorted=words_sorted(r["name"] or "")) for r in rows.to_dict("records")]
        self.live = [True] * len(self.rows)
        self.rules: list[tuple] = []
        self.scores: dict[tuple[str, str], int] = {}

    def score(self, a: dict, b: dict) -> int:
        key = (a["sorted"], b["sorted"])
        if key not in self.scores:
            self.scores[key] = ratio(*key)
        return self.scores[key]

    def alike(self, columns: tuple[str, ...]) -> list[list[int]]:
        """For each row the rows with the same values in the columns, which merges don't change."""
        groups: dict[tuple, list[int]] = {}
        keys = [tuple(None if r[c] != r[c] else r[c] for c in columns) for r in self.rows]
        for j, k in enumerate(keys):
            groups.setdefault(k, []).append(j)
        return [groups[k] for k in keys]

    def best(self, i: int, level: int, among: list[int], fits) -> tuple[int, int] | None:
        """The first row of the highest score above the level that fits and shares no shop with row i."""
        a, found = self.rows[i], None
        for j in among:
            b = self.rows[j]
            if j == i or not self.live[j] or not fits(b) or not a["shops"] or not b["shops"] or not a["shops"].isdisjoint(b["shops"]):
                continue
            s = self.score(a, b)
            if s > (found[1] if found else level):
                found = (j, s)
        return found

    def merge(self, i: int, j: int, reason: str, score: int) -> None:
        """Row i becomes row j, which takes over its shops; i has none from then on and so takes part in nothing."""
        a, b = self.rows[i], self.rows[j]
        self.rules.append((a["brand"], a["article_id"], b["article_id"], reason, score, b["name"], b["degrees"], b["measure"], b["size"], b["package"]))
        b["shops"] |= a["shops"]
        a["shops"] = set()
        self.live[i] = False

    def fill(self, column: str, level: int) -> None:
        """A blank attribute from the most similar article whose other attributes are equal."""
        others = self.alike(tuple(c for c in ("measure", "degrees", "units", "package", "size") if c != column))
        for i, a in enumerate(self.rows):
            if self.live[i] and _blank(a[column]):
                found = self.best(i, level, others[i], lambda b: not _blank(b[column]))
                if found:
                    self.merge(i, found[0], f"fill {column}", found[1])

    def few_sellers(self, most: int, level: int) -> None:
        """Articles that few shops sell join the most similar one of the same units and measure."""
        others = self.alike(("units", "measure"))
        for i, a in enumerate(self.rows):
            if self.live[i] and 0 < len(a["shops"]) <= most:
                found = self.best(i, level, others[i], lambda b: len(b["shops"]) > most)
                if found:
                    self.merge(i, found[0], "few sellers", found[1])

    def mined(self) -> pd.DataFrame:
        for level in FILL_LEVELS + AGAIN_LEVELS:
            for column in FILLED:
                self.fill(column, level)
        for level in SELLER_LEVELS:
            for most in (1, 2):
                self.few_sellers(most, level)
        return pd.DataFrame(self.rules, columns=[c.split()[0] for c in RULE_SCHEMA.split(", ")])


def mine(articles: DataFrame) -> DataFrame:
    """Rules (brand, article_id, into_id, reason, score, and the values taken over) from articles with their shops."""
    return articles.select(*COLUMNS).groupBy("brand").applyInPandas(lambda rows: Brand(rows).mined(), RULE_SCHEMA)


class Component:
    """The steps of `Brand` for many articles of few names: in a pass no article is both source and target, so the targets of a source's name are put in order once.

    Rows are those of `Brand` with their sorted names.
    """

    #: Targets that are tried one by one before those that hold a shop of the source are left out at once.
    TRIED = 32

    def __init__(self, rows: pd.DataFrame):
        self.rows = rows = rows.sort_values(["name", "units", "measure", "degrees", "article_id"], kind="stable").reset_index(drop=True)
        self.shops = [set(s.tolist()) for s in rows["shops"]]
        self.size = np.array([len(s) for s in self.shops])
        self.live = np.ones(len(rows), bool)
        self.name, self.names = pd.factorize(rows["sorted"])
        self.known = np.full((len(self.names), len(self.names)), -1, np.int8)
        self.blank = {c: np.array([_blank(x) for x in rows[c].tolist()], bool) for c in FILLED}
        self.group = {c: self.alike([o for o in ("measure", "degrees", "units", "package", "size") if o != c]) for c in FILLED} | {"few": self.alike(["units", "measure"])}
        self.rules: list[tuple] = []
        self.marked, self.stamp = np.zeros(len(rows), np.int64), 0

    def alike(self, columns: list[str]) -> np.ndarray:
        """A number for each row, the same for the same values in the columns."""
        numbers: dict[tuple, int] = {}
        keys = zip(*[[None if x != x else x for x in self.rows[c].tolist()] for c in columns])
        return np.array([numbers.setdefault(k, len(numbers)) for k in keys], np.int64)

    @functools.cached_property
    def holders(self) -> dict[int, np.ndarray]:
        """Which rows hold each shop at first."""
        row, shop = np.repeat(np.arange(len(self.rows)), self.rows["shops"].map(len)), np.concatenate(self.rows["shops"].to_list())
        order = np.argsort(shop, kind="stable")
        found, first = np.unique(shop[order], return_index=True)
        return dict(zip(found.tolist(), np.split(row[order], first[1:])))

    @functools.cached_property
    def gained(self) -> dict[int, list[int]]:
        """Which rows took over each shop."""
        out: dict[int, list[int]] = {}
        for j in {j for _, j, _, _ in self.rules if self.live[j]}:
            for s in self.shops[j].difference(self.rows["shops"][j].tolist()):
                out.setdefault(s, []).append(j)
        return out

    def scores(self, x: int, names: np.ndarray) -> np.ndarray:
        row = self.known[x]
        for y in np.unique(names[row[names] < 0]).tolist():
            row[y] = ratio(self.names[x], self.names[y])
        return row[names]

    def first(self, i: int, targets: np.ndarray, tried: list[int]) -> int | None:
        """The first of the targets that shares no shop with row i."""
        mine = self.shops[i]
        for k, j in enumerate(tried):
            if self.shops[j].isdisjoint(mine):
                return k
        if len(targets) == len(tried):
            return None
        self.stamp += 1
        for s in mine:
            self.marked[self.holders[s]] = self.stamp
            self.marked[self.gained.get(s, [])] = self.stamp
        free = self.marked[targets] != self.stamp
        k = int(free.argmax())
        return k if free[k] else None

    def merge(self, i: int, j: int, reason: str, score: int) -> None:
        if "gained" in self.__dict__:
            for s in self.shops[i]:
                self.gained.setdefault(s, []).append(j)
        self.rules.append((i, j, reason, score))
        self.shops[j] |= self.shops[i]
        self.size[j] = len(self.shops[j])
        self.shops[i], self.size[i], self.live[i] = set(), 0, False

    def step(self, kind: str, level: int, most: int, reason: str) -> None:
        """One pass. Groups of equal columns don't meet, so they go one by one."""
        here, group = self.live & (self.size > 0), self.group[kind]
        source = self.size <= most if kind == "few" else self.blank[kind]
        by_group = lambda rows: rows[np.argsort(group[rows], kind="stable")]
        s, t = by_group(np.flatnonzero(here & source)), by_group(np.flatnonzero(here & ~source))
        if not len(s) or not len(t):
            return
        runs = np.flatnonzero(np.r_[True, (group[s][1:] != group[s][:-1]) | (self.name[s][1:] != self.name[s][:-1])])
        for at, end in zip(runs.tolist(), [*runs[1:].tolist(), len(s)]):
            lo, hi = np.searchsorted(group[t], group[s[at]], "left"), np.searchsorted(group[t], group[s[at]], "right")
            score = self.scores(self.name[s[at]], self.name[t[lo:hi]])
            order = np.argsort(-score, kind="stable")[: int((score > level).sum())]
            targets, score = t[lo:hi][order], score[order]
            tried = targets[: self.TRIED].tolist()
            for i in s[at:end].tolist() if tried else ():
                k = self.first(i, targets, tried)
                if k is not None:
                    self.merge(i, int(targets[k]), reason, int(score[k]))

    def mined(self) -> pd.DataFrame:
        for p in _passes():
            self.step(*p)
        of = lambda side, c: self.rows[c].astype(object).iloc[[r[side] for r in self.rules]]
        given = [of(0, "brand"), of(0, "article_id"), of(1, "article_id"), [r[2] for r in self.rules], [r[3] for r in self.rules]]
        return pd.DataFrame(list(zip(*given, *[of(1, c) for c in ("name", "degrees", "measure", "size", "package")])), columns=[c.split()[0] for c in RULE_SCHEMA.split(", ")])


#: Articles of a component that one task takes through all passes, and different names of it.
COMPONENT, NAMES = 50_000, 2_000


def _likely(x: list[str], y: list[str], above: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose ratio may be above the level: letters that both have bound it."""
    a, b = Names(x), Names(y)
    shared = np.zeros((len(x), len(y)), np.int32)
    for c in range(a.counts.shape[1]):
        p, q = a.counts[:, c], b.counts[:, c]
        if p.any() and q.any():
            shared += np.minimum(p[:, None], q[None, :])
    length = a.length[:, None] + b.length[None, :]
    return np.nonzero((200.0 * shared + 0.5001 * length > above * length) | (length == 0))


def alike(left: DataFrame, right: DataFrame, by: list[str], above: int) -> DataFrame:
    """(by, x, y, score) of the distinct names (by, name) of left and right whose ratio is above the level."""

    def compare(x, y, ids):
        i, j = _likely(x, y, above)
        scores = [(p, q, ratio(x[p], y[q])) for p, q in zip(i.tolist(), j.tolist())]
        found = [(x[p], y[q], s) for p, q, s in scores if s > above]
        return [list(c) for c in zip(*found)] if found else [[], [], []]

    a, b = left.select(*by, "name").distinct(), right.select(*by, "name").distinct().withColumn("id", F.lit(None).cast("long"))
    fields = [("x", pa.string()), ("y", pa.string()), ("score", pa.int64())]
    return _tiles(a, b, by).mapInArrow(_in_tiles(compare, by, fields), _ddl(a, by) + "x string, y string, score long")


def joined(left: DataFrame, right: DataFrame, by: list[str], above: int) -> DataFrame:
    """(by, x, y) of so many of the pairs of `alike` that they connect all names that those connect: fewer than the names of each tile."""

    def compare(x, y, ids):
        root = list(range(len(x) + len(y)))

        def top(k):
            while root[k] != k:
                root[k] = k = root[root[k]]
            return k

        out = []
        for p, q in zip(*[k.tolist() for k in _likely(x, y, above)]):
            a, b = top(p), top(len(x) + q)
            if a != b and ratio(x[p], y[q]) > above:
                root[b] = a
                out.append((x[p], y[q]))
        return [list(c) for c in zip(*out)] if out else [[], []]

    a, b = left.select(*by, "name").distinct(), right.select(*by, "name").distinct().withColumn("id", F.lit(None).cast("long"))
    return _tiles(a, b, by).mapInArrow(_in_tiles(compare, by, [("x", pa.string()), ("y", pa.string())]), _ddl(a, by) + "x string, y string")


def _empty(column: str, kind: str):
    c = F.col(column)
    return c.isNull() | (c == "") if kind == "string" else c.isNull() | (c == 0) | (F.isnan(c) if kind in ("double", "float") else F.lit(False))


def _key(rows: DataFrame, columns: tuple[str, ...], *more):
    """Brand and columns as one text; null is a value, and not-a-number is null."""
    plain = lambda c: F.when(F.isnan(c), None).otherwise(F.col(c)) if dict(rows.dtypes)[c] in ("double", "float") else F.col(c)
    return F.to_json(F.struct(*more, *[plain(c).alias(c) for c in ("brand", *columns)]), {"ignoreNullFields": "false"})


#: Columns besides the sorted name that make articles one class.
CLASS = ("brand", "measure", "degrees", "units", "package", "size")


def _links(classes: DataFrame) -> DataFrame:
    """(a, b) that connect the classes (node, sorted, least shops) of which some articles could ever merge, shops aside.

    In each pass the sources of a name and the targets of a name have a node of their own, and those nodes are connected as the names are. Nodes are hashes; where two are equal, components are larger than they need be.
    """
    spark, types = classes.sparkSession, dict(classes.dtypes)
    each = lambda c: tuple(o for o in ("measure", "degrees", "units", "package", "size") if o != c)
    one = lambda kind, columns, source, target: F.struct(_key(classes, columns, F.lit(kind).alias("kind")).alias("key"), source.alias("source"), target.alias("target"), F.lit(kind == "few").alias("few"))
    kinds = [one(c, each(c), _empty(c, types[c]), ~_empty(c, types[c])) for c in FILLED] + [one("few", ("units", "measure"), F.col("least") <= 2, F.lit(True))]
    keyed = Staging(spark, "keyed").put(classes.select("node", F.col("sorted").alias("name"), F.explode(F.array(*kinds)).alias("k")).select("node", "name", "k.*"))
    pairs = [joined(keyed.where(f"source and {few}"), keyed.where(f"target and {few}"), ["key"], min(levels)) for few, levels in (("not few", FILL_LEVELS + AGAIN_LEVELS), ("few", SELLER_LEVELS))]
    found = Staging(spark, "joined").put(pairs[0].unionByName(pairs[1]).withColumns({"p": F.xxhash64(F.lit("s"), "key", "x"), "q": F.xxhash64(F.lit("t"), "key", "y")}))
    out = found.select(F.col("p").alias("a"), F.col("q").alias("b"))
    for side, at, name in (("source", "p", "x"), ("target", "q", "y")):
        met = found.select("key", F.col(name).alias("name"), F.col(at).alias("b")).distinct()
        out = out.unionByName(keyed.where(side).join(met, ["key", "name"]).select(F.col("node").alias("a"), "b"))
    return out


def _possible(rows: DataFrame, kind: str, source, target, columns: tuple[str, ...], above: int) -> DataFrame:
    """(kind, a, b, score): rows a for which `source` holds and b for which `target` does, equal in the columns, of disjoint shops, whose names are alike."""
    keyed = rows.select("pos", "shops", F.col("sorted").alias("name"), _key(rows, columns).alias("key"), source.alias("source"), target.alias("target"))
    a, b = keyed.where("source"), keyed.where("target")
    names = alike(a, b, ["key"], above)
    one, two = a.select("key", F.col("name").alias("x"), F.col("pos").alias("a"), F.col("shops").alias("p")), b.select("key", F.col("name").alias("y"), F.col("pos").alias("b"), F.col("shops").alias("q"))
    return one.join(names, ["key", "x"]).join(two, ["key", "y"]).where((F.col("a") != F.col("b")) & ~F.arrays_overlap("p", "q")).select(F.lit(kind).alias("kind"), "a", "b", "score")


def _edges(rows: DataFrame) -> DataFrame:
    """All merges that some pass could make. Shops only come to articles that stay, so what isn't possible at first never is."""
    types = dict(rows.dtypes)
    out = None
    for column in FILLED:
        others = tuple(c for c in ("measure", "degrees", "units", "package", "size") if c != column)
        blank = _empty(column, types[column])
        found = _possible(rows, column, blank, ~blank, others, min(FILL_LEVELS + AGAIN_LEVELS))
        out = found if out is None else out.unionByName(found)
    return out.unionByName(_possible(rows, "few", F.size("shops") <= 2, F.lit(True), ("units", "measure"), min(SELLER_LEVELS)))


def _decided(batches):
    """Of edges sorted by target and source (t, s, top, shops of both) whether each is taken, refused or still open.

    Sources decide in their order. One whose best target this is joins it if it shares no shop with those that are there and none with an earlier source that
    may still come; one that shares a shop with those that are there is refused for good.
    """
    target, there, maybe = None, set(), set()
    for batch in batches:
        out = []
        for t, top, mine, theirs in zip(*[batch.column(c).to_pylist() for c in ("t", "top", "mine", "theirs")]):
            if t != target:
                target, there, maybe = t, set(theirs), set()
            mine = set(mine)
            if not there.isdisjoint(mine):
                out.append("refused")
            elif top and maybe.isdisjoint(mine):
                there |= mine
                out.append("taken")
            else:
                maybe |= mine
                out.append("open")
        yield pa.RecordBatch.from_arrays([batch.column("s"), batch.column("t"), batch.column("score"), pa.array(out, pa.string())], ["s", "t", "score", "says"])


def _passes():
    """(kind, level, most, reason) of all passes in their order, but for those of filling at no lower a level than before. An article that found no target then finds none: targets only go or get more shops."""
    lowest = 101
    for level in FILL_LEVELS + AGAIN_LEVELS:
        for column in FILLED if level < lowest else ():
            yield column, level, 0, f"fill {column}"
        lowest = min(lowest, level)
    for level in SELLER_LEVELS:
        for most in (1, 2):
            yield "few", level, most, "few sellers"


def in_rounds(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, reason, score) of the merges among rows (pos, shops) over their possible edges, pass by pass, each in rounds of proposals."""
    spark = rows.sparkSession
    state, open_, merged = Staging(spark, "shops"), Staging(spark, "open"), Staging(spark, "merged")
    shops, edges = state.put(rows.select("pos", "shops")), Staging(spark, "edges").put(edges)
    done = merged.put(spark.createDataFrame([], "a long, b long, reason string, score long"))
    for kind, level, most, reason in _passes():
        here = edges.where((F.col("kind") == kind) & (F.col("score") > level)).select(F.col("a").alias("s"), F.col("b").alias("t"), "score")
        with_shops = lambda e, now: e.join(now.select(F.col("pos").alias("s"), F.col("shops").alias("mine")), "s").join(now.select(F.col("pos").alias("t"), F.col("shops").alias("theirs")), "t")
        able = with_shops(here, shops).where((F.size("mine") > 0) & (F.size("theirs") > 0) & ~F.arrays_overlap("mine", "theirs"))
        if kind == "few":
            able = able.where((F.size("mine") <= most) & (F.size("theirs") > most))
        left = open_.put(able.select("s", "t", "score"))
        while left.limit(1).count():
            best = left.groupBy("s").agg(F.max(F.struct("score", (-F.col("t")).alias("m"))).alias("best"))
            asked = with_shops(left.join(best, "s").withColumn("top", -F.col("best.m") == F.col("t")), shops)
            said = open_.put(asked.select("t", "s", "score", "top", "mine", "theirs").repartition("t").sortWithinPartitions("t", "s").mapInArrow(_decided, "s long, t long, score long, says string"))
            taken = said.where("says = 'taken'")
            moved = taken.join(shops.withColumnRenamed("pos", "s"), "s").groupBy("t").agg(F.array_distinct(F.flatten(F.collect_list("shops"))).alias("more"))  # a target's shops
            done = merged.put(done.unionByName(taken.select(F.col("s").alias("a"), F.col("t").alias("b"), F.lit(reason).alias("reason"), "score")))
            gone = taken.select(F.col("s").alias("pos"), F.lit(True).alias("gone"))
            grown = shops.join(moved.withColumnRenamed("t", "pos"), "pos", "left").join(gone, "pos", "left")
            shops = state.put(grown.select("pos", F.when(F.col("gone"), F.array().cast("array<long>")).when(F.col("more").isNotNull(), F.array_union("shops", "more")).otherwise(F.col("shops")).alias("shops")))
            left = open_.put(said.where("says = 'open'").join(taken.select("s"), "s", "left_anti").select("s", "t", "score"))
    return done


def mine_rules(articles: DataFrame, most: int = COMPONENT, names: int = NAMES) -> DataFrame:
    """The rules of `mine`, by components of articles that could ever merge; those of more than `most` articles or `names` different names in rounds.

    Articles without shops take part in nothing. A null name counts as empty.
    """
    spark = articles.sparkSession
    rows = articles.select(*COLUMNS).where(F.size(F.coalesce("shops", F.array().cast("array<long>"))) > 0)
    rows = rows.withColumn("shops", F.col("shops").cast("array<long>")).withColumn("sorted", token_sorted(F.coalesce("name", F.lit(""))))
    rows = Staging(spark, "rows").put(rows.withColumn("node", F.xxhash64("sorted", *CLASS)))
    classes = Staging(spark, "classes").put(rows.groupBy("node", "sorted", *CLASS).agg(F.min(F.size("shops")).alias("least"), F.count("*").alias("n")))
    of = classes.join(components(_links(classes)), "node")
    sizes = of.groupBy("root").agg(F.sum("n").alias("n"), F.count_distinct("sorted").alias("names"))
    placed = Staging(spark, "placed").put(of.select("node", "root").distinct().join(sizes, "root").select("node", "root", ((F.col("n") > most) | (F.col("names") > names)).alias("large")))
    linked = rows.join(placed, "node")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = linked.where("not large").select("root", "sorted", *COLUMNS).repartition(parts, "root")
    small = dealt.groupBy("root").applyInPandas(lambda r: Component(r).mined(), RULE_SCHEMA)
    if not placed.where("large").limit(1).count():
        return small
    order = [F.col(c).asc_nulls_last() for c in ("name", "units", "measure", "degrees", "article_id")]
    kept = linked.where("large").drop("node", "root", "large")
    large = Staging(spark, "large").put(kept.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id()))
    merges = in_rounds(large, _edges(large))
    a, b = large.select(F.col("pos").alias("a"), "brand", "article_id"), large.select(F.col("pos").alias("b"), F.col("article_id").alias("into_id"), "name", "degrees", "measure", "size", "package")
    columns = [c.split()[0] for c in RULE_SCHEMA.split(", ")]
    return small.unionByName(merges.join(a, "a").join(b, "b").select([F.col(c).cast(t.split()[1]) for c, t in zip(columns, RULE_SCHEMA.split(", "))]))
