"""Similarity pairs and greedy leader clustering of token sets.

A sequential loop in which each item joins the first earlier leader that is similar enough, or
becomes a leader, is the lexicographically first maximal independent set of the similarity
graph.  ``cluster`` finds it in two phases.  Where many items are alike there are few leaders:
the loop is run over the first items of the order, a block of bounded size, and all
later items look for the first of these leaders, with no pairs formed.  Once a block's
leaders are followed by few, likeness is rare: the pairs that are left are few, too, and
``lead`` decides on them in rounds, in which items without an earlier undecided neighbour
lead and their later neighbours follow.  Where to stop changes the cost only.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions import text as T
from recollect.functions.arrow import task_mapper
from recollect.session import cut_lineage

#: Items whose loop is run in one piece, at most so many times, and while each of them gains so many followers.
BLOCK, BLOCKS, FOLLOWERS = 2_000, 20, 4
#: Items that share a token and are joined by one task.
HOT = 5_000


def similar_pairs(items: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity): pairs within a group with Jaccard at or above the threshold, a < b.

    ``items`` is (id, grp, tokens), ids unique, tokens distinct.  Two sets that similar share
    one of their rarest tokens: of n tokens the n - ceil(t n) + 1 rarest are the join keys
    (prefix filter), and sizes must fit.  Sets that are equal meet by their own key.
    """
    t = float(threshold)
    sized = items.where(F.size("tokens") > 0).select("id", "grp", "tokens", F.size("tokens").alias("n"))
    seen = sized.select("grp", F.explode("tokens").alias("token")).groupBy("grp", "token").agg(F.count("*").alias("f"))
    ranked = sized.select("id", "grp", "n", F.explode("tokens").alias("token")).join(seen, ["grp", "token"])
    place = F.row_number().over(Window.partitionBy("id").orderBy("f", "token"))  # as long as a text
    prefix = ranked.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * t - 1e-9) + 1)
    # a common token's items are split by hash on one side and repeated for each part on the other
    prefix = prefix.select("id", "grp", "n", "token", F.ceil(F.col("f") / HOT).cast("int").alias("parts"))
    left = prefix.select("grp", "token", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.col("id").alias("a"), F.col("n").alias("na"))
    right = prefix.select("grp", "token", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("id").alias("b"), F.col("n").alias("nb"))
    met = left.join(right, ["grp", "token", "part"]).where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * t - 1e-9)).select("a", "b").distinct()
    ta, tb = sized.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), sized.select(F.col("id").alias("b"), F.col("tokens").alias("tb"))
    both = met.join(ta, "a").join(tb, "b").withColumn("similarity", T.jaccard(F.col("ta"), F.col("tb")))
    return both.where(F.col("similarity") >= t - 1e-12).select("a", "b", "similarity")


def lead(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, leader): each node's leader; leaders lead themselves.

    ``nodes`` is (id, ord), ord unique; ``edges`` (a, b) in any direction.  A node follows
    the first leader among its neighbours.
    """
    nodes = cut_lineage(nodes.select("id", "ord"))
    na, nb = nodes.select(F.col("id").alias("a"), F.col("ord").alias("oa")), nodes.select(F.col("id").alias("b"), F.col("ord").alias("ob"))
    both = edges.select("a", "b").join(na, "a").join(nb, "b")
    forward = cut_lineage(
        both.select(
            F.when(F.col("oa") < F.col("ob"), F.col("a")).otherwise(F.col("b")).alias("a"), F.least("oa", "ob").alias("oa"),
            F.when(F.col("oa") < F.col("ob"), F.col("b")).otherwise(F.col("a")).alias("b"),
        ).where("a <> b").distinct()
    )
    # nodes without an edge are decided at once
    undecided = cut_lineage(forward.select(F.col("a").alias("id")).union(forward.select("b")).distinct())
    followers = None
    while undecided.limit(1).count():
        ua, ub = undecided.withColumnRenamed("id", "a"), undecided.withColumnRenamed("id", "b")
        live = forward.join(ua, "a", "left_semi").join(ub, "b", "left_semi")
        blocked = live.select(F.col("b").alias("id")).distinct()
        leaders = undecided.join(blocked, "id", "left_anti")
        follow = live.join(leaders.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        follow = cut_lineage(follow)
        undecided = cut_lineage(undecided.join(leaders, "id", "left_anti").join(follow, "id", "left_anti"))
        followers = follow if followers is None else followers.union(follow)
    if followers is None:
        return nodes.select("id", F.col("id").alias("leader"))
    followers = followers.distinct()
    first = (
        forward.join(followers.withColumnRenamed("id", "a"), "a", "left_anti").join(followers.withColumnRenamed("id", "b"), "b", "left_semi")
        .groupBy("b").agg(F.min(F.struct("oa", "a"))["a"].alias("leader"))
    )
    return nodes.join(first.withColumnRenamed("b", "id"), "id", "left").select("id", F.coalesce("leader", "id").alias("leader"))


class _Leaders:
    """Leaders in their order, met by their tokens within a group."""

    def __init__(self, threshold: float):
        self.t = threshold
        self.ids: list = []
        self.sizes: list[int] = []
        self.holding: dict[tuple, list[int]] = defaultdict(list)

    def add(self, item, grp, tokens) -> None:
        for token in tokens:
            self.holding[grp, token].append(len(self.ids))
        self.ids.append(item)
        self.sizes.append(len(tokens))

    def first(self, grp, tokens):
        """The place of the first leader similar enough, or None."""
        shared: dict[int, int] = defaultdict(int)
        for token in tokens:
            for place in self.holding.get((grp, token), ()):
                shared[place] += 1
        n = len(tokens)
        return min((p for p, k in shared.items() if k / (n + self.sizes[p] - k) >= self.t - 1e-12), default=None)


def _loop(block: list, threshold: float) -> tuple[_Leaders, list[tuple]]:
    """The leaders of a block of (id, grp, tokens) in order, and (id, leader) of all its items."""
    leaders, own = _Leaders(threshold), []
    for item, grp, tokens in block:
        place = leaders.first(grp, tokens)
        if place is None:
            leaders.add(item, grp, tokens)
        own.append((item, item if place is None else leaders.ids[place]))
    return leaders, own


def _follow(items: DataFrame, leaders: _Leaders) -> DataFrame:
    """(id, grp, tokens, ord, leader): each item's first leader; null if none is similar enough."""
    shared = items.sparkSession.sparkContext.broadcast(leaders)
    types = {f.name: f.dataType.simpleString() for f in items.schema}

    def make() -> Callable:
        found = shared.value

        def f(ids: list, grps: list, sets: list, ords: list):
            places = [found.first(g, ts) for g, ts in zip(grps, sets)]
            return ids, grps, sets, ords, [None if p is None else found.ids[p] for p in places]

        return f

    schema = ", ".join(f"{c} {types[c]}" for c in ("id", "grp", "tokens", "ord")) + f", leader {types['id']}"
    return task_mapper(items, [F.col(c) for c in ("id", "grp", "tokens", "ord")], schema, make)


def _decide(firsts: DataFrame, threshold: float, block: int) -> DataFrame:
    """(id, leader) of (id, grp, tokens, ord), no two with equal tokens in a group."""
    spark, rest, decided = firsts.sparkSession, firsts, []
    pair = "id {0}, leader {0}".format(firsts.schema["id"].dataType.simpleString())
    for _ in range(BLOCKS):
        rows = rest.orderBy("ord").select("id", "grp", "tokens").limit(block).collect()
        leaders, own = _loop(rows, threshold)
        mine = spark.createDataFrame(own, pair)
        decided.append(mine)
        if len(rows) < block:
            rest = None
            break
        looked = cut_lineage(_follow(rest.join(F.broadcast(mine.select("id")), "id", "left_anti"), leaders))
        followed = looked.where("leader is not null").select("id", "leader")
        decided.append(followed)
        rest = looked.where("leader is null").drop("leader")
        if followed.count() < FOLLOWERS * block:
            break
    if rest is not None:
        decided.append(lead(rest.select("id", "ord"), similar_pairs(rest.select("id", "grp", "tokens"), threshold)))
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    return out


def cluster(items: DataFrame, threshold: float, order: list[Column], block: int = BLOCK) -> DataFrame:
    """(id, leader): greedy leader clusters of (id, grp, tokens, ...) in the given order.

    Items of one group with equal tokens are decided as one: the first of them stands for
    all, since any leader of one is a leader of the others.
    """
    ordered = items.withColumn("ord", F.struct(*order, F.col("id")))
    key = F.sha2(F.concat_ws("\x1f", F.coalesce(F.col("grp").cast("string"), F.lit("")), F.array_join(F.array_sort("tokens"), " ")), 256)
    keyed = ordered.withColumn("key", F.when(F.size("tokens") > 0, key).otherwise(F.concat(F.lit("-"), F.col("id").cast("string"))))
    keyed = cut_lineage(keyed)
    firsts = keyed.groupBy("key").agg(F.min(F.struct("ord", "id", "grp", "tokens")).alias("x")).select("key", "x.ord", "x.id", "x.grp", "x.tokens")
    firsts = cut_lineage(firsts)
    led = _decide(firsts.select("id", F.coalesce(F.col("grp").cast("string"), F.lit("")).alias("grp"), "tokens", "ord"), float(threshold), block)
    return keyed.select("key", F.col("id").alias("member")).join(firsts.select("key", "id"), "key").join(led, "id").select(F.col("member").alias("id"), "leader")
