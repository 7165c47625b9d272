"""Street graphs as chains: contraction of passing nodes, truncation at a border, half-streets, weighted clustering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import _held, triangles


def rank_chains(links: DataFrame) -> DataFrame:
    """(item, head, rank) of the chains that (item, before) describes; a head has `before` null and rank 0.

    Pointers double each round, so a chain of n items takes log2(n) rounds. Each round settles at least one item of every
    chain not yet done; items left when a round settles none lie on rings and are not returned.
    """
    now = _held(links.select("item", F.coalesce("before", "item").alias("at"), F.when(F.col("before").isNull(), 0).otherwise(1).cast("long").alias("rank"), F.col("before").isNull().alias("done")))
    left = None
    while (open_ := now.where("NOT done").count()) and open_ != left:
        left = open_
        far = now.select(F.col("item").alias("at"), F.col("at").alias("far"), F.col("rank").alias("more"), F.col("done").alias("ended"))
        now = _held(now.where("done").unionByName(now.where("NOT done").join(far, "at").select("item", F.col("far").alias("at"), (F.col("rank") + F.col("more")).alias("rank"), F.col("ended").alias("done"))))
    return now.where("done").select("item", F.col("at").alias("head"), "rank")


def endpoints(edges: DataFrame) -> DataFrame:
    """(node, is_end): true where streets begin, end or meet; false where exactly one way passes through.

    A node is passed through if it has no self-loop, both in- and out-edges, two neighbours, and two or four edges.
    """
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("other"), F.lit(1).alias("out")).union(edges.select("v", "u", F.lit(0)))
    per = ends.groupBy("node").agg(F.count_distinct("other").alias("k"), F.count(F.lit(1)).alias("d"), F.sum("out").alias("o"), F.bool_or(F.col("node") == F.col("other")).alias("own"))
    return per.select("node", (F.col("own") | (F.col("o") == 0) | (F.col("o") == F.col("d")) | (F.col("k") != 2) | ~F.col("d").isin(2, 4)).alias("is_end"))


def simplify(edges: DataFrame, key: str = "street_id") -> DataFrame:
    """Contract every chain of passed-through nodes into one edge: (key, u, v, length, n_parts, nodes, parts).

    The key is that of the chain's first edge; `nodes` and `parts` are in travel order. Of parallel edges beside a
    passed-through node the least key counts. Rings that no endpoint touches are dropped.
    """
    kind = _held(endpoints(edges))
    u, v = kind.select(F.col("node").alias("u"), F.col("is_end").alias("from_end")), kind.select(F.col("node").alias("v"), F.col("is_end").alias("to_end"))
    marked = _held(edges.select(key, "u", "v", "length").join(u, "u").join(v, "v"))
    whole = marked.where("from_end AND to_end").select(key, "u", "v", "length", F.lit(1).cast("long").alias("n_parts"), F.array("u", "v").alias("nodes"), F.array(key).alias("parts"))
    chain = marked.where("NOT (from_end AND to_end)").groupBy("u", "v").agg(F.min(F.struct(F.col(key).alias("item"), "length", "from_end")).alias("s")).select("u", "v", "s.*")
    chain = _held(chain)
    into = chain.select(F.col("item").alias("before"), F.col("u").alias("came"), F.col("v").alias("u"))
    links = chain.where("NOT from_end").join(into, "u").where("came <> v").select("item", "before").union(chain.where("from_end").select("item", F.lit(None).cast("long")))
    parts = rank_chains(links).join(chain, "item").groupBy("head").agg(F.array_sort(F.collect_list(F.struct("rank", "item", "u", "v"))).alias("p"), F.sum("length").alias("length"), F.count(F.lit(1)).alias("n_parts"))
    first, last = F.element_at("p", 1), F.element_at("p", -1)
    joined = parts.select(F.col("head").alias(key), first["u"].alias("u"), last["v"].alias("v"), "length", "n_parts", F.concat(F.array(first["u"]), F.transform("p", lambda q: q["v"])).alias("nodes"), F.transform("p", lambda q: q["item"]).alias("parts"))
    return whole.unionByName(joined)


def truncate(nodes: DataFrame, edges: DataFrame, key: str, inside: Column) -> DataFrame:
    """Nodes inside a border, and those outside that an edge joins to one inside."""
    marked = nodes.withColumn("_in", inside)
    kept = marked.where("_in").select(F.col(key).alias("_n"))
    both = edges.select(F.col("u").alias("_a"), F.col("v").alias("_n")).union(edges.select("v", "u"))
    near = both.join(kept, "_n", "left_semi").select(F.col("_a").alias("_n"))
    return nodes.join(kept.union(near).distinct(), nodes[key] == F.col("_n"), "left_semi")


def half_streets(lines: DataFrame, key: str = "street_id", line: str = "line") -> tuple[DataFrame, DataFrame]:
    """Streets cut at their middle: half-streets with ids <key>_0 and <key>_1, and middle nodes with ids <key>_m.

    An odd number of vertices is cut at the middle one, an even number half-way between the two middle ones.
    """
    n = F.size(line)
    half = F.floor(n / 2).cast("int")
    a, b = F.element_at(line, half), F.element_at(line, half + 1)
    odd = n % 2 == 1
    middle = F.when(odd, b).otherwise(F.struct(((a["x"] + b["x"]) / 2).alias("x"), ((a["y"] + b["y"]) / 2).alias("y")))
    at = lines.where(n > 1).withColumn("_m", middle)
    name = lambda suffix: F.concat_ws("_", F.col(key).cast("string"), F.lit(suffix))
    front = F.concat(F.slice(line, F.lit(1), half), F.array("_m"))
    back = F.concat(F.array("_m"), F.slice(line, F.when(odd, half + 2).otherwise(half + 1), n))
    halves = at.select(F.inline(F.array(F.struct(name("0").alias("half_id"), F.col("u").cast("string").alias("u"), name("m").alias("v"), front.alias("line")), F.struct(name("1").alias("half_id"), name("m").alias("u"), F.col("v").cast("string").alias("v"), back.alias("line")))))
    return halves, at.select(name("m").alias("node_id"), F.col("_m.x").alias("x"), F.col("_m.y").alias("y"))


def weighted_clustering(edges: DataFrame, nodes: DataFrame, key: str, weight: str = "length") -> DataFrame:
    """Directed clustering with the geometric mean of a triangle's weights, each over the largest; of parallel edges the least weight counts."""
    one = edges.where("u <> v").groupBy("u", "v").agg(F.min(weight).alias("w"))
    most = one.agg(F.max("w").alias("most"))
    scaled = one.crossJoin(F.broadcast(most)).select("u", "v", F.cbrt(F.col("w") / F.col("most")).alias("w"))
    both = _held(scaled.union(scaled.select("v", "u", "w")).groupBy("u", "v").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n")))
    degree = both.groupBy(F.col("u").alias("i")).agg(F.sum("n").alias("d"), F.sum((F.col("n") == 2).cast("long")).alias("b"))
    room = F.col("d") * (F.col("d") - 1) - 2 * F.col("b")
    value = F.when(room > 0, F.coalesce("t", F.lit(0.0)) / (2 * room)).otherwise(0.0)
    out = degree.join(triangles(both.select("u", "v", "w")), "i", "left").select(F.col("i").alias(key), value.alias("weighted_clustering"))
    return nodes.select(key).join(out, key, "left").na.fill(0.0, ["weighted_clustering"])
