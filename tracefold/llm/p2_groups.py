"""Problem 2: pairwise links consolidated into groups.

Leaves are stripped layer by layer, chains of degree-two vertices are contracted by
list ranking (pointer jumping over darts), the reduced core is solved by alternating
large-star and small-star steps, and the removed vertices get their labels back in the
reverse order. Every step is a DataFrame plan; nothing of the graph reaches the driver
but counts. Tables of each step are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.runtime import materialize, release, salted_join

#: Stripping goes on while a round removes at least this share of the arcs; then chains are contracted,
#: and if both together remove less, what is left is the core. All of it is solved either way.
STRIP_SHARE = 0.1


def _arcs(edges: DataFrame) -> DataFrame:
    e = edges.where(F.col("u") != F.col("v"))
    return e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def _strip(arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves with their only neighbour, and the arcs without them. Of two leaves joined to each other the smaller stays."""
    leaves = arcs.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("v")).where("n = 1").select("u", "v")
    pair = [F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")]
    gone = leaves.select(*pair).groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    removed = materialize(leaves.select("u", "v", *pair).join(gone, ["lo", "hi"]).where("n = 1 or u = hi").select(F.col("u").alias("x"), F.col("v").alias("parent")))
    cut = removed.select(F.col("x").alias("u"), F.col("parent").alias("v")).unionByName(removed.select(F.col("parent").alias("u"), F.col("x").alias("v")))
    return removed, materialize(arcs.join(cut, ["u", "v"], "left_anti"))


def _contract(arcs: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Chains of degree-two vertices replaced by one edge between their ends; None if there is no chain.

    A dart (a, b) walks from a to b. Behind a degree-two vertex b it goes on to b's other
    neighbour; doubling these steps finds the end of every chain in log2(length) rounds.
    Rings have no end and stay for the core.
    """
    two = arcs.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("p"), F.max("v").alias("q")).where("n = 2").select(F.col("u").alias("b"), "p", "q")
    two = materialize(two)
    n = two.count()
    if not n:
        release(two)
        return None
    dart = two.select(F.col("p").alias("a"), "b", F.col("b").alias("s"), F.col("q").alias("t")).unionByName(two.select(F.col("q").alias("a"), "b", F.col("b").alias("s"), F.col("p").alias("t")))
    dart = (dart.join(two.select(F.col("b").alias("t"), F.lit(True).alias("on")), "t", "left").select("a", "b", "s", "t", F.coalesce("on", F.lit(False)).alias("on")))
    moving = None
    while True:
        dart = materialize(dart)
        walking = dart.where("on").count()
        if not walking or walking == moving:  # each round ends the darts of every chain that is not through; rings alone stand still
            break
        moving = walking
        ahead = dart.select(F.col("a").alias("s"), F.col("b").alias("t"), F.col("s").alias("s2"), F.col("t").alias("t2"), F.col("on").alias("on2"))
        further = dart.where("on").join(ahead, ["s", "t"]).select("a", "b", F.col("s2").alias("s"), F.col("t2").alias("t"), F.col("on2").alias("on"))
        dart = dart.where("not on").unionByName(further)
    ends = dart.where("not on").groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("p"), F.max("t").alias("q")).where("n = 2")
    ends = materialize(ends.select("b", "p", "q"))
    removed = ends.select(F.col("b").alias("x"), F.col("p").alias("parent"))
    gone = ends.select(F.col("b").alias("u"))
    left = arcs.join(gone, "u", "left_anti").join(gone.withColumnRenamed("u", "v"), "v", "left_anti").select("u", "v")
    new = materialize(left.unionByName(_arcs(ends.select(F.col("p").alias("u"), F.col("q").alias("v")))).distinct())
    release(dart, two)
    return removed, new


def _solve(arcs: DataFrame) -> DataFrame:
    """Labels x, root of the core: large-star and small-star until the edges no longer change. Groups are met by minima, never collected."""
    e = arcs.where("u > v").select("u", "v")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = salted_join(both.where("v > u"), low, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        new = materialize(small)
        release(large, e)
        e = new
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("below"), F.lit(1).alias("above")))
        if ends.groupBy("x").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below > 1 or below > 0 and above > 0").isEmpty():
            return e.select(F.col("u").alias("x"), F.col("v").alias("root"))  # stars only


def components(edges: DataFrame, strip_share: float = STRIP_SHARE) -> DataFrame:
    """x, root for every vertex of ``edges`` (u, v longs): equal roots for vertices linked directly or indirectly.

    Null ends are ignored; repeated edges count once; a loop alone makes a group of one.
    """
    edges = edges.where("u is not null and v is not null")
    every = edges.select(F.explode(F.array("u", "v")).alias("x")).distinct()
    arcs = materialize(_arcs(edges))
    n, layers = arcs.count(), []
    while n:
        removed, rest = _strip(arcs)
        release(arcs)
        arcs, m = rest, rest.count()
        if m < n:
            layers.append(removed)
        shrunk = n - m
        n = m
        if not n or shrunk >= strip_share * (n + shrunk):
            continue
        done = _contract(arcs)
        if done:
            release(arcs)
            layers.append(done[0])
            arcs, m = done[1], done[1].count()
            shrunk += n - m
            n = m
        if shrunk < strip_share * (n + shrunk):
            break
    labels = materialize(_solve(arcs)) if n else None
    for removed in reversed(layers):
        if labels is None:
            labels = removed.select("x", F.col("parent").alias("root"))
        else:
            found = salted_join(removed, labels.select(F.col("x").alias("parent"), "root"), ["parent"], "left")
            labels = labels.unionByName(found.select("x", F.coalesce("root", "parent").alias("root")))
        labels = materialize(labels)
    if labels is None:
        return every.select("x", F.col("x").alias("root"))
    return every.join(labels, "x", "left").select("x", F.coalesce("root", "x").alias("root"))


def record_groups(links: DataFrame, extractions: DataFrame) -> DataFrame:
    """document_id, record_key, group_id of every record with a link: the smallest person_id of all that hangs together.

    A null record_key counts as ''. Links with a null end or to an absent extraction, and
    extractions without document, are ignored.
    """
    l = links.select("extraction_id", "person_id").where("extraction_id is not null and person_id is not null")
    e = extractions.select(F.col("id").alias("extraction_id"), "document_id", F.coalesce("record_key", F.lit("")).alias("record_key")).where("document_id is not null")
    pairs = materialize(l.join(e, "extraction_id").groupBy("document_id", "record_key", "person_id").agg(F.min("extraction_id").alias("first")))
    records = materialize(pairs.groupBy("document_id", "record_key").agg(F.min("first").alias("rid")))
    # a record is the vertex 2 * its smallest extraction id + 1, a person the vertex 2 * id
    edges = salted_join(pairs, records, ["document_id", "record_key"]).select((F.col("person_id") * 2).alias("u"), (F.col("rid") * 2 + 1).alias("v"))
    labels = materialize(components(materialize(edges)))
    smallest = labels.where("x % 2 = 0").groupBy("root").agg(F.min(F.expr("x div 2")).alias("group_id"))
    of = salted_join(labels.where("x % 2 <> 0"), smallest, ["root"]).select(F.expr("(x - 1) div 2").alias("rid"), "group_id")
    return records.join(of, "rid").select("document_id", "record_key", "group_id")
