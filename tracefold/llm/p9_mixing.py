"""Problem 9: sources mixed to target weights.

Pfair scheduling of blocks of tokens: block i of a source with weight w is released at slot
floor((i-1)/w) and due at ceil(i/w); of the released blocks the one due earliest takes the next
slot (ties: the source that comes first). So every prefix of the mixture deviates from the
targets by less than one block a source. The schedule repeats after a period, the common
denominator of the weights if that is at most PERIOD; otherwise weights are rounded to
PERIOD-ths, and sources too small for that share the blocks of a bundle, which are dealt among
them by the same rule. One period a bundle is made on the driver, everything else is joins.

Documents of a source follow each other in a pseudo-random but fixed order; exact running
token counts come from sums of hash ranges, never from one task over a source.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from fractions import Fraction
from math import lcm

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracefold.llm import p8_tokens
from tracefold.runtime import materialize

#: Tokens of a block, and the longest period of a schedule.
BLOCK, PERIOD = 8192, 100_000
#: Blocks a period that a source has at least where weights are rounded: the error is a part in FINE of its weight at most.
FINE = 100
#: Documents of a hash range, on average: what one window task sorts.
RANGE_DOCS = 50_000


def weights(shares: dict[str, float]) -> dict[str, Fraction]:
    """Positive shares over their sum, exactly as written."""
    exact = {s: Fraction(str(x)) for s, x in shares.items() if x and x > 0}
    total = sum(exact.values())
    return {s: x / total for s, x in exact.items()}


def schedule(quota: dict[str, int], period: int) -> list[tuple[str, int, int]]:
    """(source, block of the period, slot): earliest deadline first over one period of a feasible Pfair system. Slots stay empty if the quotas leave some."""
    blocks = sorted(((-(-i * period // q), (i - 1) * period // q, s, i - 1) for s, q in quota.items() for i in range(1, q + 1)), key=lambda b: b[1])
    ready: list[tuple[int, str, int]] = []
    out, k = [], 0
    for slot in range(period):
        while k < len(blocks) and blocks[k][1] <= slot:
            heapq.heappush(ready, (blocks[k][0], blocks[k][2], blocks[k][3]))
            k += 1
        if ready:
            _, source, i = heapq.heappop(ready)
            out.append((source, i, slot))
    return out


def slots(parts: dict[str, Fraction], period: int = PERIOD, fine: int = FINE, name: str = "") -> list[tuple[str, str | None, int, int, list[int]]]:
    """(key, bundle, blocks a period, period, their slots) of every source and bundle; bundle is null at the top, where slots are those of the mixture.

    ``parts``: what each source takes of all slots, 1 together at most. For any number of sources: those with
    less than ``fine`` blocks a period are put together in bundles, whose blocks are dealt out in the same way.
    """
    parts = {s: Fraction(w) for s, w in parts.items() if w > 0}
    if not parts:
        return []
    whole = lcm(*(w.denominator for w in parts.values()))
    inner: list = []
    if whole <= period:
        quota = {s: int(w * whole) for s, w in parts.items()}
    else:
        least = Fraction(fine, period)
        groups: dict[str, dict[str, Fraction]] = {s: {s: w} for s, w in parts.items() if w >= least}
        small: dict[str, Fraction] = {}
        for s, w in sorted(((s, w) for s, w in parts.items() if w < least), key=lambda x: (-x[1], x[0])):
            small[s] = w
            if sum(small.values()) >= least:
                groups[f"{name}\0{len(groups)}"], small = small, {}
        if small:
            groups[f"{name}\0{len(groups)}"] = small
        goal = {g: sum(m.values()) * period for g, m in groups.items()}
        quota = {g: int(x) if g in parts else -(-x.numerator // x.denominator) for g, x in goal.items()}
        spare = period - sum(quota.values())
        for g in sorted((g for g in quota if g in parts), key=lambda g: (quota[g] - goal[g], g))[: max(0, spare)]:
            quota[g] += 1
        whole = max(period, sum(quota.values()))
        for g, m in groups.items():
            if g not in parts:
                inner += slots({s: w * period / quota[g] for s, w in m.items()}, period, fine, g)
    at: dict[str, list[int]] = {g: [] for g in quota}
    for g, _, slot in schedule(quota, whole):
        at[g].append(slot)
    return [(g, name or None, quota[g], whole, at[g]) for g in quota] + inner


def sizes(docs: DataFrame, targets: DataFrame, vocab: str = p8_tokens.VOCAB) -> DataFrame:
    """doc_id, source, n_tokens of the documents of the target sources; null and empty texts have 0 tokens."""
    mine = docs.where("doc_id is not null").join(F.broadcast(targets.where("source is not null").select("source").distinct()), "source", "left_semi")
    return p8_tokens.lengths(mine, ["doc_id", "source"], vocab=vocab)


def running(sized: DataFrame, docs_in_range: int = RANGE_DOCS) -> DataFrame:
    """``sized`` with ``before``, the tokens of the source's documents ahead of each one in the order of their hashes.

    The hash is cut into as many ranges as the number of documents asks for; range totals are added up first
    (a window over few rows a source), then the documents within each range.
    """
    n = max(1, -(-sized.count() // docs_in_range))
    h = sized.withColumn("h", F.xxhash64("doc_id", F.lit(9))).withColumn("cell", F.floor((F.col("h").cast("double") + 2.0**63) / (2.0**64 / n)))
    totals = h.groupBy("source", "cell").agg(F.sum("n_tokens").alias("t"))
    ahead = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.withColumn("base", F.coalesce(F.sum("t").over(ahead), F.lit(0))).select("source", "cell", "base")
    inner = Window.partitionBy("source", "cell").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    within = h.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)))
    return within.join(base, ["source", "cell"]).withColumn("before", F.col("base") + F.col("inner")).select("doc_id", "source", "n_tokens", "before")


def _plan(sized: DataFrame, targets: Sequence, total: int | None) -> list[tuple[str, float, int, int, int]]:
    """source, target share, repeats, tokens it has, tokens it is to give. Reads one row a source."""
    have = {r["source"]: r["t"] for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    usable = {r["source"]: r for r in targets if r["target_share"] and r["target_share"] > 0}
    sum_ = sum(r["target_share"] for s, r in usable.items() if have.get(s) and (r["max_repeats"] or 0) > 0)
    limit = min((have[s] * r["max_repeats"] / (r["target_share"] / sum_) for s, r in usable.items() if have.get(s) and (r["max_repeats"] or 0) > 0), default=0)
    size = limit if total is None else min(total, limit)
    return [(r["source"], float(r["target_share"] or 0), int(r["max_repeats"] or 0), have.get(r["source"], 0), int(size * r["target_share"] / sum_) if sum_ and have.get(r["source"]) and r["source"] in usable and (r["max_repeats"] or 0) > 0 else 0) for r in targets]


def mix(docs: DataFrame, targets: DataFrame, total: int | None = None, block: int = BLOCK, period: int = PERIOD) -> DataFrame:
    """doc_id, source, copy (from 1), n_tokens, slot, at: the mixture; its order is slot, at, copy, doc_id.

    The size is the largest at which every source reaches its share without using a document more than
    max_repeats times, or ``total`` if that is less; a document is taken whole, so a source exceeds its goal by
    less than one document. Sources without tokens give nothing and the others keep their proportions. Documents
    without tokens, of null source or of no target are left out. Each source has one target row; of several the
    largest share counts.
    """
    spark = docs.sparkSession
    rows = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).orderBy("source").collect()
    sized = materialize(sizes(docs, targets).where("n_tokens > 0"))
    plan = _plan(sized, rows, total)
    goals = spark.createDataFrame([(s, h, g) for s, _, _, h, g in plan if g > 0], "source string, have bigint, goal bigint")
    d = running(sized).join(F.broadcast(goals), "source")
    # whole passes over a source, and one more for the documents that begin before the rest of the goal
    full = F.floor(F.col("goal") / F.col("have"))
    rest = F.col("goal") - full * F.col("have")
    d = d.withColumn("copies", (full + (F.col("before") < rest).cast("int")).cast("int")).where("copies > 0")
    d = d.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).withColumn("at", (F.col("copy") - 1) * F.col("have") + F.col("before"))
    made = slots(weights({s: w for s, w, _, _, g in plan if g > 0}), period)
    place = spark.createDataFrame([(g, i, x) for g, _, _, _, xs in made for i, x in enumerate(xs)], "key string, i int, x int")  # PERIOD rows a bundle at most
    turn = spark.createDataFrame([(g, up, q, whole) for g, up, q, whole, _ in made], "key string, up string, q int, whole int")
    d = d.withColumns({"key": F.col("source"), "b": F.floor(F.col("at") / block)})
    depth = max((g.count("\0") for g, *_ in made), default=0) + 1
    for _ in range(depth):  # from the bundle of a source up to the mixture
        d = d.join(F.broadcast(turn), "key", "left").withColumn("i", (F.col("b") % F.col("q")).cast("int")).join(F.broadcast(place), ["key", "i"], "left")
        d = d.withColumns({"b": F.when(F.col("x").isNull(), F.col("b")).otherwise(F.floor(F.col("b") / F.col("q")) * F.col("whole") + F.col("x")), "key": F.col("up")}).drop("up", "q", "whole", "i", "x")
    return d.select("doc_id", "source", "copy", "n_tokens", F.col("b").alias("slot"), "at")


def shares(docs: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """source, target_share, actual_share, tokens, documents, max_used of every target source."""
    m = mix(docs, targets, total)
    per = m.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count_if(F.col("copy") == 1).alias("documents"), F.max("copy").alias("max_used"))
    t = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"))
    out = t.join(per, "source", "left").fillna(0, ["tokens", "documents", "max_used"])
    whole = F.sum("tokens").over(Window.partitionBy())
    return out.select("source", "target_share", F.when(whole > 0, F.col("tokens") / whole).otherwise(0.0).alias("actual_share"), "tokens", "documents", "max_used")
