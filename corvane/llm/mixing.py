"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). Token capacity flows from patterns to
source quotas; a pattern's first epoch costs 0 a token, each repeat costs one more, so the flow repeats nothing while
fresh tokens can still serve a quota. Then documents are taken in a seeded order: whole epochs for all of a pattern, and
for the rest of its flow a prefix of that order, closed by up to three documents that bring it nearest to the flow. Where whole
documents still leave more than 1/500 of the flow open (a giant document in a small source), `mix` counts the words of one
more in part if `cut` is set, so the figures meet the targets; documents that are emitted are always whole.

Only the pattern table comes to the driver, and it is broadcast to meet the rows (its row count is checked against
`max_patterns`). The cut of a pattern is found by a histogram of the seeded hash, so no pattern, however hot, is dealt to or
sorted in one task. Places in the order, not lists of rows, say what a prefix holds; the closing documents are chosen among a few
rows of each size, which one pass keeps, so the number of passes over the rows doesn't depend on how many documents close a gap.

Defined cases: null texts have size 0 and are never taken; a null source is a source of its own, last in order; equal
doc_ids share a place in the order and are told apart by row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, discard, stored

_BUCKETS_BITS = 16
_PLACE = "struct<h: long, doc_id: long, row_id: long>"


def source_targets(sizes: dict, weights: dict, max_repeat: int = 3) -> dict:
    """Targets that share the sum of all sizes by weight, none above max_repeat times its source's size."""
    left, active, out = float(sum(sizes.values())), dict(weights), {}
    while active:
        scale = left / sum(active.values())
        over = [s for s, w in active.items() if w * scale > max_repeat * sizes[s]]
        if not over:
            return out | {s: w * scale for s, w in active.items()}
        for s in over:
            out[s] = float(max_repeat * sizes[s])
            left -= out[s]
            del active[s]
    return out


def route(capacity: dict, quota: dict, max_repeat: int = 3) -> dict:
    """(pattern, source) -> tokens. Patterns are tuples of sources.

    Successive shortest paths: the only costs are those of the epochs, so opening one epoch after the other and saturating
    each by augmenting paths (shortest in edges) gives the cheapest flow.
    """
    flow, free, need = {}, dict.fromkeys(capacity, 0), dict(quota)
    serves = {}
    for p in capacity:
        for s in p:
            serves.setdefault(s, []).append(p)
    for _ in range(max_repeat):
        for p, c in capacity.items():
            free[p] += c
        while True:
            came = {("p", p): None for p in capacity if free[p] > 0}
            queue, end, found = deque(came), None, False  # None may be a source
            while queue and not found:
                kind, x = queue.popleft()
                if kind == "p":
                    for s in x:
                        if ("s", s) not in came:
                            came["s", s] = x
                            if need.get(s, 0) > 0:
                                end, found = s, True
                                break
                            queue.append(("s", s))
                else:
                    for p in serves[x]:
                        if flow.get((p, x), 0) > 0 and ("p", p) not in came:
                            came["p", p] = x
                            queue.append(("p", p))
            if not found:
                break
            path, s = [], end
            while True:
                p = came["s", s]
                path.append((p, s, 1))
                if (back := came["p", p]) is None:
                    break
                path.append((p, back, -1))
                s = back
            amount = min(free[p], need[end], *[flow[q, t] for q, t, sign in path if sign < 0])
            free[p] -= amount
            need[end] -= amount
            for q, t, sign in path:
                flow[q, t] = flow.get((q, t), 0) + sign * amount
    return flow


def size_in_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(f"[^{SPACE}]+")).cast("long")


def mix(docs: DataFrame, size: Column, sources: Column, weight_of=None, id_col: str = "doc_id", max_repeat: int = 3, seed: int = 11, max_patterns: int = 100_000, keep: tuple[str, ...] = (), cut: bool = True) -> tuple[DataFrame, dict]:
    """Rows (doc_id, sources, size, taken, epochs, *keep) and the table source -> (size, target).

    `sources` is an array column; `weight_of(k)` is the weight of the k-th source in code point order (default 1, 2, 3, 1, ...).
    """
    spark = docs.sparkSession
    weight_of = weight_of or (lambda k: k % 3 + 1)
    slim = stored(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), F.array_sort(F.array_distinct(sources.cast("array<string>"))).alias("sources"), size.alias("size"),
            F.xxhash64(F.lit(seed), F.col(id_col).cast("long")).alias("h"), F.monotonically_increasing_id().alias("row_id"), *keep,
        ).withColumn("bucket", F.shiftrightunsigned("h", 64 - _BUCKETS_BITS).cast("int")), "mix",
    )
    found = slim.groupBy("sources").agg(F.sum("size").alias("size")).limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    capacity = {tuple(r["sources"]): r["size"] for r in found}
    names = sorted({s for p in capacity for s in p}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(c for p, c in capacity.items() if s in p) for s in names}
    once = {s: sum(c / len(p) for p, c in capacity.items() if s in p) for s in names}
    targets = source_targets(once, {s: weight_of(k) for k, s in enumerate(names)}, max_repeat)
    flow = route(capacity, {s: round(t) for s, t in targets.items()}, max_repeat)
    taken = dict.fromkeys(capacity, 0)
    for (p, _), n in flow.items():
        taken[p] += n
    plan = [(list(p), taken[p] // c, taken[p] % c, taken[p]) for p, c in capacity.items() if c]
    plan = spark.createDataFrame(plan, "sources array<string>, epochs long, rest long, flow long")
    # A pattern's sources may hold nulls: joins use a key that tells them apart.
    key = lambda c: F.to_json(F.struct(F.transform(c, lambda s: F.coalesce(F.concat(F.lit("="), s), F.lit("null"))).alias("k")))
    plan = plan.select(key(F.col("sources")).alias("pattern"), "epochs", "rest", "flow")
    rows = slim.withColumn("pattern", key(F.col("sources")))
    up_to = Window.partitionBy("pattern").orderBy("bucket")
    cuts = (
        rows.groupBy("pattern", "bucket").agg(F.sum("size").alias("n")).withColumn("upto", F.sum("n").over(up_to)).join(F.broadcast(plan), "pattern")
        .where("upto > rest and upto - n <= rest").groupBy("pattern").agg(F.min("bucket").alias("cut"), F.min(F.struct("bucket", F.expr("upto - n")))["col2"].alias("before"))
    )
    plan = spark.createDataFrame(plan.join(cuts, "pattern", "left").select("pattern", "epochs", "rest", "flow", "cut", "before").collect(), "pattern string, epochs long, rest long, flow long, cut int, before long")
    # Whole buckets before the cut; of the cut's bucket what comes no later than `last`: places tell what is taken, no list of rows.
    place = F.struct("h", "doc_id", "row_id")
    order = Window.partitionBy("pattern").orderBy("h", "doc_id", "row_id")
    at_cut = rows.join(F.broadcast(plan.select("pattern", "rest", "cut", "before")), "pattern").where("bucket = cut")
    at_cut = at_cut.withColumn("_upto", F.col("before") + F.sum("size").over(order)).where("_upto <= rest")
    last = {r["pattern"]: r for r in at_cut.groupBy("pattern").agg(F.max(place).alias("last"), F.max("_upto").alias("upto")).collect()}
    plan = plan.collect()
    gaps = {r["pattern"]: r["rest"] - (last[r["pattern"]]["upto"] if r["pattern"] in last else r["before"]) for r in plan if r["cut"] is not None}
    flows = {r["pattern"]: r["flow"] for r in plan}
    prefix = {r["pattern"]: (r["cut"], last[r["pattern"]]["last"] if r["pattern"] in last else None) for r in plan}
    extra: dict[str, list[int]] = {p: [] for p, g in gaps.items() if g > 0}
    parts: dict[str, tuple[int, int]] = {}
    if extra:
        # One pass keeps of every size the first rows that are not taken, one for each choice; all choices are made among them.
        choices = (False, False, False, *[True] * cut)
        todo = spark.createDataFrame([(p, *prefix[p], gaps[p]) for p in extra], f"pattern string, cut int, last {_PLACE}, gap long")
        left = rows.join(F.broadcast(todo), "pattern").where("size > 0 and bucket >= cut" + ("" if cut else " and size < 2 * gap"))
        left = left.where((F.col("bucket") > F.col("cut")) | F.col("last").isNull() | (place > F.col("last")))
        of_size = Window.partitionBy("pattern", "size").orderBy("h", "doc_id", "row_id")
        left = left.select("pattern", "size", "h", "doc_id", "row_id", F.row_number().over(of_size).alias("_nth")).where(F.col("_nth") <= len(choices))
        left = stored(left.drop("_nth"), "left")
        order_of = F.struct(F.abs(F.col("size") - F.col("gap")).alias("d"), "h", "doc_id", "row_id")
        for part in choices:
            todo = [(p, gaps[p], chosen) for p, chosen in extra.items() if gaps[p] > (flows[p] / 500 if part else 0)]
            if not todo:
                continue
            open_ones = left.join(F.broadcast(spark.createDataFrame(todo, "pattern string, gap long, chosen array<long>")), "pattern")
            open_ones = open_ones.where("size > gap" if part else "size <= gap" if cut else "size < 2 * gap").where(~F.array_contains("chosen", F.col("row_id")))
            for r in open_ones.groupBy("pattern").agg(F.min_by(F.struct("row_id", "size"), order_of).alias("x")).collect():
                p, x = r["pattern"], r["x"]
                if part:
                    parts[p] = (x["row_id"], gaps[p])
                else:
                    extra[p].append(x["row_id"])
                gaps[p] -= x["size"]
        discard(left)
    plan = [(p, r["epochs"], *prefix[p], extra.get(p, []), *parts.get(p, (None, None))) for r in plan for p in [r["pattern"]]]
    plan = spark.createDataFrame(plan, f"pattern string, epochs long, cut int, last {_PLACE}, chosen array<long>, part_of long, part long")
    rows = rows.join(F.broadcast(plan), "pattern", "left")
    picked = (F.col("bucket") < F.col("cut")) | ((F.col("bucket") == F.col("cut")) & F.coalesce(place <= F.col("last"), F.lit(False))) | F.array_contains("chosen", F.col("row_id"))
    out = rows.withColumn("epochs", F.coalesce(F.col("epochs"), F.lit(0)) + F.coalesce(picked, F.lit(False)).cast("long"))
    in_part = F.when(F.col("row_id") == F.col("part_of"), F.col("part")).otherwise(0)
    out = out.select("doc_id", "sources", "size", (F.col("size") * F.col("epochs") + in_part).alias("taken"), "epochs", *keep)
    return out, {s: (sizes[s], targets[s]) for s in names}


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of `docs` as often as it is taken, with its own columns."""
    columns = [f"_{k}" for k in range(len(docs.columns))]
    named = docs.toDF(*columns)
    at = {c: f"_{k}" for k, c in enumerate(docs.columns)}
    out, _ = mix(named, size_in_words(F.col(at["text"])), F.array(F.col(at["source"]).cast("string")), id_col=at["doc_id"], keep=tuple(columns), cut=False, **options)
    whole = out.where("epochs > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("epochs").cast("int"))))
    return whole.select(*columns).toDF(*docs.columns)


def mix_query(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    out, found = mix(docs, size_in_words(F.col("text")), F.array(F.col("source").cast("string")))
    known = spark.createDataFrame([(s, n, float(t)) for s, (n, t) in found.items()], "source string, source_size long, target double")
    out = out.withColumn("_source", F.element_at("sources", 1))
    return out.join(F.broadcast(known), F.col("_source").eqNullSafe(F.col("source"))).select("doc_id", "size", "source_size", "target", "taken")
