"""Mixing sources to target weights. DataFrame functions only.

1. Each source's words are summed, and targets found by filling to the caps: sources in
   order of cap by weight, the first one that its share does not overfill sets the level.
2. A source is cut into 1024 blocks by 10 bits of a hash of doc_id and text, in the order of a
   permutation. Its block quota is what meets its target: every block once a pass, then the first
   blocks of the permutation while they fit. Of the block on the border the first documents are
   drawn while they fit, and then, up to ``FILL`` times, the largest document of the source that fits what is left; the last
   time, the one of the nearest size.
3. The quotas of all sources are split among output shards down a binary tree. A node
   sends a uniformly random half of its block units left, so the sources' quotas of a child
   have the multivariate hypergeometric law and add up exactly. A shard then draws its quota of a
   source as the next stretch of the permuted blocks: no two shards draw one block in the same pass.
4. Inside a shard, the copies of documents are put in the order of a hash: the local shuffle.

The tree and the permutation work on blocks, at most 1024 * passes a source, never on documents; only the
documents of border blocks, 1 / 1024 of a source, are ordered, as rows of a hash and a size. Documents meet
one row a source. Everything hangs on MD5 of identifiers and texts, so reruns agree whatever the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .common import unit, word_count

BLOCK_BITS, CAP, WEIGHTS, DEPTH, FILL = 10, 3.0, (5, 2, 1), 4, 4
LABEL = "case when source is null then 'n' else concat('s', source) end"
#: The most sources whose draws are sent to all executors, 1.2 KB each; more are joined by a shuffle.
BROADCAST = 10_000


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """source, source_size -> target of each source, in words.

    ``sources`` has one row per source; they are ordered in one task. Sources in order of code point, null last, weigh
    ``weights`` in turn. With no words at all every target is 0.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    nth = (F.row_number().over(by_name) - 1) % len(weights) + 1
    w = sources.select("source", "source_size", nth.alias("_nth")).select(
        "source", "source_size", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("_nth")).alias("weight")
    )
    w = w.withColumn("limit", F.col("source_size") * cap)
    fill = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    w = w.withColumn("total", F.sum("source_size").over(Window.partitionBy()).cast("double"))
    w = w.withColumn("level", (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    fits = F.col("level") * F.col("weight") <= F.col("limit")
    w = w.withColumn("found", F.min(F.when(fits, F.struct(F.col("limit") / F.col("weight"), "level"))).over(Window.partitionBy())["level"])
    share = F.coalesce(F.col("found") * F.col("weight"), F.col("limit"))
    return w.select("source", "source_size", F.least("limit", share).alias("target"))


def placed(docs: DataFrame, *more: Column | str) -> DataFrame:
    """Label of the source, hash and block of each document, and the columns ``more``."""
    name = F.concat_ws(":", F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    rows = docs.select(*more, F.expr(LABEL).alias("label"), unit(name, "/mix").alias("u"))
    return rows.withColumn("block", F.shiftright("u", 60 - BLOCK_BITS).cast("int"))


def draws(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """One row a source: label, source_size, target, passes, whole (of each block, 1 if it is drawn once more), border (the block drawn in part), cut (its last hash), extra (hashes of single documents).

    rows: source, label, u, block, size, a written table.
    """
    blocks = scratch.table(rows.groupBy("source", "label", "block").agg(F.sum("size").alias("words")), "blocks")
    goal = targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap)
    goal = goal.withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    goal = goal.withColumn("passes", F.least(F.floor("ratio"), F.lit(int(cap))))
    rest = F.greatest(F.col("target") - F.col("passes") * F.col("source_size"), F.lit(0.0))
    goal = goal.select(F.expr(LABEL).alias("label"), "source_size", "target", "passes", F.when(F.col("passes") >= int(cap), 0.0).otherwise(rest).alias("rest"))
    goal = scratch.table(goal, "goals")
    order = Window.partitionBy("label").orderBy(unit(F.concat_ws(":", "label", "block"), "/draw"), "block")
    ends = F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0))
    sized = blocks.drop("source").join(goal, "label").withColumn("ends", ends)
    sized = sized.withColumn("full", (F.col("rest") > 0) & (F.col("ends") <= F.col("rest")))
    sized = sized.withColumn("left", F.when(~F.col("full") & (F.col("ends") - F.col("words") < F.col("rest")), F.col("rest") - F.col("ends") + F.col("words")))
    sized = scratch.table(sized.select("label", "block", "words", "full", "left"), "sized")
    blank = F.lit("0" * (1 << BLOCK_BITS))
    flags = F.sort_array(F.collect_list(F.struct("block", F.col("full").cast("int").cast("string").alias("f"))))  # of 1024 blocks
    whole = F.aggregate(flags, blank, lambda s, x: F.overlay(s, x["f"], x["block"] + 1))
    by = sized.groupBy("label").agg(whole.alias("whole"), F.sum(F.when(F.col("full"), F.col("words")).otherwise(0)).alias("drawn"), F.max(F.when(F.col("left").isNotNull(), F.col("block"))).alias("border"))
    inside = rows.join(sized.where("left is not null").select("label", "block", "left"), ["label", "block"])
    done = F.sum("size").over(Window.partitionBy("label").orderBy("u"))  # rows of equal hashes together
    inside = inside.select("label", "u", "size", "left", done.alias("done")).where("done <= left")
    cut = inside.groupBy("label").agg(F.max("u").alias("cut"), F.sum("size").alias("more"))
    state = goal.join(by, "label", "left").join(cut, "label", "left")
    gap = F.when(F.col("rest") > 0, F.col("rest") - F.col("drawn") - F.coalesce("more", F.lit(0))).otherwise(0.0)
    state = scratch.table(state.select("label", "source_size", "target", "passes", "whole", "border", "cut", gap.alias("gap")), "draws")
    spare = rows.join(state.where("gap > 0").select("label", "border", "cut", "whole"), "label")
    spare = spare.where(~drawn()).groupBy("label", "size").agg(F.min("u").alias("u"))
    return filled(state, scratch.table(spare, "spare"))


def filled(state: DataFrame, spare: DataFrame) -> DataFrame:
    """``state`` with extra: hashes of the documents that bring each source nearest to its target. spare: label, size, u; one document a size."""
    now = state.withColumn("extra", F.array().cast("array<long>"))
    for k in range(FILL):
        off = F.abs(F.col("gap") - F.col("size"))
        near = off < F.col("gap") if k == FILL - 1 else (F.col("size") <= F.col("gap")) & (F.col("size") > 0)
        some = spare.join(now.select("label", "gap", "extra"), "label").where(near & ~F.array_contains("extra", F.col("u")))
        best = some.groupBy("label").agg(F.min(F.struct(off.alias("off"), "u", "size")).alias("best"))
        now = now.join(best, "label", "left").withColumn("gap", F.col("gap") - F.coalesce("best.size", F.lit(0)))
        now = now.withColumn("extra", F.when(F.col("best").isNull(), F.col("extra")).otherwise(F.concat("extra", F.array("best.u")))).drop("best")
        now = scratch.table(now, "draws")
    return now


def drawn() -> Column:
    """Whether a document lies in what is drawn of its source's last pass, but for single documents."""
    return (F.substring("whole", F.col("block") + 1, 1) == "1") | F.coalesce((F.col("block") == F.col("border")) & (F.col("u") <= F.col("cut")), F.lit(False))


def with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (label, u, block, ...) with copies, source_size and target of each. plan: from ``draws``, one row a source, sent to all executors if there are few."""
    few = plan.count() <= BROADCAST
    plan = plan.select("label", "source_size", "target", "passes", "whole", "border", "cut", "extra")
    more = drawn() | F.array_contains("extra", F.col("u"))
    rows = rows.join(F.broadcast(plan) if few else plan, "label")
    return rows.withColumn("copies", (F.col("passes") + more.cast("long")).cast("long")).drop("passes", "whole", "border", "cut", "extra")


def split_tree(units: DataFrame, depth: int) -> DataFrame:
    """The quota tree: deal block units (label, block, copy) to ``2 ** depth`` shards; each node sends a random half to the left."""
    node = units.withColumn("shard", F.lit(0).cast("long"))
    for level in range(depth):
        order = Window.partitionBy("shard").orderBy(unit(F.concat_ws(":", "label", "block", "copy"), f"/split{level}"), "label", "block", "copy")
        size = F.count(F.lit(1)).over(Window.partitionBy("shard"))
        right = (F.row_number().over(order) > F.floor((size + (F.col("shard") + level) % 2) / 2)).cast("long")
        node = node.withColumn("_right", right).withColumn("shard", F.col("shard") * 2 + F.col("_right")).drop("_right")
    return node


def dealt_blocks(units: DataFrame, depth: int) -> DataFrame:
    """label, block, and the shard of each copy of the block: a shard's quota of a source is the next stretch of its permuted blocks, pass by pass."""
    units = units.withColumn("nth", F.row_number().over(Window.partitionBy("label").orderBy("copy", unit(F.concat_ws(":", "label", "block"), "/draw"), "block")))
    shards = split_tree(units.select("label", "block", "copy"), depth)
    shards = shards.select("label", "shard", F.row_number().over(Window.partitionBy("label").orderBy("shard")).alias("nth"))  # only the quotas of shards matter
    return units.join(shards, ["label", "nth"]).groupBy("label", "block").agg(F.array_sort(F.collect_list(F.struct("copy", "shard"))).alias("dealt"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP, depth: int = DEPTH) -> DataFrame:
    """How often the mix takes each document, to which output shards the copies go, and where they come in those.

    docs: doc_id, text, source. Returns one row per input row: doc_id, size, source_size, target, taken, copies,
    shards (of each copy, by commas, empty if none), orders (of each copy: a shard's documents are put in this order).
    Null text has size 0; documents of size 0 are taken with their block and add no words.
    Rows equal in doc_id and text are taken equally often. An empty table gives an empty result.
    """
    rows = scratch.table(placed(docs, "doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    rows = with_copies(rows, draws(rows, weights, cap))
    used = rows.groupBy("label", "block").agg(F.max("copies").alias("n"))
    units = used.where("n > 0").select("label", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))
    dealt = dealt_blocks(scratch.table(units, "units"), depth)
    rows = rows.join(scratch.table(dealt, "dealt"), ["label", "block"], "left")
    some = F.slice(F.coalesce("dealt", F.array()), F.lit(1), F.col("copies").cast("int"))
    shards = F.array_join(F.transform(some, lambda x: x["shard"].cast("string")), ",")
    orders = F.array_join(F.transform(some, lambda x: unit(F.concat_ws(":", "u", x["copy"]), "/order").cast("string")), ",")
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", shards.alias("shards"), orders.alias("orders"))


def copies(docs: DataFrame, name: str, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """docs with a column ``name``: how often ``mix`` takes each. Whole rows meet one row a source; they are ordered nowhere."""
    rows = scratch.table(placed(docs, "source", word_count(F.col("text")).alias("size")), "sizes")
    whole = placed(docs, "doc_id", F.struct(*(F.col(f"`{x}`") for x in docs.columns)).alias("row"))
    return with_copies(whole, draws(rows, weights, cap)).select("row.*", F.col("copies").alias(name))


_LEVELS = "\n".join(
    f"""l{n + 1} AS (SELECT label, block, copy, shard * 2 + CASE WHEN row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(label || ':' || block || ':' || copy || '/split{n}'), 1, 15))::BIGINT, label, block, copy)
  > (count(*) OVER (PARTITION BY shard) + (shard + {n}) % 2) // 2 THEN 1 ELSE 0 END AS shard FROM l{n}),"""
    for n in range(DEPTH)
)
_FILLS = "\n".join(
    f"""f{n + 1} AS (SELECT s.label, s.gap - coalesce(b.size, 0) AS gap, CASE WHEN b.u IS NULL THEN s.extra ELSE list_append(s.extra, b.u) END AS extra FROM f{n} s LEFT JOIN
  (SELECT label, arg_min(u, (abs(gap - size), u)) AS u, arg_min(size, (abs(gap - size), u)) AS size FROM spare JOIN f{n} USING (label) WHERE {"abs(gap - size) < gap" if n == FILL - 1 else "size <= gap AND size > 0"} AND NOT list_contains(extra, u) GROUP BY label) b ON s.label = b.label),"""
    for n in range(FILL)
)
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS label,
  length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'x', 'g'), '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS size,
  ('0x' || substr(md5(concat_ws(':', doc_id::VARCHAR, md5(coalesce(text, ''))) || '/mix'), 1, 15))::BIGINT AS u FROM documents),
r AS (SELECT *, u >> {60 - BLOCK_BITS} AS block FROM d),
b AS (SELECT source, label, block, sum(size)::BIGINT AS words FROM r GROUP BY ALL),
s AS (SELECT source, label, sum(words)::BIGINT AS source_size FROM b GROUP BY source, label),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size::DOUBLE * 3 AS lim FROM s),
f AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(lim) OVER (ORDER BY lim / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY lim / weight, source IS NULL, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
g AS (SELECT label, source_size, least(lim, coalesce((SELECT arg_min(lev, (lim / weight, lev)) FROM f WHERE lev * weight <= lim) * weight, lim)) AS target FROM f),
p AS (SELECT *, least(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END), 3)::BIGINT AS passes FROM g),
q AS (SELECT *, CASE WHEN passes >= 3 THEN 0 ELSE greatest(target - passes * source_size, 0) END AS rest FROM p),
z AS (SELECT b.label, b.block, words, q.rest, ('0x' || substr(md5(b.label || ':' || block || '/draw'), 1, 15))::BIGINT AS at,
  sum(words) OVER (PARTITION BY b.label ORDER BY ('0x' || substr(md5(b.label || ':' || block || '/draw'), 1, 15))::BIGINT, block ROWS UNBOUNDED PRECEDING) AS ends FROM b JOIN q USING (label)),
y AS (SELECT *, rest > 0 AND ends <= rest AS entire, CASE WHEN NOT (rest > 0 AND ends <= rest) AND ends - words < rest THEN rest - ends + words END AS room FROM z),
i AS (SELECT r.label, u, size, room, sum(size) OVER (PARTITION BY r.label ORDER BY u) AS done FROM r JOIN y ON r.label = y.label AND r.block = y.block WHERE room IS NOT NULL),
c AS (SELECT label, max(u) AS cut, sum(size) AS more FROM i WHERE done <= room GROUP BY label),
v AS (SELECT r.*, coalesce(y.entire OR (y.room IS NOT NULL AND u <= cut), false) AS inside FROM r JOIN y ON r.label = y.label AND r.block = y.block LEFT JOIN c ON r.label = c.label),
f0 AS (SELECT q.label, CASE WHEN rest > 0 THEN rest - (SELECT sum(CASE WHEN entire THEN words ELSE 0 END) FROM y WHERE y.label = q.label) - coalesce(more, 0) ELSE 0 END AS gap, []::BIGINT[] AS extra FROM q LEFT JOIN c USING (label)),
spare AS (SELECT label, size, min(u) AS u FROM v WHERE NOT inside GROUP BY label, size),
{_FILLS}
t AS (SELECT v.*, q.source_size, q.target, passes + CASE WHEN inside OR list_contains(extra, u) THEN 1 ELSE 0 END AS copies FROM v JOIN q USING (label) JOIN f{FILL} USING (label)),
l0 AS (SELECT label, block, unnest(range(n)) AS copy, 0 AS shard FROM (SELECT label, block, max(copies) AS n FROM t GROUP BY ALL)),
{_LEVELS}
o AS (SELECT l0.label, l0.block, copy, row_number() OVER (PARTITION BY l0.label ORDER BY copy, z.at, l0.block) AS nth FROM l0 JOIN z ON l0.label = z.label AND l0.block = z.block),
k AS (SELECT label, shard, row_number() OVER (PARTITION BY label ORDER BY shard) AS nth FROM l{DEPTH}),
e AS (SELECT label, block, list(shard ORDER BY copy) AS dealt FROM o JOIN k USING (label, nth) GROUP BY ALL)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies::BIGINT AS copies, coalesce(array_to_string(dealt[1:copies], ','), '') AS shards,
  array_to_string([('0x' || substr(md5(u || ':' || x || '/order'), 1, 15))::BIGINT for x in range(copies)], ',') AS orders
FROM t LEFT JOIN e ON t.label = e.label AND t.block = e.block
"""
