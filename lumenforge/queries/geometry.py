"""Sizes, grids and sampling over numbers from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenforge.functions import geometry as G
from lumenforge.sources.video import sampling

from . import query, table

_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_K = ", ".join(_KEYS)
#: Sides of 1 to 5000, with budgets and explicit sizes on some lines.
_D = f"""d AS (SELECT {_K}, (l_partkey * 37 + l_linenumber * 101) % 5000 + 1 AS h, (l_orderkey * 53 + l_suppkey * 17) % 5000 + 1 AS w,
  CASE l_linenumber WHEN 3 THEN 65536 WHEN 4 THEN 20000000 END AS lo, CASE WHEN l_linenumber IN (3, 5) THEN 1048576 END AS hi,
  CASE WHEN l_linenumber = 6 OR (l_linenumber = 7 AND l_orderkey % 2 = 0) THEN l_partkey % 2000 + 1 END AS rh, CASE WHEN l_linenumber = 6 THEN l_suppkey % 2000 + 1 END AS rw FROM lineitem)"""


def _dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, o, p, s = F.col("l_linenumber"), F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    return table(spark, sf_dir, "lineitem").select(
        *_KEYS, ((p * 37 + n * 101) % 5000 + 1).alias("h"), ((o * 53 + s * 17) % 5000 + 1).alias("w"), F.when(n == 3, 65536).when(n == 4, 20000000).cast("long").alias("lo"), F.when(n.isin(3, 5), 1048576).cast("long").alias("hi"),
        F.when((n == 6) | ((n == 7) & (o % 2 == 0)), p % 2000 + 1).alias("rh"), F.when(n == 6, s % 2000 + 1).alias("rw"),
    )


def _round(n: str, f: int) -> str:
    return f"(({n}) // {f} + CASE WHEN 2 * (({n}) % {f}) > {f} OR (2 * (({n}) % {f}) = {f} AND (({n}) // {f}) % 2 = 1) THEN 1 ELSE 0 END) * {f}"


def _resize(source: str, name: str, h: str, w: str, f: int, lo: str, hi: str) -> str:
    """CTEs that add {name}_h, {name}_w and {name}_e to the rows of ``source``; the last is called {name}."""
    hb, wb = f"greatest({f}, {_round(h, f)})", f"greatest({f}, {_round(w, f)})"
    return f"""{name}0 AS (SELECT *, {hb} AS {name}_hb, {wb} AS {name}_wb, ({lo})::BIGINT AS {name}_lo, ({hi})::BIGINT AS {name}_hi FROM {source}),
{name}1 AS (SELECT *, CASE WHEN {name}_hb * {name}_wb > {name}_hi THEN floor({h} / sqrt(({h})::DOUBLE * ({w})::DOUBLE / {name}_hi::DOUBLE) / {f}.0::DOUBLE)::BIGINT * {f}
  WHEN {name}_hb * {name}_wb < {name}_lo THEN ceil({h} * sqrt({name}_lo::DOUBLE / (({h})::DOUBLE * ({w})::DOUBLE)) / {f}.0::DOUBLE)::BIGINT * {f} ELSE {name}_hb END AS {name}_rh,
  CASE WHEN {name}_hb * {name}_wb > {name}_hi THEN floor({w} / sqrt(({h})::DOUBLE * ({w})::DOUBLE / {name}_hi::DOUBLE) / {f}.0::DOUBLE)::BIGINT * {f}
  WHEN {name}_hb * {name}_wb < {name}_lo THEN ceil({w} * sqrt({name}_lo::DOUBLE / (({h})::DOUBLE * ({w})::DOUBLE)) / {f}.0::DOUBLE)::BIGINT * {f} ELSE {name}_wb END AS {name}_rw FROM {name}0),
{name} AS (SELECT *, CASE WHEN {name}_hi < {name}_lo OR {h} <= 0 OR {w} <= 0 OR greatest({h}, {w}) > 200 * least({h}, {w}) OR {name}_rh <= 0 OR {name}_rw <= 0 THEN 'media_geometry' END AS {name}_e,
  CASE WHEN {name}_e IS NULL THEN {name}_rh END AS {name}_h, CASE WHEN {name}_e IS NULL THEN {name}_rw END AS {name}_w FROM {name}1)"""


@query(f"WITH {_D} SELECT {_K}, ({_round('h', 32)})::BIGINT AS by32, ({_round('w * 8', 16)})::BIGINT AS by16 FROM d")
def round_by_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEO-1"""
    return _dims(spark, sf_dir).select(*_KEYS, G.round_by_factor(F.col("h"), 32).alias("by32"), G.round_by_factor(F.col("w") * 8, 16).alias("by16"))


@query(f"WITH {_D}, {_resize('d', 'r', 'h', 'w', 32, 'coalesce(lo, 4096)', 'coalesce(hi, 16777216)')} SELECT {_K}, r_h AS height, r_w AS width, r_e AS error FROM r")
def smart_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEO-2, GEO-3"""
    size = G.smart_resize(F.col("h"), F.col("w"), 32, F.coalesce("lo", F.lit(4096)), F.coalesce("hi", F.lit(16777216)))
    return _dims(spark, sf_dir).select(*_KEYS, size.alias("s")).select(*_KEYS, "s.height", "s.width", "s.error")


@query(f"""WITH {_D}, {_resize('d', 'r', 'h', 'w', 32, 'coalesce(lo, 4096)', 'coalesce(hi, 16777216)')}, {_resize('r', 'x', 'coalesce(rh, 1)', 'coalesce(rw, 1)', 32, '4096', '16777216')},
s AS (SELECT *, CASE WHEN rh IS NOT NULL AND rw IS NOT NULL THEN x_h ELSE r_h END AS hh, CASE WHEN rh IS NOT NULL AND rw IS NOT NULL THEN x_w ELSE r_w END AS ww, CASE WHEN rh IS NOT NULL AND rw IS NOT NULL THEN x_e ELSE r_e END AS ee FROM x),
e AS (SELECT *, CASE WHEN lo > 16777216 OR hi > 16777216 THEN 'resource_limit' WHEN greatest(h, w) > 200 * least(h, w) OR hi < lo THEN 'media_geometry' WHEN (rh IS NULL) != (rw IS NULL) THEN 'media_geometry' WHEN ee IS NOT NULL THEN ee WHEN hh * ww > 16777216 THEN 'resource_limit' END AS error FROM s)
SELECT {_K}, error, CASE WHEN error IS NULL THEN hh END AS height, CASE WHEN error IS NULL THEN ww END AS width, CASE WHEN error IS NULL THEN 1 END::BIGINT AS grid_t, CASE WHEN error IS NULL THEN hh // 16 END AS grid_h, CASE WHEN error IS NULL THEN ww // 16 END AS grid_w,
  CASE WHEN error IS NULL THEN hh // 16 * (ww // 16) END AS patch_rows, CASE WHEN error IS NULL THEN hh // 16 * (ww // 16) // 4 END AS placeholder_count, CASE WHEN error IS NULL THEN hh * ww * 3 END AS rgb_bytes, CASE WHEN error IS NULL THEN hh // 16 * (ww // 16) * 6144 END AS pixel_values_bytes FROM e""")
def image_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEO-4 to GEO-8, GEO-20"""
    plan = G.image_plan(*map(F.col, ("h", "w", "lo", "hi", "rh", "rw")))
    return _dims(spark, sf_dir).select(*_KEYS, plan.alias("p")).select(*_KEYS, "p.*")


@query(f"WITH {_D} SELECT {_K}, rh, rw, CASE WHEN (rh IS NULL) != (rw IS NULL) THEN 'media_geometry' END AS unpaired, greatest(h, w) > 200 * least(h, w) AS bad_shape FROM d")
def explicit_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEO-4, GEO-5, VAL-19"""
    return _dims(spark, sf_dir).select(*_KEYS, "rh", "rw", G.explicit_error(F.col("rh"), F.col("rw")).alias("unpaired"), G.bad_shape(F.col("h"), F.col("w")).alias("bad_shape"))


_V = "v AS (SELECT *, l_suppkey % 768 + 1 AS n, CASE WHEN l_linenumber = 2 THEN 500000 + l_partkey * 1000 END AS total, l_linenumber = 1 AS listed, l_partkey % 1000 + 16 AS vh, l_orderkey % 1000 + 16 AS vw FROM d)"
_BUDGET = """b AS (SELECT *, coalesce(lo, 131072)::BIGINT AS least_, CASE WHEN listed THEN (n + 1) // 2 * 2 ELSE n END::DOUBLE AS frames, (CASE WHEN rh IS NULL OR rw IS NULL THEN NULL ELSE 1 END) IS NOT NULL AS explicit FROM {source}),
m AS (SELECT *, greatest(least(786432.0::DOUBLE, coalesce(total::DOUBLE, 128000 * 1024.0::DOUBLE * 0.9::DOUBLE) / frames * 2), floor(least_ * 1.05::DOUBLE)) AS share FROM b),
q AS (SELECT *, CASE WHEN least(coalesce(hi::DOUBLE, share), share) >= least_ THEN floor(least(coalesce(hi::DOUBLE, share), share))::BIGINT END AS most FROM m)"""


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    return _dims(spark, sf_dir).select(
        "*", (F.col("l_suppkey") % 768 + 1).alias("n"), F.when(n == 2, 500000 + F.col("l_partkey") * 1000).alias("total"), (n == 1).alias("listed"),
        (F.col("l_partkey") % 1000 + 16).alias("vh"), (F.col("l_orderkey") % 1000 + 16).alias("vw"),
    )


@query(f"WITH {_D}, {_V}, {_BUDGET.format(source='v')} SELECT {_K}, n, most FROM q")
def video_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEO-10"""
    frames = F.when(F.col("listed"), G.padded(F.col("n"))).otherwise(F.col("n")).cast("double")
    return _clips(spark, sf_dir).select(*_KEYS, "n", G.video_budget(frames, F.coalesce("lo", F.lit(131072).cast("long")), F.col("hi"), F.col("total")).alias("most"))


@query(f"""WITH {_D}, {_V}, f0 AS (SELECT *, CASE WHEN rh IS NOT NULL AND rw IS NOT NULL THEN rh ELSE vh END AS ih, CASE WHEN rh IS NOT NULL AND rw IS NOT NULL THEN rw ELSE vw END AS iw,
  CASE WHEN rh IS NOT NULL AND rw IS NOT NULL THEN 16384 ELSE coalesce(lo, 16384) END AS ilo, CASE WHEN rh IS NOT NULL AND rw IS NOT NULL THEN 67108864 ELSE coalesce(hi, 67108864) END AS ihi FROM v),
{_resize('f0', 'i', 'ih', 'iw', 64, 'ilo', 'ihi')}, {_BUDGET.format(source='i')},
s AS (SELECT *, CASE WHEN explicit THEN rh WHEN listed THEN coalesce(i_h, 1) ELSE vh END AS sh, CASE WHEN explicit THEN rw WHEN listed THEN coalesce(i_w, 1) ELSE vw END AS sw, CASE WHEN explicit THEN 4096 ELSE least_ END AS slo, CASE WHEN explicit THEN 16777216 ELSE coalesce(most, 16777216) END AS shi FROM q),
{_resize('s', 'z', 'sh', 'sw', 32, 'slo', 'shi')},
e AS (SELECT *, CASE WHEN greatest(vh, vw) > 200 * least(vh, vw) THEN 'media_geometry' WHEN listed AND i_e IS NOT NULL THEN i_e WHEN most IS NULL THEN 'media_geometry' WHEN (rh IS NULL) != (rw IS NULL) THEN 'media_geometry' ELSE z_e END AS error FROM z)
SELECT {_K}, error, CASE WHEN error IS NULL THEN z_h END AS height, CASE WHEN error IS NULL THEN z_w END AS width, CASE WHEN error IS NULL THEN (n + 1) // 2 END AS grid_t, CASE WHEN error IS NULL THEN z_h // 16 * (z_w // 16) * ((n + 1) // 2) END AS patch_rows FROM e""")
def video_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEO-9 to GEO-12"""
    c = F.col
    plan = G.video_plan(c("vh"), c("vw"), c("n"), c("lo"), c("hi"), c("rh"), c("rw"), c("total"), c("listed"))
    return _clips(spark, sf_dir).select(*_KEYS, plan.alias("p")).select(*_KEYS, "p.error", "p.height", "p.width", "p.grid_t", "p.patch_rows")


@query("""
SELECT o_orderkey, (o_orderkey % 900 + 1) AS available, CASE WHEN even >= 2 AND even <= available THEN even END AS explicit_n,
  CASE WHEN available = 1 THEN 1 ELSE floor(least(greatest(available / 25.0::DOUBLE * 2.0::DOUBLE, 4.0), floor(least(768, available) / 2)::BIGINT * 2, available) / 2)::BIGINT * 2 END AS by_rate
FROM (SELECT *, o_orderkey % 900 + 1 AS available, (round_even(((o_custkey % 120) / 2)::DOUBLE, 0) * 2)::BIGINT AS even FROM orders) WHERE available != 2 OR true""")
def nframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEO-15, GEO-16"""
    a = F.col("o_orderkey") % 900 + 1
    rows = table(spark, sf_dir, "orders").select("o_orderkey", a.alias("available"), (F.col("o_custkey") % 120).alias("n"))
    return rows.select("o_orderkey", "available", G.nframes_explicit(F.col("n"), F.col("available")).alias("explicit_n"), G.nframes_by_rate(F.col("available"), F.lit(25.0)).alias("by_rate"))


@query("""
WITH c AS (SELECT o_orderkey, o_orderkey % 500 + 1 AS total, (o_custkey % 40) / 4.0::DOUBLE AS a, (o_custkey % 97) / 4.0::DOUBLE AS b FROM orders),
r AS (SELECT *, ceil(greatest(0.0, least(a, total / 24.0::DOUBLE)) * 24.0::DOUBLE)::BIGINT AS s, least(floor(greatest(0.0, least(b, total / 24.0::DOUBLE)) * 24.0::DOUBLE)::BIGINT, total - 1) AS e FROM c),
f AS (SELECT *, CASE WHEN s > e OR (s = e AND total > 1) THEN 'media_geometry' END AS error FROM r)
SELECT o_orderkey, CASE WHEN error IS NULL THEN s END AS first_frame, CASE WHEN error IS NULL THEN e END AS last_frame, error FROM f""")
def clip_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEO-18"""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 500 + 1).alias("total"), ((F.col("o_custkey") % 40) / 4).alias("a"), ((F.col("o_custkey") % 97) / 4).alias("b"))
    cut = G.clip_range(F.col("total"), F.lit(24.0), F.col("a"), F.col("b"))
    return rows.select("o_orderkey", cut.alias("c")).select("o_orderkey", F.col("c.start").alias("first_frame"), F.col("c.end").alias("last_frame"), "c.error")


@query()
def sample_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEO-15 to GEO-19: whole sampling of clips; single-precision steps have no SQL"""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 900 + 1).alias("total"))
    return rows.select("o_orderkey", *(v.alias(k) for k, v in sampling(F.col("total"), F.lit(25.0)).items()))


@query("""
WITH f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, (epoch_us(ts) - 1704067200000000) / 1e6::DOUBLE AS s FROM events),
g AS (SELECT user_id, list(s ORDER BY k) AS l FROM f GROUP BY user_id),
p AS (SELECT user_id, CASE WHEN len(l) % 2 = 1 THEN list_append(l, l[-1]) ELSE l END AS l FROM g)
SELECT user_id, unnest(range(len(l) // 2)) AS pair, (l[2 * pair + 1] + l[2 * pair + 2]) / 2 AS seconds FROM p""")
def temporal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-10, GEO-13: events of a user as the times of a clip's frames"""
    s = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', cast(ts AS timestamp_ntz))") / F.lit(1e6)
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", s.alias("s")))).alias("f"))
    rows = rows.select("user_id", F.transform("f", lambda x: x["s"]).alias("s"))
    facts = G.video_metadata(F.size("s").cast("long"), F.lit(30.0), times=F.col("s"))
    return rows.select("user_id", F.posexplode(facts["timestamps"]).alias("pair", "seconds")).select("user_id", F.col("pair").cast("long").alias("pair"), "seconds")


@query("""
SELECT p_partkey, (p_size::BIGINT * 1000000007)::DECIMAL(38,0) * (p_partkey + 1) AS small, CASE WHEN (p_size::DECIMAL(38,0) * 900000000000000000) <= 18446744073709551615 THEN (p_size::DECIMAL(38,0) * 900000000000000000) END AS large FROM part""")
def checked_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEO-21, VAL-24"""

    def d(x) -> object:
        return x.cast("decimal(20,0)")

    return table(spark, sf_dir, "part").select(
        "p_partkey", G.checked_product(F.array(d(F.col("p_size")), d(F.lit(1000000007)), d(F.col("p_partkey") + 1))).alias("small"), G.checked_product(F.array(d(F.col("p_size")), d(F.lit(900000000000000000)))).alias("large"),
    )


@query("""
WITH c AS (SELECT p_partkey, (p_partkey % 50 + 4) AS cells FROM part), r AS (SELECT p_partkey, cells, unnest(range(1, floor(sqrt(cells))::BIGINT + 1)) AS rows FROM c),
b AS (SELECT p_partkey, max((rows * least(cells // rows, rows * 200), rows, least(cells // rows, rows * 200))) AS best FROM r GROUP BY p_partkey)
SELECT p_partkey, best[2] * 32 AS height, best[3] * 32 AS width FROM b""")
def largest_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-11"""
    return table(spark, sf_dir, "part").select("p_partkey", G.largest_size((F.col("p_partkey") % 50 + 4) * 1024).alias("s")).select("p_partkey", "s.height", "s.width")


@query("SELECT p_partkey, (p_size * 1000 >= 4096 AND p_size * 1000 <= p_partkey * 10000 AND p_partkey * 10000 <= 16777216) AS ok FROM part")
def pixel_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEO-22, SNK-10"""
    return table(spark, sf_dir, "part").select("p_partkey", G.budgets_ok(F.col("p_size") * 1000, F.col("p_partkey") * 10000).alias("ok"))
