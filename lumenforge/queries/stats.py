"""Statistics over measurements from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenforge.functions import stats as S

from . import query, table


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*(F.round(x, 6).alias(x) if x in names else F.col(x) for x in df.columns))


@query("""SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, CASE WHEN count(value) >= 100 THEN round(quantile_cont(value, 0.99), 6) END AS p99, min(value) AS least, max(value) AS most FROM events GROUP BY event_type""")
def sample_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-10, AGG-12"""
    return _rounded(S.summary(table(spark, sf_dir, "events"), ["event_type"], "value"), "p50", "p90", "p99")


@query("SELECT user_id, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY user_id")
def nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-11"""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(*(S.nearest_rank("value", q).alias(f"p{round(q * 100)}") for q in (0.5, 0.95, 0.99)))


@query("""SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, round(quantile_cont(l_extendedprice, 0.5), 6) AS l_extendedprice_p50, round(quantile_cont(l_extendedprice, 0.9), 6) AS l_extendedprice_p90,
  round(quantile_cont(l_quantity, 0.5), 6) AS l_quantity_p50, round(quantile_cont(l_quantity, 0.9), 6) AS l_quantity_p90, round(quantile_cont(l_extendedprice / l_quantity, 0.5), 6) AS speedup FROM lineitem GROUP BY ALL""")
def pair_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-13"""
    out = S.pair_summary(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"], "l_extendedprice", "l_quantity")
    return _rounded(out, *(x for x in out.columns if x.endswith(("_p50", "_p90")) or x == "speedup"))


_E = "e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings), v AS (SELECT *, floor(x * 256 + 128) AS expected, floor(x * 256 + 128 + (pos % 7) - 3) AS actual FROM e)"


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "x"))
    x = F.col("x").cast("double") * 256 + 128
    return rows.select("vec_id", "label", "pos", F.floor(x).cast("double").alias("expected"), F.floor(x + F.col("pos") % 7 - 3).cast("double").alias("actual"))


@query(f"""WITH {_E} SELECT label, max(abs(actual - expected)) AS max_err, round(sqrt(avg((actual - expected) * (actual - expected))), 6) AS rmse, quantile_disc(abs(actual - expected), 0.99) AS p99, round(avg(actual - expected), 6) AS bias, round(avg(abs(actual - expected)), 6) AS mae,
  CASE WHEN avg((actual - expected) * (actual - expected)) > 0 THEN round(10 * log10(65025.0::DOUBLE / avg((actual - expected) * (actual - expected))), 6) END AS psnr FROM v GROUP BY label""")
def channel_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-19, but for SSIM: embeddings as pixels"""
    return _rounded(S.channel_metrics(_values(spark, sf_dir), ["label"], "expected", "actual"), "rmse", "bias", "mae", "psnr")


@query(f"""WITH {_E}, a AS (SELECT *, abs(actual - expected) AS d FROM v) SELECT vec_id, max(d) AS max_err, round(sqrt(avg(d * d)), 6) AS rmse, round(quantile_cont(d, 0.5), 6) AS p50, round(quantile_cont(d, 0.9), 6) AS p90, round(quantile_cont(d, 0.99), 6) AS p99,
  count(*) FILTER (WHERE d > 2) AS over, min(pos) FILTER (WHERE d > 2)::INT AS first FROM a GROUP BY vec_id""")
def numeric_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-18, TOPK-2"""
    return _rounded(S.diagnostics(_values(spark, sf_dir), ["vec_id"], "expected", "actual", "pos", 2.0), "rmse", "p50", "p90", "p99")


_S = """s AS (SELECT event_id // 8 AS trace, event_id % 8 AS id, CASE WHEN event_id % 8 > 0 THEN (event_id % 8 - 1) // 2 END AS parent, event_type AS name, (user_id % 50 + 1) * CASE WHEN event_id % 8 = 0 THEN 100 WHEN event_id % 8 < 3 THEN 10 ELSE 1 END AS duration FROM events)"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 8
    weight = F.when(k == 0, 100).when(k < 3, 10).otherwise(1)
    return table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 8).alias("trace"), k.alias("id"), F.when(k > 0, F.floor((k - 1) / 2)).alias("parent"), F.col("event_type").alias("name"), ((F.col("user_id") % 50 + 1) * weight).alias("duration"))


@query(f"""WITH {_S}, i AS (SELECT trace, parent AS id, sum(duration) AS inside FROM s WHERE parent IS NOT NULL GROUP BY ALL) SELECT s.trace, s.id, s.name, s.duration, (duration - coalesce(inside, 0))::BIGINT AS exclusive FROM s LEFT JOIN i ON s.trace = i.trace AND s.id = i.id""")
def stage_exclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-12, OBS-1: events as spans of traces of eight"""
    return S.exclusive(_spans(spark, sf_dir), ["trace"]).select("trace", "id", "name", "duration", "exclusive")


@query(f"""WITH {_S}, i AS (SELECT trace, parent AS id, sum(duration) AS inside FROM s WHERE parent IS NOT NULL GROUP BY ALL), e AS (SELECT s.*, duration - coalesce(inside, 0) AS ex, s.trace % 4 AS lane FROM s LEFT JOIN i ON s.trace = i.trace AND s.id = i.id),
g AS (SELECT lane, name, sum(ex)::BIGINT AS total, count(*) AS n FROM e GROUP BY ALL) SELECT lane, name, total, floor(total / n)::BIGINT AS mean, n, round(total / sum(total) OVER (PARTITION BY lane), 6) AS share FROM g""")
def stage_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-15"""
    spans = S.exclusive(_spans(spark, sf_dir), ["trace"]).withColumn("lane", F.col("trace") % 4)
    return _rounded(S.stage_ranking(spans, ["lane"]), "share")


@query("""WITH d AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'click' THEN -(event_id % 40) ELSE event_id % 100 END AS delta FROM events), r AS (SELECT *, sum(delta) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS live FROM d)
SELECT user_id, greatest(max(live), 0)::BIGINT AS peak, sum(delta)::BIGINT AS live FROM r GROUP BY user_id""")
def memory_highwater(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-9, WIN-13"""
    delta = F.when(F.col("event_type") == "click", -(F.col("event_id") % 40)).otherwise(F.col("event_id") % 100)
    return S.high_water(table(spark, sf_dir, "events").withColumn("delta", delta), ["user_id"], ["ts", "event_id"], "delta")


@query("""WITH l AS (SELECT p_type || ';' || p_brand || ';' || split_part(p_name, ' ', 1) || ';' || p_type AS stack, p_size AS samples FROM part), f AS (SELECT samples, unnest(list_distinct(string_split(stack, ';'))) AS frame, string_split(stack, ';')[-1] AS leaf FROM l)
SELECT frame, sum(samples)::BIGINT AS inclusive, sum(CASE WHEN frame = leaf THEN samples ELSE 0 END)::BIGINT AS self, round(sum(samples) / (SELECT sum(samples) FROM l), 6) AS share FROM f GROUP BY frame""")
def stack_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-16"""
    word = F.split("p_name", " ")[0]
    lines = table(spark, sf_dir, "part").select(F.concat_ws(";", "p_type", "p_brand", word, "p_type").alias("stack"), F.col("p_size").cast("long").alias("samples"))
    return _rounded(S.stack_ranking(lines), "share")


@query("""WITH m AS (SELECT event_type, user_id % 10 AS process, median(value) AS m FROM events GROUP BY ALL) SELECT event_type, count(*) AS processes, round(stddev_samp(m) / avg(m), 6) AS noise, stddev_samp(m) / avg(m) <= 0.05 AS steady FROM m GROUP BY event_type""")
def process_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-17, HAR-14"""
    rows = table(spark, sf_dir, "events").withColumn("process", F.col("user_id") % 10)
    return _rounded(S.process_noise(rows, ["event_type"], "process", "value"), "noise")


@query("""SELECT user_id, list_sort(list(DISTINCT event_type)) AS seen, list_sort(list_filter(['click', 'error', 'purchase', 'resize'], lambda x: NOT list_contains(list(DISTINCT event_type), x))) AS missing FROM events GROUP BY user_id""")
def coverage_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-22, SET-4"""
    rows = table(spark, sf_dir, "events").select("user_id", F.array("event_type").alias("tags"))
    return S.coverage(rows, ["user_id"], "tags", ["click", "error", "purchase", "resize"])


@query("""WITH k AS (SELECT o_orderpriority AS kind, o_orderstatus AS state, o_custkey % 2 AS lane, o_totalprice AS ms FROM orders)
SELECT kind, state, round(median(ms) FILTER (WHERE lane = 0), 6) AS native, round(median(ms) FILTER (WHERE lane = 1), 6) AS official, round((median(ms) FILTER (WHERE lane = 0) / median(ms) FILTER (WHERE lane = 1) - 1) * 100, 6) AS change FROM k GROUP BY ALL""")
def serving_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-21"""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("state"), F.when(F.col("o_custkey") % 2 == 0, "native").otherwise("official").alias("mode"), "o_totalprice")
    return _rounded(S.serving_medians(rows, ["kind", "state"], "mode", "o_totalprice"), "native", "official", "change")


@query("SELECT label, sha256(string_agg(vec_id || ':' || round(embedding[1] * 1000)::BIGINT, ',' ORDER BY vec_id)) AS signature FROM embeddings GROUP BY label")
def output_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-23"""
    first = F.round(F.col("embedding")[0] * 1000).cast("long")
    text = F.concat_ws(":", F.col("vec_id").cast("string"), first.cast("string"))
    return S.signature(table(spark, sf_dir, "embeddings"), ["label"], "vec_id", text)


@query("""WITH a AS (SELECT vec_id AS id, label FROM embeddings), b AS (SELECT vec_id AS id, CASE WHEN vec_id % 50 = 7 THEN label + 1 ELSE label END AS label FROM embeddings WHERE vec_id % 60 != 3)
SELECT coalesce(a.id, b.id) AS id, a.label AS expected, b.label AS actual FROM a FULL JOIN b ON a.id = b.id WHERE a.label IS DISTINCT FROM b.label""")
def manifest_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-8, SET-5, HAR-3"""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    other = rows.where(F.col("id") % 60 != 3).withColumn("label", F.when(F.col("id") % 50 == 7, F.col("label") + 1).otherwise(F.col("label")))
    return S.difference(rows, other, "id", "label")


@query("""WITH c AS (SELECT o_orderkey, o_orderkey % 2 = 0 AS batch, (o_custkey % 40) / 16.0::DOUBLE AS s, CASE WHEN o_orderkey % 7 <> 0 THEN (o_custkey % 33) / 16.0::DOUBLE END AS t, (o_orderkey % 17) / 16.0::DOUBLE AS e, (o_orderkey % 13) / 16.0::DOUBLE AS m FROM orders)
SELECT o_orderkey, list_filter([CASE WHEN NOT CASE WHEN batch THEN s >= 2 ELSE s > 1 END THEN 'speedup' END, CASE WHEN t > 1.05 THEN 'text_ratio' END, CASE WHEN e < 0.6 THEN 'efficiency' END, CASE WHEN m > 0.5 THEN 'memory_ratio' END], lambda x: x IS NOT NULL) AS failed FROM c""")
def release_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-17, HAR-14"""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (k % 2 == 0).alias("batch"), (c % 40 / 16).alias("speedup_low"), F.when(k % 7 != 0, c % 33 / 16).alias("text_ratio"), (k % 17 / 16).alias("efficiency"), (k % 13 / 16).alias("memory_ratio"))
    return S.release_gates(rows).select("o_orderkey", "failed")


@query()
def bootstrap_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-14: tested against a second implementation; SQL can't resample"""
    rows = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.percentile("value", 0.5).alias("m"))
    return S.bootstrap(rows, ["event_type"], "m", seed=1, resamples=2000)
