"""Role repair, mixing and sharding."""

from __future__ import annotations

import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lumenforge.llm import chat, mixing, sharding
from lumenforge.llm.queries import QUERIES


def test_automaton():
    r = random.Random(1)
    for _ in range(200):
        labels = [r.randrange(-1, 4) for _ in range(r.randrange(1, 6))]
        best = chat.FAR
        for roles in itertools.product(range(4), repeat=len(labels)):
            s, cost = chat.START, 0
            for x, role in zip(labels, roles, strict=True):
                cost, s = cost + chat.step(s, x, role)[0], role
            best = min(best, cost + chat.INSERT * len(chat.inserted(s, chat.END) or ()))
        assert chat.cheapest(labels)[0] == best


def legal(roles):
    s = chat.START
    for x in [*roles, chat.END]:
        if x not in chat.NEXT[s]:
            return False
        s = x
    return True


@pytest.fixture
def many_ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_repair(spark, many_ranges):
    r = random.Random(2)
    names = ["user", "assistant", "tool", "system", "Human", " bot ", None, "??"]
    rows = [(1, k, r.choice(names), f"t{k}", 1) for k in range(700)]  # crosses most ranges
    rows += [(c, k, r.choice(names), r.choice(["", None, "hello <|im_start|>"]), 1) for c in range(2, 40) for k in range(r.randrange(1, 8))]
    rows += [(None, 0, "user", "a", 1), (None, None, "user", "b", 1), (50, 0, "user", "same", 1), (50, 0, "user", "same", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place int").repartition(4)
    got = chat.repair(df).collect()
    assert len(got) == len(rows)
    by = {}
    for g in got:
        by.setdefault(g.conv_id, []).append(g)
    for conv, turns in by.items():
        turns.sort(key=lambda g: g.place)
        assert [g.place for g in turns] == list(range(len(turns)))
        keys = [(g.turn is not None, g.turn or 0) for g in turns]
        assert keys == sorted(keys)
        labels = [chat.NAMES.get((g.role or "").strip(" ").lower(), -1) for g in turns]
        cost, roles = chat.cheapest(labels)
        assert [chat.ROLES[x] for x in roles] == [g.new_role for g in turns], conv
        final, spent = [], 0
        for g, x in zip(turns, labels, strict=True):
            extra = [chat.ROLES.index(y) for y in g.inserted.split(",") if y]
            merged = "merge" in g.action
            final += extra + ([] if merged else [chat.ROLES.index(g.new_role)])
            spent += chat.INSERT * len(extra) + chat.MERGE * merged + (chat.NAME if x < 0 else chat.RELABEL * (chat.ROLES[x] != g.new_role))
        final += [chat.ROLES.index(y) for g in turns for y in g.appended.split(",") if y]
        spent += chat.INSERT * sum(len([y for y in g.appended.split(",") if y]) for g in turns)
        assert legal(final) and spent == cost
        whole = "".join(g.rendered for g in turns)
        assert whole.count("<|im_start|>") == whole.count("<|im_end|>\n") == len(final) and whole.endswith("<|im_end|>\n")
        assert [x.split("\n")[0] for x in whole.split("<|im_start|>")[1:]] == [chat.ROLES[x] for x in final]
    assert chat.repair(df.limit(0)).count() == 0


def test_targets(spark):
    def of(sizes):
        df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
        return {r.source: r.target for r in mixing.targets(df).collect()}

    assert of({"a": 80, "b": 80, "c": 80}) == {"a": 150.0, "b": 60.0, "c": 30.0}
    capped = of({"a": 10, "b": 100, "c": 100})
    assert capped["a"] == 30.0 and abs(capped["b"] - 120) < 1e-9 and abs(capped["c"] - 60) < 1e-9
    assert of({"a": 0, None: 0}) == {"a": 0.0, None: 0.0}


def test_mix(spark, docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and mixing.mix(empty).count() == 0
    assert all(r.taken == r.copies * r.size and r.copies <= 3 and all(len([x for x in y.split(",") if x]) == r.copies for y in (r.shards, r.orders)) for r in rows)
    key = lambda r: (str(r.doc_id), r.size, r.copies, r.shards)
    assert sorted(map(key, rows)) == sorted(map(key, mixing.mix(docs.repartition(3)).collect()))
    whole = mixing.copies(docs, "n times").collect()
    assert sorted((str(r.doc_id), r["n times"]) for r in whole) == sorted((str(r.doc_id), r.copies) for r in rows)


@pytest.mark.parametrize("scale", ["0.001", "0.01"])
def test_mix_meets_targets(spark, sf, scale):
    sf = sf.replace("0.001", scale)
    got = QUERIES["op3_mix_sources"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source"), "doc_id")
    for r in got.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("goal"), F.max("size").alias("most"), F.first("source_size").alias("n")).collect():
        assert abs(r.t - r.goal) <= (r.most if scale == "0.001" else 0.01 * r.goal) and r.goal <= 3 * r.n + 1e-6
    depth = got.select(F.explode(F.split("shards", ",")).alias("s")).where("s <> ''").groupBy("s").count().collect()
    assert len(depth) <= 16


def test_shards(spark, docs, empty):
    rows = sharding.shard(docs, shards=5, row="all of it").collect()
    assert sorted(map(str, (r["all of it"] for r in rows))) == sorted(map(str, docs.collect()))
    narrow = sharding.shard(docs, shards=5).collect()
    assert sorted((str(r.doc_id), r.text_crc32, r.shard, r.slot) for r in narrow) == sorted((str(r.doc_id), r.text_crc32, r.shard, r.slot) for r in rows)
    assert len(rows) == docs.count() and sharding.shard(empty).count() == 0
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(5))
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        if r.doc_id is not None:
            raw = (text[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw)) and r.grown_shard is None


def test_shards_balance(spark, sf):
    big = spark.range(4000).select("id", F.concat(F.lit("t"), F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise(F.sha2(F.col("id").cast("string"), 256))).alias("text")).withColumnRenamed("id", "doc_id")
    total = sharding.shard(big).groupBy("shard").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    sizes = [r.b for r in total]
    assert len(total) == 40 and max(sizes) - min(sizes) <= 0.05 * sum(sizes) / 40


def test_shards_keep_groups(spark, monkeypatch):
    """Groups of up to half a shard stay whole; parts of units of any number give gapless slots."""
    monkeypatch.setattr(sharding, "PART", 16)
    rows = [(i, f"group {i % 30} " * 5 if i < 600 else f"text {i} " * (i % 9)) for i in range(4000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=10).collect()
    slots, text, homes = {}, dict(rows), {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        homes.setdefault(text[r.doc_id], set()).add(r.shard)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and len(got) == 4000
    assert all(len(x) == 1 for x in homes.values())
