"""Every query against its SQL, or at least its schema and rows."""

from __future__ import annotations

import math
import os
import re

import duckdb
import pytest

from lumenforge.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    if name not in ORACLES:
        assert rows
        return
    found = duck.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    names = sorted(columns)
    mine = sorted(tuple(norm(r[x]) for x in names) for r in rows)
    theirs = sorted(tuple(norm(r[columns.index(x)]) for x in names) for r in found.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", ["chat_render_vl", "chat_render_thinking", "chat_validate", "last_query_index", "request_counts", "preflight_limits", "tool_run_edges"])
def test_long_conversations(spark, tmp_path, name):
    """Conversations of many more turns than a request may have, against the query's SQL. A role out of the closed set is for the check alone: it refuses such requests, so no template gets them."""
    turns = [(c, k, "user" if k % 2 == 0 and k < 900 else "narrator" if name == "chat_validate" and (c, k) == (6, 701) else "assistant", f" turn {k} ") for c in (1, 3, 6) for k in range(1000)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    found = c.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    mine = QUERIES[name](spark, str(tmp_path)).collect()
    assert sorted(tuple(norm(r[x]) for x in columns) for r in mine) == sorted(tuple(norm(x) for x in r) for r in found.fetchall())


@pytest.mark.parametrize("name", ["order_faults", "occurrence_offsets", "server_fields", "first_use_slots", "inline_inputs"])
def test_partitions_follow_the_table(spark, sf, name, monkeypatch):
    """Rows of batches are dealt once, to more partitions the longer the table is: a task's sorts don't grow with it."""
    from lumenforge import queries

    monkeypatch.setattr(queries, "PART", 1 << 13, raising=False)
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    counts = [int(n) for n in re.findall(r"Exchange hashpartitioning\(.*, (\d+)\)", plan)]
    assert len(counts) == 1 and counts[0] >= os.path.getsize(f"{sf}/lineitem.parquet") >> 13


def test_partitions_follow_the_pictures(spark, sf, monkeypatch):
    """Pictures are dealt to more partitions the more bytes they have, so a worker's batches stay as small."""
    from lumenforge import queries
    from lumenforge.queries.media import picture_requests

    monkeypatch.setattr(queries, "PICTURES", 1 << 13, raising=False)
    assert picture_requests(spark, sf).rdd.getNumPartitions() > 2 * spark.sparkContext.defaultParallelism
