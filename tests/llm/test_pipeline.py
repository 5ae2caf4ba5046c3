"""The pipeline's stages against their operators, one by one."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline as P
from lumenforge.llm import decontaminate, mixing, near_dedup, toxicity
from lumenforge.llm.common import mark
from lumenforge.llm.queries import QUERIES


@pytest.fixture(scope="module")
def tables(spark, sf, docs, tmp_path_factory):
    """The awkward documents beside real ones, as a folder of tables."""
    out = tmp_path_factory.mktemp("tables")
    real = spark.read.parquet(f"{sf}/documents.parquet")
    docs.unionByName(real, allowMissingColumns=True).write.parquet(f"{out}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{out}/{t}.parquet")
    return str(out)


def rows_of(df, names):
    return Counter(tuple(r[x] for x in names) for r in df.select(*names).collect())


def test_stages(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    names = docs.columns
    labels, benchmark = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("labels", "benchmark"))
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, tables)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        before, after = rows_of(docs, names), rows_of(out, [x for x in names if x in out.columns]) if k == 4 else rows_of(out, names)
        if k < 4:
            assert out.columns == names
        at = names.index("doc_id"), names.index("text")
        if name == "toxicity":
            bad = Counter((r.doc_id, r.score >= 0.7) for r in toxicity.toxicity(docs, labels).collect())
            assert sum(after.values()) == sum(v for (_, b), v in bad.items() if not b) and not after - before
        elif name == "minhash_near_dedup":
            texts = {(r.doc_id, r.m): r.text for r in docs.select("doc_id", "text", mark().alias("m")).collect()}
            gone = {(r.doc_id, texts[r.doc_id, r.mark]) for r in near_dedup.near_dedup(docs).collect() if not r.kept}
            want = {x for x in before if (x[at[0]], x[at[1]]) not in gone}
            assert set(after) == want and all(v == 1 for x, v in after.items() if x[at[0]] is not None)
        elif name == "decontamination":
            bad = {(r.doc_id, r.mark) for r in decontaminate.decontaminate(docs, benchmark).where("contaminated").collect()}
            assert bad and {(r.doc_id, r.m) for r in out.select("doc_id", mark().alias("m")).collect()}.isdisjoint(bad)
            assert sum(before.values()) - sum(after.values()) == len(bad)
        elif name == "mixing":
            copies = sum(r.copies for r in mixing.mix(docs).collect())
            assert sum(after.values()) == copies and set(after) <= set(before)
        else:
            assert out.count() == docs.count() and set(out.select("shard").distinct().toPandas()["shard"]) <= set(range(40))
        docs = out


def test_run_and_empty(spark, sf, tables, empty, tmp_path):
    assert P.run(spark, sf).count() > 0
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    assert {x.split("_")[0] for x in QUERIES} == {f"op{n}" for n in range(1, 11)}
