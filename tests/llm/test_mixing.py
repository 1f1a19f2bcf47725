import re

import duckdb
from parley.llm import mixing
from parley.llm.sql import SQL

from .helpers import SCHEMA, corpus, mixed_rows


def test_targets_stop_at_three_sizes_and_share_the_rest(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 500), (None, 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes, (1, 2, 3), 3).collect()}
    # b is full at 30; the other 1,480 are dealt 1 : 3 to a and c; the empty source gets nothing
    assert got["b"] == 30 and got[None] == 0
    assert abs(got["a"] - 370) < 1e-6 and abs(got["c"] - 1110) < 1e-6


def test_mix_equals_sql_with_nulls_ties_and_repeated_rows(spark):
    docs = corpus(spark, mixed_rows())
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    names = ["doc_id", "size", "source_size", "target", "taken"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({SQL['op1_source_mixing']})").fetchall()
    got = [tuple(r) for r in mixing.mix(docs).select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken").collect()]
    key = lambda r: tuple((v is None, v) for v in r)
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a[:3] == b[:3] and a[4] == b[4] and abs(a[3] - b[3]) < 1e-6


def test_each_source_comes_near_its_target(spark):
    rows = mixed_rows(2, 400)
    got = mixing.mix(corpus(spark, rows)).select("source", "mix.*").collect()
    for source in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == source]
        longest = max(r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 2 * longest + 1
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    assert sum(r["size"] for r in got) == sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _, _ in rows)


def test_empty_and_clashing_columns(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = corpus(spark, mixed_rows(3, 5)).selectExpr("*", "1 AS size", "2 AS target", "3 AS turn", "4 AS mix")
    out = mixing.mix(docs)
    assert out.columns == [*docs.columns[:-1], "mix"] and out.count() == docs.count()
