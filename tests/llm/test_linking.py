import random

import numpy as np
import pytest
from parley.llm import line_dedup as ld
from parley.llm import linking
from parley.llm import near_dedup as nd
from pyspark.sql import functions as F

from .helpers import text
from .test_near_dedup import grouped


def families(seed, n=90):
    """Lines of which only members of one family are alike; some families are chains, and one has most members."""
    rng = random.Random(seed)
    lines = []
    for k in range(n):
        line = text(rng, "en", 12, 1)
        for _ in range(120 if k == 0 else rng.choice([1, 2, 2, 3, 4])):
            lines.append(line)
            at = rng.randrange(len(line))
            line = (lines[0] if k == 0 else line)[:at] + rng.choice("xyz") + (lines[0] if k == 0 else line)[at + 1 :]
    return sorted(set(lines))


def weighted():
    def features(line):
        hashes, count = np.unique(nd.Weights({}, 1.5).of(line.encode().split())[0], return_counts=True)
        return hashes, count * 1.5

    return features


@pytest.mark.parametrize(("rows", "features"), [(25, ld.features_of), (1024, weighted())])
def test_members_of_one_large_bucket_lose_no_link(spark, monkeypatch, rows, features):
    monkeypatch.setattr(linking, "BLOCK_ROWS", rows)
    lines = families(rows)
    made = [features(x) for x in lines]
    items = spark.createDataFrame(list(enumerate(lines)), "id long, text string")
    # All share one bucket, and some of them a second one.
    members = items.select(F.lit(1).cast("long").alias("bucket"), "id").unionByName(items.filter("id % 2 = 0").select(F.lit(2).cast("long").alias("bucket"), "id"))

    def compare(a, text_a, b, text_b):
        return [linking.similarity(features(x), features(y)) for x, y in zip(text_a, text_b)]

    links = linking.find_links(members, lambda ids: items.join(ids, "id"), compare, features, 0.8)
    links = [(r["a"], r["b"]) for r in links.collect()]
    assert all(linking.similarity(made[a], made[b]) >= 0.8 for a, b in links)
    pairs = [(i, j) for i in range(len(lines)) for j in range(i) if linking.similarity(made[i], made[j]) >= 0.8]
    want, got = grouped(pairs, range(len(lines))), grouped(links, range(len(lines)))
    together = {(want[i], got[i]) for i in range(len(lines))}
    assert len(together) == len(set(want.values())) == len(set(got.values())) > 60


def test_similarities_of_lines_are_exact():
    rng = random.Random(5)
    lines = ["a", "a\0", "aaaaaaaaaaaaaaa", "aaaaaaaaaa", "é😀x", *[text(rng, "de", n, 1) for n in (2, 9, 40, 300)], *families(3, 20)]
    pairs = [(rng.choice(lines), rng.choice(lines)) for _ in range(6000)] + [(x, x) for x in lines]
    a, b = (list(x) for x in zip(*pairs))
    want = [len(x & y) / len(x | y) for x, y in ((ld.shingles_of(x), ld.shingles_of(y)) for x, y in pairs)]
    assert ld.compare(list(range(len(a))), a, list(range(len(b))), b) == want
    assert [linking.similarity(ld.features_of(x), ld.features_of(y)) for x, y in pairs] == want
    assert ld.compare([], [], [], []) == []


def test_classes_by_few_tasks(spark):
    """Few edges stand in few parts, and a graph whose classes are stars takes no turn: the driver keeps account of each task."""
    rng = random.Random(14)
    graphs = {
        "stars": ([(k, k + i) for k in (0, 1000) for i in range(1, 200)], 60),
        "hub": ([(5000, i) for i in range(200)], 250),
        "random": ([(rng.randrange(200), rng.randrange(200)) for _ in range(150)], 1000),
        "none": ([(7, 7)], 60),
    }
    context, kept = spark.sparkContext, {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        for name, (links, most) in graphs.items():
            root = {x: x for a, b in links if a != b for x in (a, b)}
            for _ in root:
                for a, b in links:
                    if a != b:
                        root[a] = root[b] = min(root[a], root[b])
            context.setJobGroup(f"classes of {name}", name)
            made = linking.classes(spark.createDataFrame(links, "a long, b long").coalesce(2))
            told = context.statusTracker()
            stages = {s for j in told.getJobIdsForGroup(f"classes of {name}") for s in told.getJobInfo(j).stageIds}
            tasks = sum(x.numCompletedTasks for x in map(told.getStageInfo, stages) if x)
            got = [(r["id"], r["root"]) for r in made.collect()]
            assert len(got) == len(root) and dict(got) == root
            assert tasks <= most, (name, tasks)
    finally:
        context._jsc.clearJobGroup()
        for k, v in kept.items():
            spark.conf.set(k, v)
