"""Components of links: what they leave on disk, and how many stages they take."""

import time

import numpy as np

from tessera.llm import graph


def shuffles(spark):
    """Shuffle files on disk."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in files.mkString("\n").split("\n") if "/shuffle_" in f}


def test_shuffle_files_go_with_each_table(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long").repartition(5)
    before = shuffles(spark)
    out = graph.components(links)
    until = time.time() + 20
    while (left := shuffles(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left and out.count() == 200


def test_stars_take_few_stages(spark):
    sc = spark.sparkContext
    links = spark.createDataFrame([(i, i % 3) for i in range(3, 300)], "a long, b long")
    sc.setJobGroup("stars", "stars")
    try:
        out = graph.components(links)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("stars") for s in tracker.getJobInfo(j).stageIds}
    ran = [s for s in stages if (info := tracker.getStageInfo(s)) and info.numCompletedTasks]
    assert 0 < len(ran) <= 5 and {(r.a, r.b) for r in out.collect()} == {(i, i % 3) for i in range(3, 300)}


def test_turns_without_coalesced_partitions(spark):
    rng = np.random.default_rng(5)
    path = [int(x) for x in rng.permutation(400)]
    links = list(zip(path, path[1:])) + [(1000 + i, b) for i in range(300) for b in (998, 999)]
    names = ["spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions"]
    was = [spark.conf.get(n) for n in names]
    try:
        for n, v in zip(names, ("false", "23")):
            spark.conf.set(n, v)
        for kind in ("long", "string"):
            as_kind = (lambda x: x) if kind == "long" else (lambda x: f"{x:05d}")
            rows = graph.components(spark.createDataFrame([(as_kind(a), as_kind(b)) for a, b in links], f"a {kind}, b {kind}")).collect()
            want = {i: 0 for i in range(1, 400)} | {i: 998 for i in range(999, 1300)}
            assert len(rows) == len(want) and {int(r.a): int(r.b) for r in rows} == want
    finally:
        for n, v in zip(names, was):
            spark.conf.set(n, v)
