"""Joins of hot groups and similarity, against plain ones."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerbars.operators.scale import join_back, shared_folder
from ledgerbars.operators.similarity import similar


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_groups_meet_their_row(spark, how):
    rows = spark.createDataFrame([("hot", i) for i in range(300)] + [(f"k{i % 40}", 1000 + i) for i in range(200)] + [("none", 1)], "k string, i int")
    groups = rows.filter("k <> 'none'").groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("low"))
    got = join_back(rows, groups, ["k"], ["i"], "n", 501, parts=8, how=how)
    want = rows.join(groups, "k", how)
    assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_a_cluster_needs_a_shared_folder():
    session = lambda master, at=None: SimpleNamespace(conf=SimpleNamespace(get=lambda key, other=None: at), sparkContext=SimpleNamespace(master=master))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(session(master))
        assert shared_folder(session(master, "hdfs:///x")) == "hdfs:///x"
    assert shared_folder(session("local[8]"))


@pytest.mark.parametrize("block", [7, 4096])
def test_similar(spark, block):
    r = np.random.default_rng(2)
    x = np.repeat(r.normal(size=(6, 5)), 8, axis=0) + r.normal(size=(48, 5)) * 0.5
    rows = [(i, v, "x") for i, v in enumerate(x.tolist())] + [(100, None, "x"), (101, [0.0] * 5, "x"), (102, [float("nan")] * 5, "x"), (None, x[0].tolist(), "x")]
    d = spark.createDataFrame(rows, "id long, v array<double>, node string")
    u = np.concatenate([x, x[:1]])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = (u @ u.T) >= 0.75
    low = list(range(48)) + [48]
    while (now := [min(low[j] for j in np.flatnonzero(near[i])) for i in range(49)]) != low:
        low = now
    want = {(i if i < 48 else None): (int(near[i].sum()) - 1, low[i]) for i in range(49)} | {100: (0, 100), 101: (0, 101), 102: (0, 102)}
    assert {row.id: (row.n_links, row.cluster_id) for row in similar(d, "id", "v", 0.75, block).collect()} == want
    assert similar(d.limit(0), "id", "v", 0.75).collect() == []
