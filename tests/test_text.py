"""Text queries over whole tables, against plain versions."""

from __future__ import annotations

import re

import numpy as np

from ledgerbars import registry
from ledgerbars.plans.text import THEMES
from tests.compare import connect, spark_rows, sql_rows


def test_themes_in_every_language(spark, sf, tmp_path):
    odd = [(1, "Les amis", "fr"), (2, "élles", "fr"), (3, "lesé", None), (4, "les\u0301", "fr"), (5, "x_les les2", "en"), (6, "UND\nder", "de"), (7, None, "de"), (8, "that", None), (9, "the,", "es"), (10, "«des»", "fr"), (11, "", "en"), (12, "étheé the\n", "en")]
    spark.createDataFrame(odd, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    run = registry.queries()["theme_tagging"]
    assert {r.theme: r.n_docs for r in run(spark, str(tmp_path)).collect()} == {"plural": 2, "german": 1, "definite": 3}
    c = connect(sf)
    c.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert spark_rows(run(spark, str(tmp_path))) == sql_rows(c, registry.oracle_sql()["theme_tagging"])
    texts = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    want = {t: sum(bool(re.search(rf"\b({'|'.join(k)})\b", x, re.I)) for x in texts) for t, k in THEMES.items()}
    assert {r.theme: r.n_docs for r in run(spark, sf).collect()} == {t: n for t, n in want.items() if n}


def reach(ids, linked):
    """The smallest id that each can reach; ``linked`` is a symmetric matrix with a true diagonal."""
    low = list(ids)
    while (now := [min(low[j] for j in np.flatnonzero(row)) for row in linked]) != low:
        low = now
    return low


def test_cluster_pairs(spark, sf, tmp_path):
    r = np.random.default_rng(3)
    x = np.repeat(r.normal(size=(20, 16)), 10, axis=0) + r.normal(size=(200, 16)) * 0.6
    rows = [(i, v, i % 3 if i % 7 else None) for i, v in enumerate(x.astype(np.float32).tolist())]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    for at in (str(tmp_path), sf):
        e = spark.read.parquet(f"{at}/embeddings.parquet").select("vec_id", "embedding").collect()
        x = np.array([row.embedding for row in e], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T >= 0.75
        want = {row.vec_id: (int(n), c) for row, n, c in zip(e, near.sum(1) - 1, reach([row.vec_id for row in e], near), strict=True)}
        got = {row.vec_id: (row.n_links, row.cluster_id) for row in registry.queries()["cluster_pairs_075"](spark, at).collect()}
        assert got == want and (at == sf or sum(n for n, _ in want.values()) > 0)
