"""The pipeline, stage by stage against plain versions; the queries against their SQL."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from ledgerbars.llm import queries
from ledgerbars.llm.mixing import mix
from tests.compare import connect, spark_rows, sql_rows
from tests.llm import brute


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, sf, name):
    assert spark_rows(queries.queries()[name](spark, sf)) == sql_rows(connect(sf), queries.oracle_sql()[name])


def test_names():
    numbers = [int(n[2:].split("_")[0]) for n in queries.queries()]
    assert sorted(numbers) == list(range(1, 11))


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(k)))
        before, after = docs.collect(), spark.read.parquet(str(tmp_path / str(k))).collect()
        if k < 4:
            assert out.columns == columns
        if name == "language_id":
            assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before if any(map(str.isalpha, r.text or "")))
        elif name == "exact_dedup":
            assert {r.doc_id for r in after} == {keep for _, keep, _, _ in brute.exact([(r.doc_id, r.text) for r in before]).values()} and len({brute.SPACE.sub("", r.text) for r in after}) == len(after)
        elif name == "simhash_dedup":
            ids = sorted((r.doc_id, brute.fingerprint(r.text)) for r in before)
            x = np.array([f for _, f in ids], np.uint64)
            assert {r.doc_id for r in after} == set(brute.reach([d for d, _ in ids], np.bitwise_count(x[:, None] ^ x[None, :]) <= 3)) and len(after) == len({r.doc_id for r in after})
        elif name == "mixing":
            words = Counter()
            whole = {r.doc_id: Counter(brute.WORD.findall(r.text)) for r in before}
            for r in after:
                w = Counter(brute.WORD.findall(r.text))
                assert not w - whole[r.doc_id]
                words[r.doc_id] += w.total()
            assert words == Counter({r.doc_id: r.taken for r in mix(docs).collect() if r.taken})
        else:
            assert all(r.decoded == r.text and len(r.ids) == r.n_tokens for r in after) and len(after) == len(before)
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


def test_empty_documents(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
