"""The stages one by one, and the SQL of the queries that have some."""

import os
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tabulon.llm import quality, queries

from . import helpers as H

TABLES = ("documents", "labels", "benchmark")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_match_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf_dir)
    want = con.sql(queries.ORACLE_SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = sorted(repr(tuple(r[c] for c in columns)) for r in got.collect())
    assert rows == sorted(map(repr, con.sql(f"SELECT {', '.join(columns)} FROM want").fetchall()))


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        n = docs.count()
        if k < 4:
            assert docs.columns == columns, name
        if k < 3:
            assert 0 < n <= before and docs.dropDuplicates().count() == n, name
        before = n
    ends = docs.selectExpr("start + n_tokens AS e", "start").collect()
    assert sorted(r.start for r in ends)[1:] == sorted(r.e for r in ends)[:-1]


def test_token_stage_keeps_the_training_order(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = corpus_pipeline.source_mixing(spark, docs, sf_dir)
    mixed.repartitionByRange(7, F.monotonically_increasing_id()).write.parquet(f"{tmp_path}/mixed")
    files = sorted(f"{tmp_path}/mixed/{f}" for f in os.listdir(f"{tmp_path}/mixed") if f.startswith("part-"))
    want = [k for f in files for k in pq.read_table(f, columns=["doc_id"]).column(0).to_pylist()]
    got = corpus_pipeline.token_ids(spark, spark.read.parquet(f"{tmp_path}/mixed"), sf_dir).collect()
    assert len(files) == 7 and want != sorted(want)
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == want


def test_stages_keep_the_right_rows(spark, sf_dir, tmp_path):
    """Each stage's rows against brute force on that stage's own input."""
    steps = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]

    def after(name, docs):
        steps[name](spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name[:5]}")
        out = spark.read.parquet(f"{tmp_path}/{name[:5]}")
        return out, Counter(map(tuple, docs.collect())), Counter(map(tuple, out.collect()))

    id_, text = docs.columns.index("doc_id"), docs.columns.index("text")
    net = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out, rows, kept = after("quality classifier", docs)
    raw = [(r[text] or "").encode() for r in rows]
    # each document by itself; the score's last digits depend on the batch
    score = {r: float(net.forward(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[0]) for r, x in zip(rows, raw, strict=True)}
    sure = {r for r in rows if abs(score[r] - 0.3) > 1e-5}
    assert len(sure) > 0.9 * len(rows) and {r: n for r, n in kept.items() if r in sure} == {r: n for r, n in rows.items() if r in sure and score[r] >= 0.3}
    assert set(kept) <= set(rows)

    out, rows, kept = after("n-gram Jaccard join", out)
    every = list(rows.elements())
    least = {k for k, n, c in H.near([r[id_] for r in every], [r[text] for r in every]) if k == c or not n}
    assert kept == Counter(r for r in every if r[id_] in least) and kept != rows

    out, rows, kept = after("benchmark decontamination", out)
    every = list(rows.elements())
    hits = H.contamination([r[text] for r in every], [(str(k), t) for k, t in enumerate(names)], 10)
    assert kept == Counter(r for r, (_, hit, _) in zip(every, hits, strict=True) if not hit) and kept != rows

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/bench/*.parquet'")
    copies = dict(con.sql(f"SELECT doc_id, copies FROM ({queries.ORACLE_SQL['op7_mixing_sources']})").fetchall())
    out, rows, kept = after("mixing sources to target weights", out)
    assert kept == Counter({r: copies[r[id_]] * n for r, n in rows.items() if copies[r[id_]]})

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r, n in kept.items():
        ids = np.asarray([*tokenizer.encode(r[text] or "", add_special_tokens=False).ids, 1], "<u4")
        want[r[id_], len(ids), zlib.crc32(ids.tobytes())] += n
    got = steps["token-ID / binary output"](spark, out, sf_dir).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
