"""Vector operators and components against brute force."""

import random

import numpy as np

from lathe.llm import ann, embedding_dedup
from lathe.llm._common import Scratch
from lathe.llm.components import connected_components
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int"
NAN = float("nan")
ODD = [(None, [1.0, 0.0], 1), (9001, None, 1), (9002, [0.0, 0.0], 1), (9003, [NAN, 1.0], 1), (9004, [None, 1.0], 1), (9005, [float("inf"), 1.0], 1), (9006, [1.0], 1), (9007, [1.0] * 16, None), (9008, [], 1)]


def vectors(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS n", "1 AS list", "2 AS component_id")


def cluster(seed, n=150, dim=16):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        base = rng.standard_normal(dim)
        for _ in range(int(rng.integers(1, 5))):
            v = base + rng.standard_normal(dim) * rng.choice([0, 0.02, 0.1])
            rows.append((len(rows) * 2, [float(np.float32(x)) for x in v], int(rng.integers(0, 2))))
    return rows


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 400)] + [(rng.randrange(500, 600), rng.randrange(500, 600)) for _ in range(60)] + [(7, 7), (None, 3)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    root = {x: x for e in edges for x in e if x is not None}
    for _ in range(700):
        for a, b in edges:
            if a is not None:
                root[a] = root[b] = min(root[a], root[b])
    assert got == {k: v for k, v in root.items() if k in got} and {k for e in edges[:-2] for k in e if e[0] != e[1]} == set(got)
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def brute_links(rows, threshold=0.93):
    ids = [r[0] for r in rows]
    x = np.array([r[1] for r in rows])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.array([r[2] for r in rows])
    m = (x @ x.T >= threshold) & (lab[:, None] == lab)
    np.fill_diagonal(m, False)
    root = np.arange(len(ids))
    for _ in range(len(ids)):
        new = np.array([min([root[i], *root[m[i]]]) for i in range(len(ids))])
        if (new == root).all():
            break
        root = new
    return {ids[i]: (int(m[i].sum()), ids[root[i]]) for i in range(len(ids))}


def test_near_duplicates_match_brute_force(spark):
    rows = cluster(3)
    for block in (512, 3):
        got = embedding_dedup.near_duplicates(vectors(spark, rows), Scratch(spark, "t"), recall=0.9999, block=block).collect()
        assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute_links(rows)
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_near_duplicates_odd_rows(spark):
    rows = [*ODD, (1, [1.0, 2.0], 1), (2, [2.0, 4.0], 1), (3, [1.0, 2.0], 2), (1, [1.0, 2.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(vectors(spark, rows), Scratch(spark, "t")).collect()}
    assert got[1] == (1, 1, True) and got[2] == (1, 1, False) and got[3] == (0, 3, True) and got[None] == (0, None, True)
    assert all(got[i] == (0, i, True) for i in range(9001, 9009))
    assert embedding_dedup.near_duplicates(vectors(spark, []), Scratch(spark, "t")).count() == 0


def test_nearest_recall(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(16)], 1) for i in range(3000)]
    got = ann.search(spark, vectors(spark, rows), F.col("vec_id") % 50 == 0, Scratch(spark, "t"), ann.Settings(block=700)).collect()
    x = np.array([r[1] for r in rows])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 3000, 50):
        s = u @ u[q]
        s[q] = -2
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == [1, 2, 3, 4, 5]
        assert all(abs(r.score - s[r.vec_id]) < 1e-12 for r in own)
        hits += len({r.vec_id for r in own} & set(np.argsort(-s)[:5].tolist()))
    assert hits / 300 >= 0.9


def test_nearest_odd_rows_and_ties(spark):
    rows = [*ODD, (0, [1.0, 0.0], 1), (4, [2.0, 0.0], 1), (3, [3.0, 0.0], 1), (8, [0.0, 1.0], 1), (8, [0.0, 1.0], 1)]
    got = ann.search(spark, vectors(spark, rows), F.col("vec_id") % 50 == 0, Scratch(spark, "t")).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(0, 1, 3, 1.0), (0, 2, 4, 1.0), (0, 3, 8, 0.0)]
    assert ann.search(spark, vectors(spark, []), F.col("vec_id") % 50 == 0, Scratch(spark, "t")).count() == 0


def test_nearest_copies_over_several_blocks(spark):
    # Copies in many blocks of one list: whichever block comes first, the smaller ids are the nearest.
    rng = np.random.default_rng(8)
    group = [[float(np.float32(x)) for x in rng.standard_normal(64)] for _ in range(6)]
    rows = [(i, group[i % 6], 1) for i in range(600)]
    rows += [(i, [float(np.float32(x)) for x in rng.standard_normal(64)], 1) for i in range(600, 900)]
    got = ann.search(spark, vectors(spark, rows).repartition(3), (F.col("vec_id") % 50 == 0) & (F.col("vec_id") < 600), Scratch(spark, "t"), ann.Settings(block=20, max_lists=1)).collect()
    for q in range(0, 600, 50):
        own = [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)]
        assert own == [i for i in range(q % 6, 600, 6) if i != q][:5]


def test_scan_keeps_copies_at_the_limit():
    rng = np.random.default_rng(9)
    v = ann.unit(rng.standard_normal((200, 64)))
    for x in v:
        for limit in (0.0, 5.0):
            assert len(ann.scan(x, np.tile(x, (40, 1)) * (1 + 1e-16 * rng.integers(-3, 4, (40, 1))), limit, 6, ann.Settings())) == 40
