"""Vector operators against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import vectors
from lexmill.session import table

SCHEMA = "vec_id long, embedding array<float>, label int, block string, score int"


@pytest.fixture(scope="module")
def odd(spark):
    r = np.random.default_rng(5)
    centres = r.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + r.normal(size=16) * (0.05 if i % 3 else 0.2)).astype(np.float32).tolist(), i % 2) for i in range(200)]
    rows += [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [None] * 16, 0), (904, [], 0), (905, rows[0][1], None), (906, [1.0, 2.0], 0), (908, [2.0, 4.0], 0), (907, [float("inf")] + [1.0] * 15, 1)]
    rows += [rows[3], rows[3]]
    return spark.createDataFrame([(*x, "x", 1) for x in rows], SCHEMA), rows


def good(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def test_near_duplicates(odd):
    df, rows = odd
    own = {i: (np.array(v, float), lab) for i, v, lab in rows if good(v) and lab is not None}
    parent, n = {i: i for i, *_ in rows}, dict.fromkeys((i for i, *_ in rows), 0)

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(own)
    for k, x in enumerate(ids):
        for y in ids[:k]:
            (a, la), (b, lb) = own[x], own[y]
            if la == lb and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93:
                n[x] += 1
                n[y] += 1
                p, q = sorted((top(x), top(y)))
                parent[q] = p
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect()}
    assert got == {i: (n[i], top(i), top(i) == i) for i in parent}
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_nearest_of_odd_rows(odd):
    df, rows = odd
    own = {i: np.array(v, float) for i, v, _ in rows if good(v)}
    got = {}
    for r in vectors.nearest(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {i for i in own if i % 100 == 0}
    hit = 0
    for q, found in got.items():
        want = sorted((float(np.sqrt(((own[q] - v) ** 2).sum())), i) for i, v in own.items() if i != q and len(v) == len(own[q]))[:10]
        found.sort()
        assert [k for k, *_ in found] == list(range(1, len(want) + 1))
        assert all(abs(s - np.sqrt(((own[q] - own[i]) ** 2).sum())) < 1e-12 for _, i, s in found)
        hit += len({i for _, i, _ in found} & {i for _, i in want})
    assert hit >= 0.9 * 10 * len(got)
    assert vectors.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01", "check_s"])
def test_recall(spark, sf):
    import os

    if not os.path.isdir(f"/root/testdata/{sf}"):
        pytest.skip("no such table here")
    df = table(spark, f"/root/testdata/{sf}", "embeddings")
    rows = [(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect() if good(r.embedding)]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    got = {}
    for r in vectors.nearest(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, d)) if i != q][:10]
        hit += len(got[int(ids[q])] & set(ids[order].tolist()))
        total += len(order)
    assert hit >= 0.9 * total


def clustered(n, seed):
    """Directions in 64 dimensions, a tenth of them near copies of others."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 64))
    x[-n // 10 :] = x[: n // 10] + r.normal(size=(n // 10, 64)) * 0.1
    return x


def of_table(sf):
    import os

    path = f"/root/testdata/{sf}/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no such table here")
    import pandas as pd

    return np.stack([np.asarray(v, float) for v in pd.read_parquet(path).embedding])


@pytest.mark.parametrize("vectors_of", [lambda: of_table("sf0.1"), lambda: clustered(50_000, 1)], ids=["sf0.1", "50000"])
def test_nearly_all_pairs_of_single_vectors_are_skipped(vectors_of):
    x = vectors_of()[:8000]
    axes = vectors.axes_of(x)
    eps = float(np.sqrt(2 - 2 * 0.93)) + vectors.SLACK
    order = np.lexsort(np.floor(vectors._unit(x) @ axes / eps).T[::-1])
    s = vectors.Sequence(np.arange(len(x)), x[order], axes)
    na, nb, _, full = vectors._join(s, s, 0.93, eps)
    u = vectors._unit(x[order])
    assert ((na + nb) == ((u @ u.T) >= 0.93).sum(axis=1) - 1).all()
    assert full < 0.02 * len(x) * (len(x) - 1) / 2


@pytest.mark.parametrize("vectors_of", [lambda: of_table("sf0.1"), lambda: clustered(50_000, 2)], ids=["sf0.1", "50000"])
def test_few_vectors_are_verified_at_high_recall(vectors_of):
    x = vectors_of()
    typical = vectors.scale_of(x[:1000])
    blocks = [vectors.Index(np.arange(a, min(a + 8192, len(x))), x[a : a + 8192]) for a in range(0, len(x), 8192)]
    queries, hit = range(0, len(x), max(100, len(x) // 25)), 0
    for q in queries:
        best = []
        for b in blocks:
            best = b.search(q, x[q], 10, typical, best)
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        hit += len({i for _, i in best} & set(np.argsort(d)[:10].tolist()))
    assert hit >= 0.9 * 10 * len(queries)
    assert sum(b.verified for b in blocks) < 0.1 * len(x) * len(queries)


def test_windows_over_bytes_count_what_lies_in_them():
    x = clustered(1000, 5)
    index = vectors.Index(np.arange(1000), x)
    assert index.places.dtype == np.uint8 and index.places.flags.c_contiguous  # lines of bytes, not sorted arrays of doubles
    places = index.low[:, None] + index.places * index.step  # within half a step of the true ones
    assert (np.abs(places - (x / index.scale @ index.lines).T) <= index.step * 0.501).all()
    for q, width in ((x[3], 0.3), (x[4] * 100, 0.5), (x[5] * 0, 1e9), (x[6], 0.0)):
        centre = q / index.scale @ index.lines
        got, more, fewer = index.hits(centre, width), *((np.abs(places - centre[:, None]) <= width + e * index.step).sum(axis=0) for e in (1e-6, -1e-6))
        assert (fewer <= got).all() and (got <= more).all()


def test_links_of_a_larger_table(spark):
    of_table("check_s")
    df = table(spark, "/root/testdata/check_s", "embeddings")
    rows = df.select("vec_id", "label", "embedding").toPandas()
    x = np.stack([np.asarray(v, float) for v in rows.embedding])
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(df).collect()}
    for label in rows.label.unique():
        at = np.flatnonzero(rows.label.to_numpy() == label)
        u = vectors._unit(x[at])
        assert [got[i] for i in rows.vec_id.to_numpy()[at].tolist()] == (((u @ u.T) >= 0.93).sum(axis=1) - 1).tolist()


@pytest.mark.parametrize("kind", ["double", "float", "boolean", "date", "decimal(10,2)", "binary", "string", "bigint", "struct<a:int>"])
def test_labels_of_any_type_and_rows_without_an_id(spark, kind):
    label = {"boolean": "x % 2 = 0", "date": "date_add(date'2020-01-01', x % 2)", "struct<a:int>": "named_struct('a', x % 2)", "binary": "binary(cast(x % 2 as string))"}.get(kind, f"cast(x % 2 as {kind})")
    df = spark.range(8).selectExpr("id AS vec_id", "cast(id / 4 AS int) AS x").selectExpr("vec_id", f"{label} AS label", "array(1.0D, 2.0D) AS embedding")
    df = df.union(df.filter("vec_id < 2").selectExpr("CAST(NULL AS long)", "label", "embedding"))
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect()), key=str)
    assert got == sorted([(i, 3, i // 4 * 4, i % 4 == 0) for i in range(8)] + [(None, 0, None, True)] * 2, key=str)
    assert {r.query_id for r in vectors.nearest(df, F.col("vec_id") == 3).collect()} == {3}
