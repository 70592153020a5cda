"""Hard negatives against a plain loop over all rows."""

import math
import random

import duckdb
from pyspark.sql import functions as F

from lexmill.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, slot int"


def brute(rows, k=10, n=5, low=30, high=90):
    rows = [(i, [math.floor(256 * x) for x in v], c) for i, v, c in rows if None not in (i, v, c) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (a, q, c) in enumerate(rows):
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, d) for j, (i, v, d) in enumerate(rows) if j != at and len(v) == len(q))
        for p, pid, _ in [s for s in scored if s[2] == c][:n]:
            within = [s for s in scored if s[2] != c and low * -p <= 100 * -s[0] <= high * -p][:k]
            out += [(a, pid, r, i, -p, -s) for r, (s, i, _) in enumerate(within, 1)]
    return sorted(out)


def rows_of(seed, n, dim, labels):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    return [(i, [round(x + r.gauss(0, 0.8), 2) for x in centres[r.randrange(4)]], r.choice(labels)) for i in range(n)]


def mined(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, **kw).collect())


def as_stored(rows):
    import numpy as np

    return [(i, v if v is None else [None if x is None else float(np.float32(x)) for x in v], c) for i, v, c in rows]


def test_against_all_rows(spark):
    rows = rows_of(1, 500, 6, [1, 1, 1, 2, 3, None])
    rows += [(600, None, 1), (700, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (800, [float("inf")] * 6, 1), (900, [0.0] * 6, 2), (1000, [1.0, 2.0], 1), (1001, [1.0, 2.5], 1), (1002, [0.5, 1.0], 2), (None, [1.0] * 6, 1), (1100, [], 1)]
    rows += [(300, rows[300][1], 1), (301, rows[301][1], 2)] * 2 + [(100, rows[100][1], None)]  # rows that repeat an id
    assert mined(spark, rows) == brute(as_stored(rows))


def test_several_runs_give_what_one_does(spark, monkeypatch):
    rows = rows_of(2, 700, 4, [1, 2])
    whole = brute(as_stored(rows))
    monkeypatch.setattr(negatives, "RUN_BYTES", 100 * 32)
    monkeypatch.setattr(negatives, "LEAST_RUN", 10)
    monkeypatch.setattr(negatives, "BLOCK", 17)
    assert mined(spark, rows) == whole and len(whole) > 100


def test_ties_limits_and_large_scores(spark):
    same = [(i, [1.0, 1.0], i % 3) for i in range(0, 400, 4)]
    low = [(1000 + i, [x, 0.0], 9) for i, x in enumerate((0.6, 0.59, 1.8, 1.81, -1.0))]
    large = [(2000 + 100 * i, [2.0**20 + i, -(2.0**20)], i % 2) for i in range(12)]
    for rows in (same + low, large):
        got = mined(spark, rows)
        assert got == brute(as_stored(rows)) and (got or rows is large)
    assert mined(spark, same, k=3, positives=2, share=(10, 100)) == brute(as_stored(same), 3, 2, 10, 100)


def test_no_rows(spark):
    assert mined(spark, []) == [] and mined(spark, [(100, [1.0], 1)]) == []


def test_sql_says_the_same(spark, tmp_path):
    from lexmill.llm.queries import QUERIES

    rows = rows_of(3, 300, 5, list(range(10)))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(map(tuple, QUERIES["op11_negatives"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    moved = [(i, v, (c + 1) % 10 if i % 7 == 0 else c) for i, v, c in as_stored(rows)]
    assert got == sorted(con.sql(negatives.SQL).fetchall()) == brute(moved)
