"""Stages that know whether they are stale, histories of sessions, and edges in blocks."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lexmill.config import CorpusConfig
from lexmill.operators import adjacency, retrieval
from lexmill.plans import stages
from lexmill.plans.index import build_index, read_index
from lexmill.providers import HashEmbedding
from lexmill.streaming import history

EVENT = "session long, at timestamp, seq long, kind string, body string"


def test_a_stage_runs_when_it_is_stale_and_its_tables_change_at_once(spark, tmp_path):
    at = stages.Stages(spark, str(tmp_path))
    rows = spark.range(10)

    def double():
        return {"doubled": rows.selectExpr("id * 2 AS id"), "all": rows}

    with pytest.raises(FileNotFoundError):
        at.read("double")
    mark = stages.of_rows(rows)
    assert mark == stages.of_rows(spark.range(10).repartition(5)) != stages.of_rows(spark.range(11))
    assert mark != stages.of_rows(spark.range(10).union(spark.range(1))) and stages.of_rows(rows.limit(0))
    assert at.run("double", double, [mark])
    assert not at.run("double", double, [mark])
    assert at.run("double", double, [mark], settings={"x": 1})
    assert not at.run("double", double, [mark], settings={"x": 1})
    first = at.read("double")
    print_before = at.fingerprint("double")

    def halved():
        return {"doubled": rows.selectExpr("id DIV 2 AS id"), "all": rows.selectExpr("raise_error('killed') AS id")}

    with pytest.raises(Exception, match="killed"):
        at.run("double", halved, [mark])
    # the first table was written, the second wasn't: nothing of either is seen
    assert at.fingerprint("double") == print_before
    assert sorted(r.id for r in at.read("double")["doubled"].collect()) == list(range(0, 20, 2))

    rest = rows.selectExpr("id + 1 AS id")

    def moved():
        return {"doubled": rest}

    for i in range(3):
        assert at.run("double", moved, [mark], settings=i)
    assert list(at.read("double")) == ["doubled"] and at.read("double")["doubled"].count() == 10
    with pytest.raises(Exception):
        first["doubled"].count()  # three runs ago
    assert len(at._records("double")) == stages.KEPT
    (tmp_path / "double" / "_records" / "999999999999-x.json").write_text("{half a rec")
    assert at.fingerprint("double") is not None and not at.run("double", moved, [mark], settings=2)


def events_of(seed, n=400, sessions=5):
    draw = random.Random(seed)
    at, out = datetime(2024, 1, 1), []
    for i in range(n):
        at += timedelta(seconds=draw.choice([0, 1, 30, 30, 400]))
        s = draw.choice([1, 1, 1, 1, *range(2, sessions), None])
        out.append((s, at, i, draw.choice(["ask", "ask", "ask", "clear", None]), f"b{i}"))
    return out


def by_hand(events, idle):
    out, state = {}, {}
    for s, at, seq, kind, _ in sorted(events, key=lambda e: (e[1], e[2])):
        before, began, turn = state.get(s, (None, None, 0))
        if before is not None and (at - before).total_seconds() > idle:
            turn = 0
        if kind == "clear":
            began, turn, told = None, 0, (None, 0)
        else:
            began = (at, seq) if turn == 0 else began
            turn += 1
            told = (began, turn)
        state[s] = (at, began, turn)
        out[s, seq] = told
    return out


def told(rows):
    return {(r.session, r.seq): (None if r.began_at is None else (r.began_at, r.began_seq), r.turn) for r in rows}


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_histories_of_a_batch(spark, parts):
    events = events_of(parts)
    df = spark.createDataFrame(events, EVENT)
    out = history.replay(df, 500, parts)
    expected = by_hand(events, 500)
    assert told(out.collect()) == expected and out.columns[:5] == df.columns
    last = {}
    for (s, seq), t in sorted(expected.items(), key=lambda x: x[0][1]):
        last[s] = t
    got = {r.session: (None if r.began_at is None else (r.began_at, r.began_seq), r.turns) for r in history.shown(out).collect()}
    assert got == last


def test_histories_without_times_numbers_or_rows(spark):
    rows = [(1, None, None, "ask", None), (1, datetime(1970, 1, 1), 1, None, "x"), (1, datetime(1970, 1, 1), 2, "clear", "x")]
    out = {r.seq: r for r in history.replay(spark.createDataFrame(rows, EVENT), 10).collect()}
    assert [(out[s].turn, out[s].began_seq) for s in (None, 1, 2)] == [(1, None), (2, None), (0, None)]
    assert history.replay(spark.createDataFrame([], EVENT), 10).count() == 0


def test_a_stream_with_restarts_gives_the_histories_of_a_batch(spark, tmp_path):
    events = events_of(3, 90)
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(3):  # each round is a run of its own, which takes up the state of the one before
        spark.createDataFrame(events[30 * i : 30 * i + 30], EVENT).coalesce(1).write.mode("append").parquet(source)
        stream = history.stream(spark.readStream.schema(EVENT).parquet(source), 500)
        query = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert not query.isActive and query.exception() is None
    rows = spark.read.parquet(sink).collect()
    assert len(rows) == 90 and told(rows) == by_hand(events, 500)
    assert {(r.seq, r.body, r["at"]) for r in rows} == {(e[2], e[4], e[1]) for e in events}


@pytest.mark.parametrize(("block", "per_seed", "cap"), [(4, 3, 10), (4, 9, 10), (2, 50, 20), (8, 5, None), (64, 200, 100)])
def test_a_hop_over_blocks_is_the_hop_over_edges(spark, block, per_seed, cap):
    draw = random.Random(block)
    pairs = [(0, draw.randrange(400)) for _ in range(300)] + [(draw.randrange(40), draw.randrange(60)) for _ in range(300)] + [(None, 1), (3, None)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    seeds = spark.createDataFrame([(q, n) for q in range(12) for n in sorted(draw.sample(range(60), draw.randrange(1, 30)))] + [(None, 0), (5, None)], "qid long, node_id long")
    lists = adjacency.build(edges, block, parts=9)
    assert all(len(r.targets) <= block for t in lists.values() for r in t.collect())
    got = sorted(map(str, adjacency.hop(seeds, lists, per_seed, cap, block).collect()))
    assert got == sorted(map(str, retrieval.hop(seeds, edges.filter("dst IS NOT NULL"), per_seed, cap).collect())) and got


def test_a_hub_is_not_exploded(spark):
    edges = spark.range(20_000).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    lists = {k: v.cache() for k, v in adjacency.build(edges, parts=8).items()}
    seeds = spark.createDataFrame([(q, 0) for q in range(50)], "qid long, node_id long")
    taken = adjacency.owed(seeds, lists["first"], 3)
    assert taken.count() == 50 and {r.take for r in taken.collect()} == {3}
    assert lists["rest"].count() == -(-20_000 // adjacency.BLOCK) - 1
    assert adjacency.hop(seeds, lists, 3).count() == 150
    assert adjacency.build(edges.limit(0))["first"].count() == 0


def test_an_index_is_built_again_from_where_it_is_stale(spark, tmp_path):
    text = "الباب الأول تعريفات مادة (1): يقصد بالآتي 1- العامل: كل شخص يعمل. 2- الأجر: ما يعطى مادة (2): يسري هذا على العامل وفق المادة (1) من هذا القانون."
    pages = spark.createDataFrame([(d, 1, text, text) for d in (1, 2)], "doc_id long, page_num int, raw_text string, cleaned_text string")
    config, path, asked = CorpusConfig("XX"), str(tmp_path), spark.sparkContext.accumulator(0)

    def provider(texts):
        asked.add(len(texts))
        return HashEmbedding()(texts)

    assert build_index(pages, path, config, provider) == {"chunk": True, "embed": True, "graph": True}
    sent = asked.value
    before = {k: v.count() for k, v in read_index(spark, path).items()}
    assert before["Article"] == 4 and before["Definition"] == 4 and before["edges"] > 0 and sent > 0
    assert build_index(pages.repartition(3), path, config, provider) == {"chunk": False, "embed": False, "graph": False}
    more = pages.union(pages.limit(1).withColumn("doc_id", F.lit(3).cast("long")))
    assert build_index(more, path, config, provider) == {"chunk": True, "embed": True, "graph": True}
    assert read_index(spark, path)["Article"].count() == 6 and asked.value == sent  # its texts are known already
    assert build_index(more, path, config, provider, model="other") == {"chunk": False, "embed": True, "graph": True}
    assert asked.value == 2 * sent
