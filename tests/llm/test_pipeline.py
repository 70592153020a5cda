"""The pipeline's stages, each against what its operator or plain Python says about the stage's own input."""

import re

import corpus_pipeline as P
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexmill.llm import mixing, toxicity
from lexmill.session import cut, table

from test_texts import WORD, components_by_hand, shingles


@pytest.fixture(scope="module")
def steps(spark, small):
    out = [table(spark, small, "documents")]
    for _, stage in P.STAGES:
        out.append(cut(stage(spark, out[-1], small)))
    return out


def test_stages_keep_the_columns(steps):
    assert [n for n, _ in P.STAGES] == ["toxicity", "near copies", "repeated passages", "mixing", "encoding"]
    assert all(s.columns == steps[0].columns for s in steps[:-1])


def test_near_copies_go_and_one_of_each_group_stays(steps):
    before = {r.doc_id: r.text for r in steps[1].collect()}
    groups = components_by_hand({i: shingles(t, 5) for i, t in before.items()}, 80)
    assert {r.doc_id for r in steps[2].collect()} == {i for i, g in groups.items() if i == g}


def test_repeated_passages_are_cut(steps):
    before, after = {r.doc_id: r.text for r in steps[2].collect()}, {r.doc_id: r.text for r in steps[3].collect()}
    assert set(before) == set(after)
    seen = {}
    for i in sorted(before):
        w = WORD.findall(before[i] or "")
        gone = set()
        for s in range(len(w) - 19):
            if seen.setdefault(tuple(w[s : s + 20]), (i, s)) != (i, s):
                gone |= set(range(s, s + 20))
        assert after[i] == (" ".join(x for k, x in enumerate(w) if k not in gone) if gone else before[i])


def test_toxic_documents_go_and_no_others(spark, steps, small):
    scored = toxicity.toxicity(steps[0], table(spark, small, "labels"))
    assert {r.doc_id for r in steps[1].collect()} == {r.doc_id for r in scored.filter("score < 0.5").collect()}


def test_mixing_and_encoding(steps):
    mixed = sorted(r.doc_id for r in mixing.mix_sources(steps[3]).collect())
    assert sorted(r.doc_id for r in steps[4].collect()) == mixed
    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    known.no_truncation()
    texts = {r.doc_id: r.text for r in steps[4].collect()}
    for r in steps[5].collect():
        ids = known.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, np.frombuffer(bytes(r.ids), "<u4").tolist()) == (len(ids), ids)


def test_run_is_the_stages(spark, steps, small):
    key = lambda df: sorted((r.doc_id, bytes(r.ids)) for r in df.collect())
    assert key(P.run(spark, small)) == key(steps[-1])


LONG = " ".join(f"word{i}" for i in range(60))


def test_near_copies_are_judged_by_row(spark, docs):
    other = " ".join(f"other{i}" for i in range(60))
    rows = [(1, LONG, "s"), (5, LONG, "s"), (5, other, "t"), (5, other, "t"), (7, LONG + " more", "s"), (8, None, "s"), (8, "", "s"), (9, " ", "s"), (None, LONG, "s")]
    got = [(r.doc_id, r.text) for r in P.drop_near_copies(spark, docs(rows), "").collect()]
    assert sorted(x for x in got if x[0] not in (None, 8)) == [(1, LONG), (5, other), (9, " ")]
    assert sum(x[0] == 8 for x in got) == 1 and (None, LONG) in got
    assert P.drop_near_copies(spark, docs(rows).limit(0), "").count() == 0


def test_odd_rows_pass_through_every_stage(spark, docs, small):
    rows = docs([(1, LONG, "s"), (1, LONG + " x y z", "s"), (2, None, None), (3, "", "s"), (None, "a b", "s"), (4, " ".join([LONG] * 300), "t"), (5, "word " * 40, "t")])
    rows = rows.withColumns({"toxicity": F.lit("t"), "n_words": F.lit("n"), "mix_weight": F.lit("w"), "_tie": F.lit(1)})
    for start in (rows, rows.limit(0)):
        out = start
        for name, stage in P.STAGES:
            before, out = out, cut(stage(spark, out, small))
            if name != "encoding":
                assert out.columns == rows.columns
                assert {(r.toxicity, r.n_words, r.mix_weight, r["_tie"]) for r in out.collect()} <= {("t", "n", "w", 1)}
            else:
                assert out.count() == before.count()
        assert {None, 1, 2, 3, 5} <= {r.doc_id for r in out.collect()} or start is not rows
