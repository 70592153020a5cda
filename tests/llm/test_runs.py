"""Periodic runs against all periods tried one by one."""

import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(x, least=6, times=4):
    """Every maximal stretch of each period; of equal stretches the smallest period."""
    n, found = len(x), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def one(x, least=6, times=4):
    return [tuple(r) for r in runs.runs(np.array(x, np.int64), np.array([len(x)]), least, times).tolist()]


@given(st.lists(st.integers(0, 2), max_size=70), st.integers(2, 5), st.integers(2, 9))
@settings(max_examples=400, deadline=None)
def test_any_sequence(x, times, least):
    assert one(x, least, times) == brute(x, least, times)


def test_texts_together_and_grids_in_parts(monkeypatch):
    r = random.Random(3)
    texts = []
    for _ in range(60):
        unit = [r.randrange(9) for _ in range(r.randrange(1, 9))]
        texts.append([r.randrange(9) for _ in range(r.randrange(30))] + unit * r.randrange(8) + unit[: r.randrange(len(unit))] + [7] * r.randrange(9))
    codes = np.array([100 * k + c for k, t in enumerate(texts) for c in t], np.int64)
    want, at = [], 0
    for t in texts:
        want += [(at + s, n, q) for s, n, q in brute(t)]
        at += len(t)
    for pairs in (1, 7, 1 << 20):
        monkeypatch.setattr(runs, "PAIRS", pairs)
        assert [tuple(x) for x in runs.runs(codes, np.array([len(t) for t in texts])).tolist()] == want


def test_hashes_that_deceive_are_found_out(monkeypatch):
    class Liar(runs.Hashes):
        def __init__(self, x, salt):
            super().__init__(x, salt)
            self.lies = salt < 2

        def agree(self, i, q, length):
            return super().agree(i, q, length) | (self.lies & (length % 3 == 0))

    x = [1, 2, 1, 2, 1, 2, 1, 2, 3, 4, 4, 4, 4, 4, 4, 5]
    monkeypatch.setattr(runs, "Hashes", Liar)
    assert one(x) == brute(x) == [(0, 8, 2), (9, 6, 1)]


def expected(doc_id, text):
    """What the query's contract asks, written down plainly."""
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    numbers = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *numbers, sha("".join(f"{s},{size},{q}\n" for s, size, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_against_brute_force(spark):
    r = random.Random(5)
    docs = [(0, None), (1, ""), (2, " \t\n"), (3, "a " * 7), (4, "ä b \x0bä b ä b\x1cä b " * 5), (5, "x" * 100_000)]
    for i in range(6, 150):
        unit = [r.choice("abcdef") for _ in range(r.randrange(1, 12))]
        docs.append((i, " ".join([*(r.choice("ghij") for _ in range(r.randrange(20))), *unit * r.randrange(9), *(r.choice("ghij") for _ in range(r.randrange(200)))])))
    docs += [docs[20]] * 2
    df = spark.createDataFrame([(*d, "kept", 1) for d in docs], "doc_id long, text string, runs string, n_words int")
    got = sorted(map(tuple, runs.digests(df).collect()), key=lambda t: t[0])
    assert got == sorted((expected(*d) for d in docs), key=lambda t: t[0])
    assert any(zlib.crc32(str(d[0]).encode()) % 10 == 0 for d in docs)
    made = runs.collapse_runs(df).filter("doc_id = 3").first()
    assert (made.runs_input, made.n_words_input, made.n_words, made.collapsed_text) == ("kept", 1, 7, "a")


def test_long_text_null_id_and_no_rows(spark):
    long = "tick tock " * 150_000
    df = spark.createDataFrame([(None, long), (None, "one two")], "doc_id long, text string")
    got = {r.n_runs: r for r in runs.digests(df).collect()}
    assert (got[1].start, got[1].length, got[1].period, got[1].exponent_milli) == (0, 300_000, 2, 150_000_000)
    assert got[0].start is None and got[0].collapsed_sha256 == hashlib.sha256(b"one two").hexdigest()
    assert runs.digests(df.limit(0)).count() == 0
