"""Language profiles against a plain statement of the method, and held-out accuracy."""

import os
import zlib
from collections import Counter

import pytest

from lexmill.llm import langid

TABLES = "/root/testdata/sf0.01"
TEXTS = {
    "en": ["the house and the garden are where they were", "that thing is there with the others", "another day without weather"],
    "de": ["das Haus und der Garten sind schön", "Straße und Größe, nicht weit", "ich weiß nicht was er sagt"],
    "fr": ["la maison et le jardin où nous étions", "c'est une autre façon d'être", "les élèves ont été là"],
}


def by_hand(text, size=langid.PROFILE):
    """The profile of a text, as strings."""
    words = "".join(c if c.isalpha() else " " for c in (text or "").replace("Σ", "σ").lower()).split()
    # lower case may add marks, which are no letters
    counts = Counter()
    for w in words:
        padded = f"\x01{w}\x01"
        counts.update(padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1) if padded[i : i + n] != "\x01")
    number = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(reversed(g)))
    return sorted(counts, key=lambda g: (-counts[g], number(g)))[:size], counts


def distance(own, profile, size=langid.PROFILE):
    place = {g: i for i, g in enumerate(profile)}
    return sum(abs(place[g] - i) if g in place else size for i, g in enumerate(own))


def test_predictions_by_hand(spark):
    rows = [(i, t, lang, "x", "y") for i, (lang, t) in enumerate((lang, t) for lang, ts in TEXTS.items() for t in ts * 3)]
    odd = ["", None, "123 !?", "ñ", "the", "Σ ΣΑΣ", "x" * 50, "日本語の文", "the the weiß"]
    rows += [(100 + i, t, None, "x", "y") for i, t in enumerate(odd)] + [(100, "und", "fr", "x", "y"), (None, "the", "de", "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score string")
    learned = {}
    for i, t, lang, *_ in rows:
        if lang and i is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            learned.setdefault(lang, Counter()).update(by_hand(t)[1])
    number = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(reversed(g)))
    profiles = {k: sorted(c, key=lambda g: (-c[g], number(g)))[: langid.PROFILE] for k, c in learned.items()}
    want = []
    for i, t, *_ in rows:
        own = by_hand(t)[0]
        far, name = min(((distance(own, p), k) for k, p in profiles.items())) if own else (0, "und")
        held = True if i is None else zlib.crc32(str(i).encode()) % 3 == 1
        want.append((str(i), held, name, round(1 - far / (len(own) * langid.PROFILE), 12) if own else 0.0))
    got = [(str(r.doc_id), r.held_out, r.lang_pred, round(r.score, 12)) for r in langid.languages(df).collect()]
    assert sorted(got) == sorted(want)
    learned = langid.profiles(df.select("lang", "text"))
    assert langid.identify(df, learned).columns == ["doc_id", "text", "lang", "lang_pred_input", "score_input", "lang_pred", "score"]


def test_parts_of_languages_and_slices_change_nothing(spark, monkeypatch):
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, ts in TEXTS.items() for t in ts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = sorted(langid.identify(df, langid.profiles(df)).collect())
    assert [r.lang_pred for r in whole] == [r.lang for r in whole]
    monkeypatch.setattr(langid, "LANGUAGES", 1)
    assert sorted(langid.identify(df, langid.profiles(df)).collect()) == whole
    long = " ".join(t for ts in TEXTS.values() for t in ts) + " Σ123ΑΣ  " + "ß" * 40
    want = [x.tolist() for x in langid.counted(long)]
    for n in (1, 2, 3, 7, 50):
        monkeypatch.setattr(langid, "SLICE", n)
        assert [x.tolist() for x in langid.counted(long)] == want


def test_nothing_to_learn_from_and_no_rows(spark):
    df = spark.createDataFrame([(1, "words", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in langid.languages(df).collect()} == {("und", 0.0)}
    assert langid.languages(df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="tables are not there")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    got = langid.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out AND lang IS NOT NULL").collect()
    assert len(got) > 100 and sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
