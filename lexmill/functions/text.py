"""Text functions as Column expressions. Only NFKC, which Spark lacks, runs in Python (Arrow batches)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Digit alphabets, marks to delete, affixes and their order, trimmed signs.
EASTERN, PERSIAN, WESTERN = "٠١٢٣٤٥٦٧٨٩", "۰۱۲۳۴۵۶۷۸۹", "0123456789"
DIACRITICS = "[\\u064B-\\u065F\\u0670\\u06D6-\\u06ED\\u0640]"
TATWEEL = "ـ"
PRIVATE_USE = "[\\uE000-\\uF8FF]"
GAZETTE_HEADER = "(?U)الجر\\s*\\S{0,5}\\s*[يی]دة\\s+الرسم[يی]ة[\\s\\S]{1,250}?سنة\\s*[\\d٠-٩۰-۹]+"
PAGE_NUMBER = "(?Um)^\\s*[\\d٠-٩۰-۹]{1,4}\\s*$"
PREFIXES = "^(?:ال|[وفبلك])(?=..)"
SUFFIXES = "(?<=..)(?:ين|ون|ها|هم|كم|ات|ان|ية|ه|ا|ي)$"
ARABIC_RUN = "[ء-ي]+"
SIGNS, TITLE_SIGNS = " :-–،.", " :-–،.()"
ARTICLE_PREFIXES = ("لل", "بال", "وال", "فال", "كال")
TATWEEL_PREFIX = "بـال"


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode NFKC; null stays null."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def western_digits(s: Column) -> Column:
    return F.translate(s, EASTERN + PERSIAN, WESTERN * 2)


def eastern_digits(s: Column) -> Column:
    return F.translate(s, WESTERN, EASTERN)


def strip_diacritics(s: Column) -> Column:
    return F.regexp_replace(s, DIACRITICS, "")


def strip_page_artifacts(s: Column) -> Column:
    """Without page headers, then without lines of a number only; before white space is flattened."""
    return F.regexp_replace(F.regexp_replace(s, GAZETTE_HEADER, " "), PAGE_NUMBER, "")


def strip_private_use(s: Column) -> Column:
    return F.regexp_replace(s, PRIVATE_USE, "")


def squeeze(s: Column) -> Column:
    """One space for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(s, "\\p{IsWhite_Space}+", " "))


def strip(s: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(s, "(?U)^\\s+|\\s+$", "")


def trim_signs(s: Column, signs: str) -> Column:
    return F.btrim(s, F.lit(signs))


def flatten(s: Column) -> Column:
    return squeeze(strip_private_use(s))


def for_display(s: Column) -> Column:
    """NFKC, no tatweel, flat; marks and digits stay."""
    return flatten(F.translate(nfkc(s), TATWEEL, ""))


def for_index(s: Column) -> Column:
    """NFKC, no marks, western digits, flat."""
    return flatten(western_digits(strip_diacritics(nfkc(s))))


def clean_page(s: Column) -> Column:
    return flatten(strip_page_artifacts(nfkc(s)))


def typed_int(s: Column) -> Column:
    """A number as a user types it, in logical order; null if it isn't all digits."""
    digits = F.trim(western_digits(s))
    return F.when(digits.rlike("^[0-9]+$"), digits.try_cast("int"))


def page_int(s: Column) -> Column:
    """A number as pages store it: several Eastern digits run backwards, Persian and western ones don't."""
    token = strip(s)
    forward = F.when(token.rlike(f"^[{EASTERN}]{{2,}}$"), F.reverse(token)).otherwise(token)
    return F.when(token.rlike(f"^[0-9{EASTERN}{PERSIAN}]+$"), western_digits(forward).try_cast("int"))


def digits_int(s: Column) -> Column:
    """``page_int`` of a token that is known to hold digits only, without patterns; null if they are of other alphabets."""
    forward = F.when(F.translate(s, EASTERN, "") == "", F.reverse(s)).otherwise(s)
    return western_digits(forward).try_cast("int")


#: What the classes of white space and digits of all alphabets hold, spelled out: patterns with them run quicker than with a flag.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def spelled(pattern: str) -> str:
    """A pattern with the flag (?U) as one without it; for patterns whose classes are white space and digits."""
    out: list[str] = []
    i, body = 0, pattern.removeprefix("(?U)")
    while i < len(body):
        two = body[i : i + 2]
        if two in ("\\s", "\\d"):
            out.append("\\p{IsWhite_Space}" if two == "\\s" else "\\p{Nd}")
            i += 2
            continue
        out.append(two if body[i] == "\\" else body[i])
        i += len(out[-1])
    return "".join(out)


def runs_of_digits(match: Column, others: str) -> Column:
    """The runs of digits in a string of digits, white space and the characters ``others``, in order.

    Empty runs are dropped before anything is cast: what can't be cast is slow, as the cast fails by an exception."""
    gone = SPACES + others
    return F.filter(F.split(F.translate(match, gone, " " * len(gone)), " "), lambda t: t != "")


def digits_ints(s: Column) -> Column:
    """``digits_int`` of each run of digits in a string, in order; digits that nothing turns round are cast as they stand."""
    runs = lambda x: F.regexp_extract_all(x, F.lit("\\p{Nd}+"), F.lit(0))
    plain = F.transform(runs(western_digits(s)), lambda t: t.try_cast("int"))
    return F.when(s.rlike(f"[{EASTERN}]"), F.transform(runs(s), digits_int)).otherwise(plain)


def estimate_tokens(s: Column) -> Column:
    return F.greatest(F.lit(1), F.rint(F.length(s) / F.lit(3.4)).cast("int"))


def stem(word: Column) -> Column:
    """Light stem: at most one prefix, then at most one suffix, two letters left each time."""
    return F.regexp_replace(F.regexp_replace(word, PREFIXES, ""), SUFFIXES, "")


def term_variants(term: Column, more: tuple[str, ...] = ()) -> Column:
    """Sorted surface forms of a term; ``more`` adds prefixes to those of the article."""
    bare = F.substring(term, 3, 1 << 20)
    forms = F.array(term, bare, *(F.concat(F.lit(p), bare) for p in (*ARTICLE_PREFIXES, *more)))
    return F.array_sort(F.array_distinct(F.when(term.startswith("ال"), forms).otherwise(F.array(term))))


def slug(term: Column, number: Column) -> Column:
    return F.when(number.isNotNull(), F.format_string("%03d", number)).otherwise(F.substring(F.regexp_replace(term, "(?U)\\s+", "-"), 1, 40))


def breadcrumb(book: Column, book_title: Column, part: Column, part_title: Column, chapter: Column, chapter_title: Column, article: Column, suffix: Column | None = None) -> Column:
    """The levels that are there, joined by arrows; the article always is."""

    def level(name: str, number: Column, title: Column) -> Column:
        named = F.concat(F.lit(f"{name} "), number.cast("string"), F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit(": "), title)).otherwise(F.lit("")))
        return F.when(number.isNotNull(), named)

    last = F.concat(F.lit("المادة ("), article.cast("string"), F.lit(")"), suffix if suffix is not None else F.lit(""))
    return F.concat_ws(" ← ", level("الكتاب", book, book_title), level("الباب", part, part_title), level("الفصل", chapter, chapter_title), last)


def breadcrumb_of(text: Column) -> Column:
    """What stands before the first empty line, if there is one."""
    return F.when(F.contains(text, F.lit("\n\n")), F.substring_index(text, "\n\n", 1)).otherwise(F.lit(""))


def arabic_tokens(s: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(s, F.lit(ARABIC_RUN), F.lit(0)))


def highlight(text: Column, question: Column, opening: str = "<mark>", closing: str = "</mark>") -> Column:
    """Wrap the question's words of over two letters, one word after the other, so later words may match earlier marks."""
    words = F.filter(F.split(F.regexp_replace(question, "(?U)[^\\w\\s]", ""), "(?U)\\s+"), lambda w: F.length(w) > 2)
    return F.aggregate(words, text, lambda acc, w: F.regexp_replace(acc, F.concat(F.lit("(?iu)("), w, F.lit(")")), F.lit(f"{opening}$1{closing}")))
