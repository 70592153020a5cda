"""From flat text to numbered articles with their place in the hierarchy."""

from __future__ import annotations

import bisect
import heapq
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexmill.functions import spans
from lexmill.functions.text import TITLE_SIGNS, digits_int, spelled, squeeze, trim_signs
from lexmill.operators import scan

# Header patterns, level order, and ordinals in the order in which they are tried (so a bare second
# to sixth hides the compounds 12 to 16).
NOT_INSIDE = "(?<![اوفبلكم])"
ARTICLE = "(?U)م\\s?ا\\s?د\\s?ة\\s*[()]\\s*([\\d٠-٩۰-۹]*)\\s*[():.،]"
LEVELS = {"book": "الكتاب", "part": "الباب", "chapter": "الفصل"}
ORDINALS = (
    (1, "الأول\\b|الاول\\b|الأول\\s*ى\\b|الأولى\\b"),
    (2, "الثاني\\b|الثانى\\b|الثان\\s*[يى]\\b|الثانية\\b"),
    (3, "الثالث\\b|الثالثة\\b"),
    (4, "الرابع\\b|الرابعة\\b"),
    (5, "الخامس\\b|الخامسة\\b"),
    (6, "السادس\\b|السادسة\\b"),
    (7, "السابع\\b|السابعة\\b"),
    (8, "الثامن\\b|الثامنة\\b"),
    (9, "التاسع\\b|التاسعة\\b"),
    (10, "العاشر\\b|العاشرة\\b"),
    (11, "الحاد[يى]\\s*عشر\\b"),
    (12, "الثان[يى]\\s*عشر\\b"),
    (13, "الثالث\\s*عشر\\b"),
    (14, "الرابع\\s*عشر\\b"),
    (15, "الخامس\\s*عشر\\b"),
    (16, "السادس\\s*عشر\\b"),
)
PRIORITY = {"book": 0, "part": 1, "chapter": 2, "article": 3}
NEAR = 3
#: Characters of a range, and of the text behind it that its last header and title may need.
RANGE, BEHIND = 1 << 16, 1 << 10
#: Any header: an article with its number, or a level above it with an ordinal behind it; tried only at letters that begin one.
#: Ends of words alone keep the flag.
HEADER = spelled(f"(?=[ما]){NOT_INSIDE}(?:{ARTICLE.removeprefix('(?U)')}|({'|'.join(LEVELS.values())})\\s+({'|'.join(p for _, p in ORDINALS)}))").replace("\\b", "(?U:\\b)")


def ordinal(s: Column) -> Column:
    """number and length of the ordinal at the start of ``s``; number is null if there is none."""
    number = reduce(lambda rest, o: F.when(s.rlike(f"(?U)^(?:{o[1]})"), F.lit(o[0])).otherwise(rest), reversed(ORDINALS), F.lit(None).cast("int"))
    return F.struct(number.alias("number"), F.length(F.regexp_extract(s, "(?U)^(?:" + "|".join(p for _, p in ORDINALS) + ")", 0)).alias("length"))


def renumber(numbers: Column) -> Column:
    """Article numbers along a document: an unread one, or one far ahead, gives way to the sequence; one that is at
    most NEAR ahead, or further back, is taken."""
    step = lambda acc, c: F.when(c.between(1, acc["next"] + NEAR), c).otherwise(acc["next"])
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(numbers, start, lambda acc, c: F.struct((step(acc, c) + 1).alias("next"), F.concat(acc["out"], F.array(step(acc, c))).alias("out")), lambda acc: acc["out"])


class Renumbering:
    """What a stretch of read numbers does to the number expected next, as a function of that number.

    Numbers below ``free`` meet nothing that is near enough and only move on by ``moved``; above, each interval ends at one
    value. A read number takes all values in its reach together, so every row adds one value at most.
    """

    def __init__(self) -> None:
        self.free, self.moved = math.inf, 0
        self.values: list[tuple[float, list[int]]] = []  # a heap of (less the value, but for what all have moved), beginnings of intervals

    def push(self, read: int | None) -> None:
        taken: list[int] = []
        if read is not None and read >= 1:
            least = read - NEAR
            begin = max(1, least - self.moved)
            if begin < self.free:
                taken, self.free = [begin], begin
            while self.values and -self.values[0][0] + self.moved >= least:
                more = heapq.heappop(self.values)[1]
                taken, more = (taken, more) if len(taken) >= len(more) else (more, taken)
                taken += more
        self.moved += 1
        if taken:
            heapq.heappush(self.values, (-(read + 1 - self.moved), taken))

    def function(self) -> list:
        pieces = sorted((begin, int(-value) + self.moved) for value, begins in self.values for begin in begins)
        kept = [p for i, p in enumerate(pieces) if not i or pieces[i - 1][1] != p[1]]
        return [None if self.free == math.inf else self.free, self.moved, *zip(*kept, strict=True)] if kept else [None, self.moved, [], []]


def expected_after(function: list, expected: int) -> int:
    """The number expected after the rows of a ``Renumbering``."""
    free, moved, begins, values = function
    return expected + moved if free is None or expected < free else values[bisect.bisect_right(begins, expected) - 1]


class Places:
    """A machine for ``segmented``: resolved numbers, and the book, part and chapter in which each header stands.

    A state is the number expected, the three levels as (number, title), and the last header as (start, end, whether it is
    an article's). A function is a renumbering, the levels that were set or cleared, and the last header.
    """

    reads = ("level", "number", "title", "start", "end")
    adds = "owner long, owner_end long, of_article boolean, article_number int, " + ", ".join(f"{x}_number int, {x}_title string" for x in LEVELS)

    def start(self) -> list:
        return [1, [None, ""], [None, ""], [None, ""], None]

    class builder:  # noqa: N801
        def __init__(self) -> None:
            self.numbers, self.levels, self.last = Renumbering(), [None, None, None], None

        def push(self, row: tuple) -> None:
            level, number, title, start, end = row
            if level == "article":
                self.numbers.push(number)
            elif level is not None:
                i = PRIORITY[level]
                self.levels = self.levels[:i] + [[number, title]] + [[None, ""]] * (2 - i)
            if level is not None:
                self.last = [start, end, level == "article"]

        def function(self) -> list:
            return [self.numbers.function(), self.levels, self.last]

    def after(self, function: list, state: list) -> list:
        numbers, levels, last = function
        return [expected_after(numbers, state[0]), *(s if f is None else f for f, s in zip(levels, state[1:4], strict=True)), last or state[4]]

    def step(self, state: list, row: tuple) -> tuple[list, tuple]:
        level, number, title, start, end = row
        expected, *levels, last = state
        resolved = None
        if level == "article":
            resolved = number if number is not None and 1 <= number <= expected + NEAR else expected
            expected = resolved + 1
        elif level is not None:
            i = PRIORITY[level]
            levels = levels[:i] + [[number, title]] + [[None, ""]] * (2 - i)
        if level is not None:
            last = [start, end, level == "article"]
        return [expected, *levels, last], (*(last or (None, None, None)), resolved, *(x for pair in levels for x in pair))


def ranges(pages: DataFrame) -> DataFrame:
    """doc_id, range, begin and text: each document's pages, joined by one space, as stretches of RANGE characters with
    the character before them and BEHIND behind, which hold what its headers look at. ``begin`` is where text begins."""
    plain = pages.select("doc_id", "page_num", F.replace(F.coalesce("cleaned_text", F.lit("")), F.lit(spans.MARK), F.lit("")).alias("cleaned_text"))
    offsets = spans.page_offsets(plain, keep=["cleaned_text"])
    own = F.when(F.col("ps") > 0, F.concat(F.lit(" "), "cleaned_text")).otherwise(F.col("cleaned_text"))
    whole = offsets.select("doc_id", own.alias("t"), F.greatest(F.col("ps") - 1, F.lit(0)).cast("long").alias("ps"), F.col("pe").cast("long"))
    first, last = F.greatest(F.floor((F.col("ps") - BEHIND) / RANGE), F.lit(0)), F.floor(F.col("pe") / RANGE)
    cut_ = whole.filter("pe > ps").withColumn("range", F.explode(F.sequence(first, last)))
    lo, hi = F.greatest("ps", F.col("range") * RANGE - 1), F.least("pe", (F.col("range") + 1) * RANGE + BEHIND)
    pieces = cut_.withColumn("lo", lo).filter(F.col("lo") < hi).select("doc_id", "range", "lo", F.expr("t").substr((lo - F.col("ps") + 1).cast("int"), (hi - lo).cast("int")).alias("t"))
    ordered = F.array_sort(F.collect_list(F.struct("lo", "t")))
    out = pieces.groupBy("doc_id", "range").agg(F.min("lo").alias("begin"), F.concat_ws("", F.transform(ordered, lambda x: x["t"])).alias("text"))
    # no header may begin at the character before: what stands there in place of a header's first letter hides headers alike
    before = F.concat(F.translate(F.substring("text", 1, 1), "ما", "وو"), F.expr("substring(text, 2)"))
    return out.withColumn("text", F.when(F.col("begin") < F.col("range") * RANGE, before).otherwise(F.col("text")))


def pieces(pages: DataFrame, max_title: int) -> DataFrame:
    """doc_id, start, end, level, number and title of each header, and of what a range holds before its first (level is
    null), with ``body``: the text behind it in its range, and where that begins, ``at``."""
    # one pass marks each header, its number, its word and its ordinal; five parts a header follow what is before the first
    m = spans.MARK
    parts = F.split(F.regexp_replace("text", HEADER, f"{m}$1{m}$2{m}$3{m}$0{m}"), m)
    rows = ranges(pages).select("doc_id", "range", "begin", parts.alias("p"))
    names = ("read", "word", "ordinal", "head", "rest")
    nothing = F.struct(*(F.lit("").alias(n) for n in names[:-1]), F.get("p", F.lit(0)).alias("rest"))
    each = F.transform(F.sequence(F.lit(1), F.size("p") - 5, F.lit(5)), lambda i: F.struct(*(F.get(F.col("p"), i + k).alias(n) for k, n in enumerate(names))))
    listed = F.when(F.size("p") < 6, F.array(nothing)).otherwise(F.concat(F.array(nothing), each))
    rows = rows.select("doc_id", "range", "begin", F.posexplode(listed).alias("pos", "s")).select("doc_id", "range", "begin", "pos", "s.*")
    size = F.length("head") + F.length("rest")
    upto = F.sum(size).over(W.partitionBy("doc_id", "range").orderBy("pos")) - size  # placed by (doc_id, range) already
    rows = rows.withColumn("start", F.col("begin") + upto).withColumns({"lo": F.col("range") * RANGE, "hi": (F.col("range") + 1) * RANGE})
    rows = rows.filter((F.col("start") < F.col("hi")) & (F.col("start") + size > F.col("lo")))
    header = (F.col("pos") > 0) & (F.col("start") >= F.col("lo"))  # one that begins before is the range's before
    level = reduce(lambda rest, x: F.when(F.col("word") == x[1], F.lit(x[0])).otherwise(rest), LEVELS.items(), F.lit("article"))
    rows = rows.withColumn("level", F.when(header, level)).withColumn("end", F.col("start") + F.length("head"))
    above = F.col("level").isin(*LEVELS)
    number = F.when(above, ordinal(F.col("ordinal"))["number"]).when(F.col("level") == "article", digits_int(F.col("read")))
    title = F.substring(squeeze(F.substring_index(trim_signs(F.col("rest"), TITLE_SIGNS), "مادة", 1)), 1, max_title)
    at = F.greatest("end", "lo")
    left = F.greatest(F.least(F.col("end") + F.length("rest"), F.col("hi")) - at, F.lit(0))
    body = F.col("rest").substr((at - F.col("end") + 1).cast("int"), left.cast("int"))
    start = F.when(header, F.col("start")).otherwise(F.col("lo"))
    return rows.select("doc_id", start.alias("start"), F.col("end").cast("long").alias("end"), "level", number.alias("number"), F.when(above, title).alias("title"), at.cast("long").alias("at"), body.alias("body"))


def parse_pages(pages: DataFrame, max_title: int = 100, parts: int | None = None) -> DataFrame:
    """Articles of ``pages(doc_id, page_num, cleaned_text)``: number, body, hierarchy and character span in the document,
    which is its pages joined by one space.

    Every header ends what stands before it, also a level that a body only mentions. Headers are found in ranges of
    characters and resolved by a segmented scan, so no task holds a document; only an article has to fit a row. Null
    pages are empty; null documents are one; without pages there are no articles.
    """
    # a range's first piece and a header at its beginning start alike
    placed = scan.segmented(pieces(pages, max_title).withColumn("first", F.col("level").isNotNull().cast("int")), "doc_id", ["start", "first"], Places(), parts)
    own = placed.filter("of_article")
    skipped = F.greatest(F.col("owner_end") - F.col("at"), F.lit(0)).cast("int")  # a header may run into the next range
    text = F.expr("body").substr(skipped + 1, F.greatest(F.length("body") - skipped, F.lit(0)))
    levels = [f"{x}_{y}" for x in LEVELS for y in ("number", "title")]
    place = F.when(F.col("level") == "article", F.struct("article_number", *levels))
    last = F.greatest(F.col("at") + F.length("body"), F.col("owner_end"))
    whole = own.groupBy("doc_id", "owner").agg(F.first(place, True).alias("p"), F.array_sort(F.collect_list(F.struct("at", text.alias("t")))).alias("t"), F.max(last).cast("int").alias("char_end"))
    body = trim_signs(F.concat_ws("", F.transform("t", lambda x: x["t"])), TITLE_SIGNS)
    return whole.select("doc_id", "p.article_number", body.alias("body_text"), *(f"p.{c}" for c in levels), F.col("owner").cast("int").alias("char_start"), "char_end")


def parse(docs: DataFrame, max_title: int = 100) -> DataFrame:
    """Articles of ``docs(doc_id, text)``, as of documents of one page."""
    return parse_pages(docs.select("doc_id", F.lit(1).alias("page_num"), F.col("text").alias("cleaned_text")), max_title)
