"""BPE encoding and decoding by a dynamic program over prefixes.

For each prefix of a word exactly one token can end its encoding: the token t that matches there (an automaton over
the vocabulary lists all matches, longest first) and is compatible with the last token of the prefix before t.
Two tokens are compatible if merging their joined bytes never crosses the boundary between them. The table keeps
that one token per prefix; following it back from the end gives the identifiers, in time linear in the word. As
exactly one token fits, a prefix that no longer match fits ends in the token of its last byte, for which nothing is asked.

The vocabulary file is read once by the driver; its tables (bounded by the vocabulary) are broadcast.

Defined cases: null texts are empty; empty texts have no identifiers; added tokens inside a text are found first,
as the file says; very long texts are worked off in pieces cut before white space; repeated rows, other columns and
empty tables need nothing special.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lexmill.llm.common import lean

# Letters and numbers that Unicode has only since 17.0 or that the vocabulary's own pattern
# engine (16.0) doesn't know; it takes them as signs.
NEW_LETTERS = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a"
    "\U00011db0-\U00011ddb\U00011df1\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff3\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191"
    "\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2"
    "\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
NEW_NUMBERS = "\U00011de0-\U00011de9\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ff4-\U00016ff6"
# The byte-level pattern of words, with the sets of letters and numbers left open.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^\s{l}{n}]+|\s+(?!\S)|\s+"
PLAIN = regex.compile(WORDS.replace("{L}", r"\p{L}").replace("{N}", r"\p{N}").replace("{l}", r"\p{L}").replace("{n}", r"\p{N}"))
NEW = regex.compile(f"[{NEW_LETTERS}{NEW_NUMBERS}]")
L, N = rf"[\p{{L}}--[{NEW_LETTERS}]]", rf"[\p{{N}}--[{NEW_NUMBERS}]]"
CAREFUL = regex.compile(WORDS.replace("{L}", L).replace("{N}", N).replace("{l}", L).replace("{n}", N), regex.V1)


def _spelled(pattern: str) -> str:
    """The characters up to U+024F that a pattern matches, to stand in a set."""
    return "".join(f"\\u{i:04x}" for i in range(0x250) if regex.match(pattern, chr(i)))


# Up to U+024F, and with the signs of U+2010 to U+2027, words are found by Python's own engine, which runs sets that are spelled out faster.
OTHER = re.compile("[^\\u0000-\\u024f\\u2010-\\u2027]")
LATIN = re.compile(WORDS.replace("{L}", "[{l}]").replace("{N}", "[{n}]").replace("^\\s", "^{s}").replace("\\s", "[{s}]").replace("\\S", "[^{s}]").format(l=_spelled(r"\p{L}"), n=_spelled(r"\p{N}"), s=_spelled(r"\s")))
#: What stands before each word of a table; no byte is written like it.
BETWEEN = "\u0100"
PIECE, CACHED, CACHE_WORD, SENT = 1 << 20, 100_000, 64, 2 << 20


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable Latin-1 stands for itself, the others follow from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tables of a byte-level BPE vocabulary file; small enough to broadcast."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids, pairs = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in ids.items() if t not in self.added} | {i: t.encode() for t, i in self.added.items()}
        self.merge = {}  # (left, right) to (rank, made)
        for rank, (a, b) in enumerate(pairs):
            self.merge.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        single = {v[0]: i for i, v in self.bytes_of.items() if len(v) == 1 and i not in self.added.values()}
        # a token takes part if merging its own bytes gives it; its last merge is how it comes apart
        self.parts: dict[int, tuple[int, int, int]] = {}  # made to (rank, left, right)
        self.usable = set(single.values())
        for i, raw in self.bytes_of.items():
            if len(raw) > 1 and i not in self.added.values():
                word, last = [single[b] for b in raw], None
                while len(word) > 1:
                    rank, at = min(((self.merge[p][0], k) for k, p in enumerate(zip(word, word[1:])) if p in self.merge), default=(None, 0))  # noqa: B905
                    if rank is None:
                        break
                    last = (rank, word[at], word[at + 1])
                    word[at : at + 2] = [self.merge[word[at], word[at + 1]][1]]
                if word == [i]:
                    self.usable.add(i)
                    self.parts[i] = last


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v, self.pairs, self.cache, self.older = vocabulary, {}, {}, {}
        self.automaton, self.single = ahocorasick.Automaton(), {BETWEEN: -1}
        for i in vocabulary.usable:
            raw = vocabulary.bytes_of[i]
            if len(raw) > 1:
                self.automaton.add_word(raw.decode("latin-1"), (len(raw), i))
            else:
                self.single[chr(raw[0])] = i
        self.automaton.make_automaton()
        self.bytes_at = [vocabulary.bytes_of.get(i, b"") for i in range(max(vocabulary.bytes_of) + 1)]
        self.splitter = regex.compile("|".join(map(regex.escape, sorted(vocabulary.added, key=len, reverse=True)))) if vocabulary.added else None

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that stand at one edge of a token while it is being merged, each with the rank that ends it."""
        out, until = [], float("inf")
        while True:
            out.append((token, until))
            if token not in self.v.parts:
                return out
            until, token = self.v.parts[token][0], self.v.parts[token][side]

    def compatible(self, left: int, right: int) -> bool:
        """Whether no merge crosses the boundary; at equal rank the one further left comes first."""
        merge = self.v.merge
        for x, x_ends in self._edge(left, 2):
            for y, y_ends in self._edge(right, 1):
                made = merge.get((x, y))
                if made and made[0] < x_ends and made[0] <= y_ends:
                    return False
        return True

    def words(self, raws: list[bytes]) -> Iterator[bytes]:
        """Identifiers of each word, as little-endian unsigned 32-bit integers; one table for all of them, each behind a mark."""
        flat = BETWEEN + BETWEEN.join([raw.decode("latin-1") for raw in raws])
        last, back, pairs = list(map(self.single.__getitem__, flat)), [1] * len(flat), self.pairs
        for end, (length, token) in self.automaton.iter(flat):
            if back[end] > 1:
                continue  # the prefix has its token
            before = last[end - length]
            if before >= 0:
                key = before << 32 | token
                good = pairs.get(key)
                if good is None:
                    if len(pairs) > CACHED:
                        pairs.clear()
                    good = pairs[key] = self.compatible(before, token)
                if not good:
                    continue
            last[end], back[end] = token, length
        begin = 0
        for raw in raws:
            out, at = [], begin + len(raw)
            while at > begin:
                out.append(last[at])
                at -= back[at]
            out.reverse()
            yield array("I", out).tobytes()
            begin += len(raw) + 1

    def _pieces(self, text: str) -> Iterator[str]:
        """Parts of a long text; a word never spans what is neither white space before nor other than a space after."""
        at = 0
        while len(text) - at > PIECE:
            cut = text.find(" ", at + PIECE)
            while cut > 0 and text[cut - 1].isspace():
                cut = text.find(" ", cut + 1)
            if cut < 0:
                break
            yield text[at:cut]
            at = cut
        yield text[at:] if at else text

    def ordinary(self, text: str) -> Iterator[bytes]:
        for piece in self._pieces(text):
            words = (LATIN if not OTHER.search(piece) else PLAIN if not NEW.search(piece) else CAREFUL).findall(piece)
            cache = self.cache
            made = {w: self.older.get(w) for w in words if w not in cache}
            new = [w for w, ids in made.items() if ids is None]
            made.update(zip(new, self.words([w.encode() for w in new]), strict=True))
            yield b"".join([cache[w] if w in cache else made[w] for w in words] if made else map(cache.__getitem__, words))
            self._keep(made)

    def _keep(self, made: dict[str, bytes]) -> None:
        """Keep short words for later texts: of those before the last CACHED, the ones that are still asked for."""
        for word, ids in made.items():
            if len(word) <= CACHE_WORD:
                if len(self.cache) >= CACHED:
                    self.cache, self.older = {}, self.cache
                self.cache[word] = ids

    def forget(self) -> None:
        self.cache, self.older, self.pairs = {}, {}, {}

    def encode(self, text: str) -> bytes:
        if self.splitter is None:
            return b"".join(self.ordinary(text))
        parts, at = [], 0
        for m in self.splitter.finditer(text):
            parts += [*self.ordinary(text[at : m.start()]), array("I", [self.v.added[m[0]]]).tobytes()]
            at = m.end()
        return b"".join([*parts, *self.ordinary(text[at:])])

    def decode(self, ids: bytes) -> str:
        flat = array("I")
        flat.frombytes(ids)
        return b"".join(map(self.bytes_at.__getitem__, flat)).decode("utf-8", "replace")


_made: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """The encoder of this Python worker, kept over its tasks."""
    if id(shared.value) not in _made:
        _made.clear()
        _made[id(shared.value)] = Encoder(shared.value)
    return _made[id(shared.value)]


def _encoding(shared, run: Callable[[Encoder, pa.RecordBatch], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, with this worker's encoder. What it cached goes at the end of each task: workers live on in later stages."""

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        try:
            for b in batches:
                yield from run(encoder, b)
        finally:
            encoder.forget()

    return lean(whole)


def _parts(ids: pa.Array, made: Iterable[bytes | str], kind: pa.DataType, name: str) -> Iterator[pa.RecordBatch]:
    """Each of ``ids`` with what is made of its row, handed on at every SENT bytes: what a whole batch gives is never held."""
    at, held, size = 0, [], 0
    for x in made:
        held.append(x)
        size += len(x)
        if size >= SENT or at + len(held) == len(ids):
            yield pa.RecordBatch.from_arrays([ids.slice(at, len(held)), pa.array(held, kind)], names=["doc_id", name])
            at, held, size = at + len(held), [], 0


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers, as binary) of every row of ``docs(doc_id, text)``."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(encoder: Encoder, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield from _parts(b.column("doc_id"), (encoder.encode(t.as_py() or "") for t in b.column("text")), pa.binary(), "ids")

    return docs.select("doc_id", "text").mapInArrow(_encoding(shared, run), "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row of ``encoded(doc_id, ids)``."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(encoder: Encoder, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield from _parts(b.column("doc_id"), (encoder.decode(i.as_py() or b"") for i in b.column("ids")), pa.string(), "text")

    return encoded.select("doc_id", "ids").mapInArrow(_encoding(shared, run), "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of ``docs``: encoded, then decoded, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(encoder: Encoder, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n, ids_hex, text_hex = [], [], []
        for t in b.column("text"):
            ids = encoder.encode(t.as_py() or "")
            n.append(len(ids) // 4)
            ids_hex.append(hashlib.sha256(ids).hexdigest())
            text_hex.append(hashlib.sha256(encoder.decode(ids).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(_encoding(shared, run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
