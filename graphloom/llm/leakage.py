"""Evaluation texts inside training texts.

One Aho-Corasick automaton holds short word sequences of all evaluation items and their answers. Each text is scanned once, in a
normalised stream of its letters and digits alone, so that case, punctuation, spacing, broken lines and markup make no
difference. Every hit is extended to both sides in the stream, over at most three changed, added or left-out words.
"""

from __future__ import annotations

import html
import re
import unicodedata
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.shipping import ship

#: Words that a case repeats at least, and how many of them go with one edit.
LEAST_WORDS, WORDS_AN_EDIT = 15, 10
#: A stretch of four edits or more always holds a shorter one that keeps the edit rate. One of three need not, as its parts
#: lose their outer edits and with them the least words: 14 words, three changed ones, 13 words.
MOST_EDITS = 3
#: Such a stretch has six counting words in an unchanged run. If they are not parted by stock wording, they hold a seed of
#: four words that starts at a multiple of three; else the run holds a seed that lies on the border, and all those are taken.
SEED_WORDS, SEED_STEP = 4, 3

_TAG = re.compile(r"<[/!?]?[A-Za-z][^<>]{0,300}>|<!--.*?-->|\\[A-Za-z]{2,}\b", re.S)
_WORD = re.compile(r"[^\W_]+")


def normal(text: str) -> str:
    """The text without markup, compatibility forms and case. Words are its runs of letters and digits."""
    if "<" in text or "\\" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return text.casefold()


def words_of(text: str) -> list[str]:
    return _WORD.findall(normal(text))


def stream_offsets(text: str) -> list[int]:
    """For each character of the text's stream its offset in the original text; exact also where markup was dropped,
    entities replaced or characters composed."""
    out: list[int] = []
    pieces = re.compile(_TAG.pattern + r"|&#?\w+;|.[̀-ͯ]*", re.S)
    for m in pieces.finditer(text):
        if not _TAG.fullmatch(m[0]):
            out.extend([m.start()] * len("".join(_WORD.findall(unicodedata.normalize("NFKC", html.unescape(m[0])).casefold()))))
    return out


@dataclass
class Item:
    """An item's stream, where its words begin in it, which of them count (1) or are stock wording (0), and the stream of
    its answer."""

    words: list[str]
    counts: list[int]
    answer: str = ""
    stream: str = ""
    starts: list[int] = field(default_factory=list)

    def __post_init__(self):
        self.stream = "".join(self.words)
        self.starts = [0, *accumulate(map(len, self.words))]


def items_of(texts: list[str | None], stock: list[str | None], answers: list[str | None] | None = None) -> list[Item]:
    """The items; words inside a whole occurrence of a stock phrase don't count."""
    phrases = [w for w in (words_of(s) for s in stock if s) if w]
    out = []
    for t, answer in zip(texts, answers or [None] * len(texts)):
        words = words_of(t or "")
        counts = [1] * len(words)
        for p in phrases:
            for i in range(len(words) - len(p) + 1):
                if words[i : i + len(p)] == p:
                    counts[i : i + len(p)] = [0] * len(p)
        out.append(Item(words, counts, "".join(words_of(answer or ""))))
    return out


class Scanner:
    """The automaton over all items; one per worker process and set of items."""

    _kept: dict[str, Scanner] = {}

    @classmethod
    def of(cls, key: str, texts: list[str | None], stock: list[str | None], answers: list[str | None]) -> Scanner:
        if key not in cls._kept:
            cls._kept.clear()
            cls._kept[key] = cls(items_of(texts, stock, answers))
        return cls._kept[key]

    def __init__(self, items: list[Item]):
        import ahocorasick

        self.items = items
        seeds: dict[str, list[tuple[int, int]]] = {}
        answers: dict[str, list[int]] = {}
        for k, item in enumerate(items):
            run = 0  # counted from the start of each stretch without stock wording
            for i in range(len(item.words)):
                run = run + 1 if item.counts[i] else 0
                first = i - SEED_WORDS + 1
                border = first >= 0 and 0 < sum(item.counts[first : i + 1]) < SEED_WORDS
                if border or (run >= SEED_WORDS and (run - SEED_WORDS) % SEED_STEP == 0):
                    seeds.setdefault("".join(item.words[first : i + 1]), []).append((k, first))
            if item.answer:
                answers.setdefault(item.answer, []).append(k)
        self.automaton = ahocorasick.Automaton()
        for pattern in seeds.keys() | answers.keys():
            self.automaton.add_word(pattern, (len(pattern), seeds.get(pattern, ()), answers.get(pattern, ())))
        self.any = bool(seeds)
        if self.any:
            self.automaton.make_automaton()

    def cases(self, text: str) -> dict[int, tuple[int, int, int | None, int | None]]:
        """Of each item that the text repeats: where in the stream the stretch found first begins and ends, and where its
        answer does, as whole words, if the text holds it."""
        if not self.any:
            return {}
        words = words_of(text)
        stream = "".join(words)
        found: dict[int, tuple[int, int]] = {}
        bounds: list[int] = []
        walked: dict[tuple[int, int], int] = {}
        answered: list[tuple[int, int, tuple[int, ...]]] = []
        for end, (size, where, of) in self.automaton.iter(stream):
            at = end + 1 - size
            if of:
                answered.append((at, end + 1, of))
            for k, i in where:
                if k in found:
                    continue
                shift = at - self.items[k].starts[i]
                if i < walked.get((k, shift), 0):  # a neighbouring seed of the same unchanged run was extended already
                    continue
                bounds = bounds or [0, *accumulate(map(len, words))]
                stretch, walked[k, shift] = extend(self.items[k], i, stream, at, bounds)
                if stretch:
                    found[k] = stretch
        if not found:
            return {}
        ends, places = set(bounds), {}
        for a, b, of in answered:
            if a in ends and b in ends:
                for k in of:
                    places.setdefault(k, (a, b))
        return {k: (*stretch, *places.get(k, (None, None))) for k, stretch in found.items()}


def extend(item: Item, i: int, stream: str, at: int, bounds: list[int]) -> tuple[tuple[int, int] | None, int]:
    """Extend the match of item word i at position ``at`` of a stream whose words begin at ``bounds``.

    Returns the stretch found, or None, and the item's word at which the unchanged run around the seed ends.
    """
    right = _reach(item, i, stream, at, bounds, 1)
    left = _reach(item, i, stream, at, bounds, -1)
    for edits in range(MOST_EDITS + 1):
        need = max(LEAST_WORDS, edits * WORDS_AN_EDIT)
        for r in range(edits + 1):
            (n1, end), (n2, start) = right[r], left[edits - r]
            if n1 + n2 >= need:
                return (start, end), len(item.words)
    shift = at - item.starts[i]
    while i < len(item.words) and stream.startswith(item.words[i], item.starts[i] + shift):
        i += 1
    return None, i


def _reach(item: Item, i: int, stream: str, at: int, bounds: list[int], way: int) -> list[tuple[int, int]]:
    """For 0, 1, ... edits: the most counting words that can be had in one direction, and where they end in the stream.

    A stretch ends with an unchanged word, and only where a word of the text ends too, so that no word counts that
    merely begins alike.
    """
    words, counts, n, size = item.words, item.counts, len(item.words), len(stream)
    best = [(0, at)] * (MOST_EDITS + 1)
    todo, seen = [(i, at, 0, 0)], set()
    while todo:
        i, p, edits, got = todo.pop()
        if (i, p, edits) in seen:
            continue
        seen.add((i, p, edits))
        matched = False
        while True:
            k = bisect_left(bounds, p)
            if matched and got > best[edits][0] and k < len(bounds) and bounds[k] == p:
                for e in range(edits, MOST_EDITS + 1):
                    if got > best[e][0]:
                        best[e] = (got, p)
            j = i if way > 0 else i - 1
            if not 0 <= j < n:
                break
            w = words[j]
            if not (stream.startswith(w, p) if way > 0 else stream.endswith(w, 0, p)):
                break
            got, p, i, matched = got + counts[j], p + way * len(w), i + way, True
        if edits < MOST_EDITS:
            j = i if way > 0 else i - 1
            if way > 0:
                k = bisect_right(bounds, p)
                q = bounds[k] if k < len(bounds) else None
            else:
                k = bisect_left(bounds, p) - 1
                q = bounds[k] if k >= 0 else None
            inside = 0 <= j < n
            if q is not None and inside:
                todo.append((i + way, q, edits + 1, got + counts[j]))  # changed
            if inside:
                todo.append((i + way, p, edits + 1, got + counts[j]))  # left out
            if q is not None:
                todo.append((i, q, edits + 1, got))  # added
    return best


def _batches(known):
    """known: a broadcast of (key, item ids, item texts, answers, stock phrases)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from graphloom.llm.leakage import Scanner, stream_offsets

        key, ids, texts, answers, stock = known.value
        scanner = Scanner.of(key, texts, stock, answers)
        for batch in batches:
            out: list[tuple] = []
            for lo in range(0, batch.num_rows, 256):
                docs, bodies = batch.column(0).slice(lo, 256).to_pylist(), batch.column(1).slice(lo, 256).to_pylist()
                for doc, body in zip(docs, bodies):
                    if body and (found := scanner.cases(body)):
                        offsets = stream_offsets(body)
                        last = len(offsets)
                        for k, (a, b, answer, answer_end) in sorted(found.items()):
                            place = (None, None) if answer is None else (offsets[answer], offsets[min(answer_end, last) - 1] + 1)
                            out.append((doc, ids[k], offsets[a], offsets[min(b, last) - 1] + 1, *place))
            columns = list(zip(*out)) or [()] * 6
            kinds = [batch.schema.field(0).type, *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "item_id", "start_at", "end_at", "answer_at", "answer_end"])

    return run


def _parts(items: DataFrame, most: int) -> int:
    """Into how many parts, by the hash of the id, the items are to be split so that each has ``most`` characters at most."""
    parts = 1
    while True:
        size = items.groupBy(F.pmod(F.xxhash64("item_id"), F.lit(parts)).alias("p")).agg(F.sum("chars").alias("n"), F.max("chars").alias("one"))
        largest = size.agg(F.max("n").alias("n"), F.max("one").alias("one")).first()
        if (largest.n or 0) <= most:
            return parts
        if largest.one > most:
            raise ValueError(f"an evaluation text of {largest.one} characters does not fit into an automaton of {most}")
        parts *= 2


def leaks(docs: DataFrame, items: DataFrame, stock: DataFrame, most_item_chars: int = 50_000_000) -> DataFrame:
    """doc_id, item_id, start_at, end_at, answer_at, answer_end: each document and item where the document repeats at
    least LEAST_WORDS words of the item's text in one stretch, up to one word in WORDS_AN_EDIT changed, added or left out.

    start_at and end_at are offsets in the document's original text of the stretch found first; answer_at and answer_end
    those of the item's answer, as whole words, null if the document (or the item) has none. An answer alone is no case.
    Items (item_id, text, answer, the last optional) and stock phrases (text) go to every worker in parts of at most
    most_item_chars characters, which is checked; the documents (doc_id, text) are read whole in one narrow pass a part,
    without a shuffle. Null and empty texts on either side give no case. Items that share a passage each give a case.
    Item ids must be unique.
    """
    spark = docs.sparkSession
    ship(spark)
    answer = F.col("answer") if "answer" in items.columns else F.lit(None).cast("string")
    items = items.filter(F.col("item_id").isNotNull()).select(F.col("item_id").cast("bigint"), "text", answer.alias("answer"))
    sized = items.withColumn("chars", F.coalesce(F.length("text"), F.lit(0)) + F.coalesce(F.length("answer"), F.lit(0)))
    size = stock.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first().n
    if size > most_item_chars:
        raise ValueError(f"{size} characters of stock phrases are more than {most_item_chars}")
    phrases = sorted(r[0] for r in stock.select("text").dropna().distinct().collect())
    kind, parts, out = docs.schema["doc_id"].dataType.simpleString(), _parts(sized, most_item_chars), None
    for p in range(parts):
        known = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == p).orderBy("item_id").collect()
        ids, texts, answers = ([r[i] for r in known] for i in range(3))
        sent = spark.sparkContext.broadcast((uuid.uuid4().hex, ids, texts, answers, phrases))
        part = docs.select("doc_id", "text").mapInArrow(_batches(sent), f"doc_id {kind}, item_id bigint, start_at bigint, end_at bigint, answer_at bigint, answer_end bigint")
        out = part if out is None else out.unionByName(part)
    return out
