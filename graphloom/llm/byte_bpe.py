"""Token ids of texts under a public byte-level BPE vocabulary.

Texts are cut into words by the vocabulary's pattern. Each worker encodes every distinct word piece it meets once, in a
recursive query of an embedded DuckDB: token-position rows are joined with the merge table, and each piece contracts its
pair of the least rank, from the left, until none is left; an ordered aggregation gives the ids. Texts are then put
together from the encoded pieces. Another ordered aggregation decodes ids. Nothing is shuffled.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.shipping import ship

#: Fixed value: the public pattern that cuts texts into words before merging. {L}, {N} and {S} stand for letters,
#: numbers and white space, as :func:`word_finder` writes them out.
PATTERN = r" ?[{L}]+|'(?:s|t|re|ve|m|ll|d)| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
#: Where the vocabulary lies, unless a path is given.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Words kept encoded in a worker, and characters of text cut at a time: they bound a worker's memory.
KEPT_WORDS, CHUNK = 150_000, 1_500_000

# The table s holds one row a position, replaced as it changes (-1: swallowed by the token before it); only pieces that
# changed last are looked at again. All places of the least pair are contracted in one round, which equals one by one from
# the left, as a token made of a pair has a later rank. Where a pair of equal tokens overlaps itself, every other one counts.
_MERGE = """
WITH RECURSIVE s(piece, pos, tok) USING KEY (piece, pos) AS (
    SELECT piece, pos, tok FROM start
  UNION
    (WITH pairs AS (
        SELECT piece, pos, tok, lead(tok) OVER w AS tok2, lead(pos) OVER w AS pos2, row_number() OVER w AS i
        FROM recurring.s WHERE tok >= 0 AND piece IN (SELECT piece FROM s) WINDOW w AS (PARTITION BY piece ORDER BY pos)),
     ranked AS (SELECT p.*, m.rank, m.id FROM pairs p LEFT JOIN merges m ON p.tok = m.a AND p.tok2 = m.b),
     least AS (SELECT piece, min(rank) AS least FROM ranked GROUP BY piece HAVING min(rank) IS NOT NULL),
     hits AS (SELECT r.piece, r.pos, r.pos2, r.id, r.i, coalesce(r.rank = l.least, false) AS hit FROM ranked r JOIN least l ON r.piece = l.piece),
     turns AS (
        SELECT *, hit AND (i - coalesce(max(CASE WHEN NOT hit THEN i END) OVER (PARTITION BY piece ORDER BY i), 0)) % 2 = 1 AS joins FROM hits)
     SELECT piece, unnest([pos, pos2]), unnest([id, -1]) FROM turns WHERE joins))
SELECT piece, list(tok ORDER BY pos) AS ids FROM s WHERE tok >= 0 GROUP BY piece
"""
_DECODE = """
SELECT t.doc, string_agg(v.letters, '' ORDER BY t.pos) AS letters
FROM (SELECT doc, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM encoded) t JOIN tokens v ON v.id = t.id GROUP BY t.doc
"""


def byte_letters() -> dict[int, str]:
    """The public byte-to-letter table of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the
    others for the letters from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def word_finder() -> Callable[[str], list[str]]:
    """findall of the pattern. For texts of the basic plane the classes are spelled out as ranges, which the standard
    matcher turns into bitmaps: twice as fast as Unicode properties, by which the other texts are cut."""
    import regex

    basic = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000)
    properties, ranges = {"L": r"\p{L}", "N": r"\p{N}", "S": r"\s"}, {}
    for name, one in properties.items():
        runs = [(ord(m[0][0]), ord(m[0][-1])) for m in regex.finditer(one + "+", basic)]
        ranges[name] = "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs)
    fast, whole = re.compile(PATTERN.format(**ranges)).findall, regex.compile(PATTERN.format(**properties)).findall
    beyond = re.compile("[\U00010000-\U0010ffff]").search
    return lambda text: whole(text) if beyond(text) else fast(text)


class Encoder:
    """Encodes words; one per worker process and vocabulary."""

    _kept: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def __init__(self, path: str):
        import duckdb

        model = json.load(open(path, encoding="utf-8"))["model"]
        vocabulary, letters = model["vocab"], byte_letters()
        back = {c: b for b, c in letters.items()}
        self.back, self.byte_ids = back, [vocabulary[letters[b]] for b in range(256)]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        table = [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in merges]
        # no token holds these two bytes side by side, so no merge ever crosses between them
        together = bytearray(65536)
        for a, b in merges:
            word = [back[c] for c in a + b]
            for x, y in zip(word, word[1:]):
                together[x << 8 | y] = 1
        self.together = bytes(together)
        self.find = word_finder()
        self.words: dict[str, bytes] = {}  # the ids of each word, as 32-bit integers
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "256MB"})
        a, b, m = zip(*table)
        arrow = pa.table({"rank": pa.array(range(len(table)), pa.int64()), "a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "id": pa.array(m, pa.int32())})
        self.db.register("arrow_merges", arrow)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM arrow_merges")
        self.db.unregister("arrow_merges")
        self.vocabulary = pa.table({"id": pa.array(vocabulary.values(), pa.int32()), "letters": pa.array(vocabulary.keys(), pa.string())})

    def pieces(self, word: bytes) -> list[bytes]:
        """The word cut wherever no token could cross."""
        together, out, start = self.together, [], 0
        for i in range(1, len(word)):
            if not together[word[i - 1] << 8 | word[i]]:
                out.append(word[start:i])
                start = i
        out.append(word[start:])
        return out

    def learn(self, words: set[str]) -> None:
        """Encode the words that are not known yet."""
        cut = {w: self.pieces(w.encode("utf-8", "surrogatepass")) for w in words}
        distinct = list(set(chain.from_iterable(cut.values())))
        done: dict[bytes, tuple[int, ...]] = {}
        several = []
        for p in distinct:
            if len(p) == 1:
                done[p] = (self.byte_ids[p[0]],)
            else:
                several.append(p)
        if several:
            rows = {"piece": [], "pos": [], "tok": []}
            for i, p in enumerate(several):
                rows["piece"].extend([i] * len(p))
                rows["pos"].extend(range(len(p)))
                rows["tok"].extend([self.byte_ids[b] for b in p])
            start = pa.table({"piece": pa.array(rows["piece"], pa.int32()), "pos": pa.array(rows["pos"], pa.int64()), "tok": pa.array(rows["tok"], pa.int32())})
            self.db.register("start", start)
            for i, ids in self.db.execute(_MERGE).fetchall():
                done[several[i]] = tuple(ids)
            self.db.unregister("start")
        for w, ps in cut.items():
            self.words[w] = array("i", chain.from_iterable(done[p] for p in ps)).tobytes()

    def decode(self, ids: pa.Array) -> list[str]:
        """The text of each list of ids; ids that are no token of the vocabulary are left out, broken bytes replaced."""
        self.db.register("tokens", self.vocabulary)
        self.db.register("encoded", pa.table({"doc": pa.array(range(len(ids)), pa.int32()), "ids": ids}))
        out = [""] * len(ids)
        for i, letters in self.db.execute(_DECODE).fetchall():
            out[i] = bytes(map(self.back.__getitem__, letters)).decode("utf-8", "replace")
        self.db.unregister("encoded")
        return out

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text, as 32-bit integers; null and empty texts have none."""
        start = 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and (size < CHUNK or stop == start):
                size += len(texts[stop] or "")
                stop += 1
            cut = [self.find(t) if t else [] for t in texts[start:stop]]
            new = set(chain.from_iterable(cut)) - self.words.keys()
            if new:
                if len(self.words) + len(new) > KEPT_WORDS:
                    self.words.clear()
                    new = set(chain.from_iterable(cut))
                self.learn(new)
            get = self.words.__getitem__
            for words in cut:
                yield b"".join(map(get, words))
            start = stop


def _batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from graphloom.llm.byte_bpe import Encoder
        from graphloom.shipping import shipped

        encoder = Encoder.of(shipped(path))
        for batch in batches:
            texts, offsets, values = batch.column(1), [0], []
            for lo in range(0, len(texts), 512):
                for ids in encoder.encode(texts.slice(lo, 512).to_pylist()):
                    values.append(ids)
                    offsets.append(offsets[-1] + len(ids) // 4)
            flat = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(values))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)], ["doc_id", "ids"])

    return run


def token_ids(df: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, ids (array of int): the ids of each text, without special tokens; names of special tokens are ordinary text.

    An empty and a null text give an empty list; repeated and null doc_ids are kept as they are. Texts are encoded
    whole, whatever their length. An empty table gives an empty result. One narrow pass over the two columns. The file
    of the vocabulary goes to the executors with the job.
    """
    ship(df.sparkSession, vocabulary)
    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(df[doc_id].alias("doc_id"), df[text].alias("text")).mapInArrow(_batches(vocabulary), f"doc_id {kind}, ids array<int>")


def _texts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from graphloom.llm.byte_bpe import Encoder
        from graphloom.shipping import shipped

        encoder = Encoder.of(shipped(path))
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(encoder.decode(part.column(1)), pa.string())], ["doc_id", "text"])

    return run


def token_texts(df: DataFrame, doc_id: str = "doc_id", ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, text: what lists of ids (array of int) stand for; the inverse of :func:`token_ids`, but that null texts
    come back empty, as do null and empty lists. Numbers that are no id are left out. One narrow pass."""
    ship(df.sparkSession, vocabulary)
    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(df[doc_id].alias("doc_id"), df[ids].cast("array<int>").alias("ids")).mapInArrow(_texts(vocabulary), f"doc_id {kind}, text string")
