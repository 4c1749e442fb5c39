"""Statistics of text quality, and which texts are no natural prose.

Each text is read once for its statistics. Each is then held against the texts of its language that consist mostly of
running sentences: exact ranks among them, from a range-partitioned sort of the distinct values with partition offsets,
give the empirical tail probability of every statistic, and these are combined into one outlier score. Junk does not
count in the ranks, so it cannot hide by being most of a language, and copies of one page cannot either.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.balance import lookup
from graphloom.scratch import Scratch
from graphloom.shipping import ship

# Frequent function words by language.
COMMON = {
    "en": "the of and or to in is are be by with for on as at from that it this which not may can has have was were such when if than both its "
    "into other also but only between an no these those each one there their will would".split(),
    "de": "der die das des dem den ein eine einer eines einem einen und oder zu zum zur im in ist sind wird werden durch mit für auf als an bei "
    "von vom nach dass es sich nicht auch kann hat haben wenn wie aus um am so nur sowie".split(),
    "fr": "le la les de du des un une et ou au aux en est sont par avec pour sur que qui il elle se ne pas ce cette ces dans son sa ses dont être "
    "peut plus comme si selon il on lui".split(),
    "zh": list("的了在是与其和被中为以及该由对所于可将或从时而不有当如也之"),
}
#: Codes under which the languages are delivered.
CODES = {"en": ("en", "eng"), "de": ("de", "ger", "deu"), "fr": ("fr", "fra", "fre"), "zh": ("zh", "chi", "zho")}
_LANGUAGES = {w: [k for k, ws in COMMON.items() if w in ws] for ws in COMMON.values() for w in ws}
HAN = "㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
_TOKEN = re.compile(f"[{HAN}]|[^\\W_{HAN}]+")
_HAN = re.compile(f"[{HAN}]+")
_ENDS = frozenset(".!?:;,。！？：；，")
#: The end of a sentence, or of lines. It begins with one set of characters, so that the search can skip to them.
_CUT = re.compile(r"[.!?。！？\n](?:(?<=[.!?])[.!?]*[\"'”’»)\]]*(?=[\s<]|$)|(?<=[。！？])[。！？]*|(?<=\n)\n*)")
_LISTED = re.compile(r"[,;|\t&、·；，]")
#: Bytes of UTF-8: all of ASCII but letters and digits as spaces; all digits as 0.
_SPACED = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
_ZEROS = bytes(48 if 48 <= b < 58 else b for b in range(256))

STATISTICS = (
    "word_count", "mean_word_length", "symbol_ratio", "line_punct_share", "common_word_share", "sentence_share", "distinct_line_share", "words_a_line",
)
#: On which side of each statistic junk lies.
JUNK_SIDE = ("low", "both", "high", "low", "low", "low", "low", "low")

#: A sentence: words from and to, characters at most, and its share of function words and of letters and digits at least.
LEAST_WORDS, MOST_WORDS, MOST_WORDS_HAN, MOST_CHARS = 5, 60, 120, 400
LEAST_COMMON, LEAST_COMMON_HAN, LEAST_LETTERS, LONGEST_WORDS = 0.15, 0.03, 0.75, 20
#: A sentence said more often in one text (numbers aside) is a notice, not prose.
MOST_REPEATS = 3
#: A line of fewer words that ends without a full stop is no wrapped part of a sentence.
SHORT_LINE = 7
#: Running text without full stops: words a line, words a listing sign and distinct words at least.
LONG_LINE, WORDS_A_SIGN, DISTINCT_WORDS = 11, 7, 25


#: Texts of whose characters less are in running sentences are no prose and count in no rank.
PROSE_SHARE = 0.5
#: A language with fewer texts of prose is compared with the most frequent one.
LEAST_REFERENCE = 50
#: Scores that more of the prose reaches are no outliers.
OUTLIER_RANK = 0.05


def _dense(text: str, spaces: list[str]) -> int:
    """The characters but spaces, of which those in the text are given."""
    return len(text) - sum(map(text.count, spaces))


def _mapped(text: str, table: bytes) -> str:
    return text.encode("utf-8", "surrogatepass").translate(table).decode("utf-8", "surrogatepass")


class _Sentences:
    """Counts the characters (all but spaces) in running sentences, the same wording MOST_REPEATS times at most."""

    def __init__(self, common: set[str], unstopped: bool, han: bool, spaces: list[str]):
        self.common, self.unstopped, self.han, self.spaces = common, unstopped, han, spaces
        self.found: dict[str, list[tuple[int, list[str]]]] = {}  # by the last word that is no number: as many have the same wording at most

    def add(self, pieces: list[str], tokens: list[list[str]], ended: bool) -> None:
        words = tokens[0] if len(tokens) == 1 else [t for ts in tokens for t in ts]
        n = len(words)
        if n < LEAST_WORDS:
            return
        text = pieces[0] if len(pieces) == 1 else "\n".join(pieces)
        dense, letters = _dense(text, self.spaces), len("".join(words))
        plain = text.isascii()
        han = self.han and not plain and 2 * sum(map(len, _HAN.findall(text))) > n
        if letters < LEAST_LETTERS * dense or (plain and letters > LONGEST_WORDS * n):
            return
        common = self.common
        if len([1 for w in words if w in common]) < (LEAST_COMMON_HAN if han else LEAST_COMMON) * n:
            return
        if not ended or n > (MOST_WORDS_HAN if han else MOST_WORDS) or dense > MOST_CHARS:
            if not self.unstopped or n < LONG_LINE * len(pieces) or len(_LISTED.findall(text)) * WORDS_A_SIGN > n or len(set(words)) < DISTINCT_WORDS:
                return
        last = next((w for w in reversed(words) if not w.isdigit()), "") if words[-1].isdigit() else words[-1]
        self.found.setdefault(last, []).append((dense, words))

    def chars(self) -> int:
        total = 0
        for same in self.found.values():
            if len(same) <= MOST_REPEATS:
                for dense, _ in same:
                    total += dense
                continue
            seen: Counter[str] = Counter()
            for dense, words in same:
                wording = " ".join([w for w in words if not w.isdigit()])
                seen[wording] += 1
                if seen[wording] <= MOST_REPEATS:
                    total += dense
        return total


def statistics(text: str | None) -> tuple | None:
    """The statistics of one text, after its language (None if unknown); None for a null, empty or blank one."""
    if not text or text.isspace():
        return None
    low, pieces, at = text.lower(), [], 0
    used = set(low)
    spaces, others = [c for c in used if c.isspace()], [c for c in used if c > "\x7f"]
    han = sum(map(len, _HAN.findall(low))) if _HAN.search("".join(others)) else 0
    if han:
        words_of, spaced = _TOKEN.findall, low
    else:  # the same words in less time: what is in none as spaces, place by place
        words_of, spaced = str.split, _mapped(low, _SPACED)
        for c in others:
            if not c.isalnum():
                spaced = spaced.replace(c, " ")
    for m in _CUT.finditer(low):
        start, end = m.span()
        broken = low[start] == "\n"
        if broken:
            piece, words = low[at:start], words_of(spaced[at:start])
        else:
            piece, words = low[at:end], words_of(spaced[at:end])
        at = end
        pieces.append((piece, words, broken, broken and end - start > 1))
    pieces.append((low[at:], words_of(spaced[at:]), True, True))
    every = [t for p in pieces for t in p[1]]
    tally = Counter(every)
    words, chars = len(every), len("".join(every))
    votes, common = dict.fromkeys(COMMON, 0), 0
    for t in tally.keys() & _LANGUAGES.keys():
        common += tally[t]
        for k in _LANGUAGES[t]:
            votes[k] += tally[t]
    if 2 * han > words:
        lang = "zh"
    else:
        lang, n = max(votes.items(), key=lambda kv: kv[1])
        lang = lang if n * 20 >= words and n else None
    # of languages without a list the short words that the text itself repeats, in sentences with a full stop alone
    known = set(_LANGUAGES) if lang else {t for t, n in tally.items() if n > 2 and len(t) < 5 and t.isalpha()} | set(_LANGUAGES)
    found, held, tokens = _Sentences(known, lang is not None, han > 0, spaces), [], []
    for piece, ts, broken, blank in pieces:
        if piece:
            held.append(piece)
            tokens.append(ts)
        if held and (not broken or blank or len(ts) < SHORT_LINE):
            found.add(held, tokens, not broken)
            held, tokens = [], []
    if held:
        found.add(held, tokens, False)
    dense, numbers = _dense(text, spaces), _mapped(low, _ZEROS)
    while "00" in numbers:
        numbers = numbers.replace("00", "0")
    lines = [x for x in map(str.strip, numbers.split("\n")) if x]
    ending, distinct = sum(x[-1] in _ENDS for x in lines), len(set(lines))
    return (
        lang, words, chars / words if words else 0.0, max(0, dense - chars) / dense, ending / len(lines), common / words if words else 0.0,
        found.chars() / dense, distinct / len(lines), words / len(lines),
    )


def _batches():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from graphloom.llm.quality import STATISTICS, statistics

        kinds = [pa.string(), pa.int64(), *[pa.float64()] * (len(STATISTICS) - 1)]
        for batch in batches:
            rows = []
            for lo in range(0, batch.num_rows, 256):
                rows.extend(map(statistics, batch.column(2).slice(lo, 256).to_pylist()))
            there = pa.array([r is not None for r in rows], pa.bool_())
            columns = list(zip(*(r for r in rows if r is not None))) or [()] * len(kinds)
            ids, given = batch.column(0).filter(there), batch.column(1).filter(there)
            arrays = [ids, given, *(pa.array(c, t) for c, t in zip(columns, kinds))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "given", "lang", *STATISTICS])

    return run


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, word_count, mean_word_length, symbol_ratio, line_punct_share, common_word_share, sentence_share,
    distinct_line_share, words_a_line.

    Null, empty and blank texts have no row. A word is a run of letters and digits, or one Han character. symbol_ratio
    is the share of all characters but spaces that are neither; line_punct_share that of the lines with any character
    that end in punctuation; common_word_share that of the words that are function words; sentence_share that of all
    characters but spaces in running sentences; distinct_line_share counts lines that differ in more than numbers. lang
    is judged by the text, else by the delivered code, else null. One narrow pass over whole texts.
    """
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    given = F.lower(F.trim("lang")) if "lang" in docs.columns else F.lit(None).cast("string")
    code = F.coalesce(*[F.when(given.isin(*codes), F.lit(k)) for k, codes in CODES.items()])
    fields = ", ".join(["lang string", f"{STATISTICS[0]} bigint", *(f"{c} double" for c in STATISTICS[1:])])
    out = docs.select("doc_id", code.alias("given"), "text").mapInArrow(_batches(), f"doc_id {kind}, given string, {fields}")
    return out.withColumn("lang", F.coalesce("lang", "given")).drop("given")


def tail_probabilities(values: DataFrame, tables: Scratch) -> DataFrame:
    """For rows (stat, lang, value, counts): each distinct (stat, lang, value) with at_most and at_least, the exact
    numbers of the counting rows of its stat and lang whose value is not above, or not below, and their total.

    Equal values are counted together first. The distinct ones are sorted over range partitions; a running count within
    each partition plus the offset of the partition (the counts of those before it) is the exact rank.
    """
    weighted = values.groupBy("stat", "lang", "value").agg(F.count(F.when(F.col("counts"), 1)).alias("n"))
    ranged = weighted.repartitionByRange("stat", "lang", "value").sortWithinPartitions("stat", "lang", "value").withColumn("part", F.spark_partition_id())
    ranged = tables.table(ranged, "ranged")
    sums = ranged.groupBy("stat", "lang", "part").agg(F.sum("n").alias("m"))  # partitions x statistics x languages rows
    group = W.partitionBy("stat", "lang")
    before = F.coalesce(F.sum("m").over(group.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("stat", "lang", "part", before.alias("before"), F.sum("m").over(group).alias("total"))
    inside = F.sum("n").over(W.partitionBy("part", "stat", "lang").orderBy("value").rowsBetween(W.unboundedPreceding, 0))
    ranks = ranged.withColumn("upto", inside).join(F.broadcast(offsets), ["stat", "lang", "part"])
    upto = F.col("before") + F.col("upto")
    return ranks.select("stat", "lang", "value", upto.alias("at_most"), (F.col("total") - upto + F.col("n")).alias("at_least"), "total")


def _surprise(tail: str) -> Column:
    """-ln of a tail probability, never infinite: one more text is thought of at the value itself."""
    return -F.log((F.col(tail) + 1) / (F.col("total") + 1))


def outlier_scores(docs: DataFrame, tables: Scratch | None = None) -> DataFrame:
    """The statistics of each text with ``score`` and ``rank``.

    The reference of a text are the texts of its language of whose characters at least PROSE_SHARE are in running
    sentences. Where its language is unknown, or has fewer than LEAST_REFERENCE such texts, it is the one of the language
    with most of them; where no language has as many, that of all texts together. score is the sum over the statistics
    of -ln of the tail probability, among the reference, on the side where junk lies (of both sides, doubled, where it
    lies on either). rank is the share of the reference whose score is at least as high, 0 where even all texts
    together give fewer than LEAST_REFERENCE, which is too few to tell.
    """
    tables = tables or Scratch(docs.sparkSession, "quality")
    running = F.col("sentence_share") >= PROSE_SHARE
    sizes = {f"n_{k}": F.count(F.when(running & (F.col("lang") == k), 1)) for k in COMMON}
    stats = tables.table(text_statistics(docs).withColumn("row", F.monotonically_increasing_id()), "stats", **sizes)
    own = sorted((k for k in COMMON if stats.metrics[f"n_{k}"] >= LEAST_REFERENCE), key=lambda k: -stats.metrics[f"n_{k}"])
    among = F.when(F.col("lang").isin(*own), F.col("lang")).otherwise(F.lit(own[0])) if own else F.lit("all")
    pairs = F.array(*[F.struct(F.lit(i).alias("stat"), F.col(c).cast("double").alias("value")) for i, c in enumerate(STATISTICS)])
    long = stats.select("row", among.alias("lang"), running.alias("counts"), F.inline(pairs))
    tails = tail_probabilities(long.drop("row"), tables)
    low, high = _surprise("at_most"), _surprise("at_least")
    side = F.element_at(F.array(*map(F.lit, JUNK_SIDE)), F.col("stat") + 1)
    both = F.greatest(F.greatest(low, high) - F.log(F.lit(2.0)), F.lit(0.0))
    part = F.when(side == "low", low).when(side == "high", high).otherwise(both)
    key, n = F.struct("stat", "lang", "value").alias("key"), stats.row_count
    met = lookup(long.select("row", key), tails.select(key, part.alias("part")), "key", n * len(STATISTICS), "row", "inner")
    scores = met.groupBy("row").agg(F.round(F.sum("part"), 9).alias("score"))
    scored = tables.table(stats.join(scores, "row").withColumn("among", among), "scored")
    ranks = tail_probabilities(scored.select(F.lit(0).alias("stat"), F.col("among").alias("lang"), F.col("score").alias("value"), running.alias("counts")), tables)
    rank = F.when(F.col("total") >= LEAST_REFERENCE, F.col("at_least") / F.col("total")).otherwise(F.lit(0.0)).alias("rank")
    ranks = ranks.select(F.struct("lang", "value").alias("key"), rank)
    keyed = scored.withColumn("key", F.struct(F.col("among").alias("lang"), F.col("score").alias("value")))
    return lookup(keyed, ranks, "key", n, "row", "inner").drop("key", "row", "among")


def no_prose(docs: DataFrame) -> DataFrame:
    """The texts (doc_id, score, rank, sentence_share) that are no natural prose: their score is so high that at most
    OUTLIER_RANK of the prose of their language reaches it, and, as an exact check, less than PROSE_SHARE of their
    characters are in running sentences."""
    found = outlier_scores(docs).filter((F.col("rank") <= OUTLIER_RANK) & (F.col("sentence_share") < PROSE_SHARE))
    return found.select("doc_id", "score", "rank", "sentence_share")
