"""Token ids, leaked tests and text quality."""

import os
import random
import re
from array import array
from collections import defaultdict
from itertools import combinations

import pytest

from graphloom.llm import byte_bpe, leakage, quality

needs_vocabulary = pytest.mark.skipif(not os.path.exists(byte_bpe.VOCABULARY), reason="no vocabulary here")
ODD = [
    "", None, " ", "\n\n  \t", "It's 12.5 µm, don't <|endoftext|> now", "日本語のテキスト 试验表明，与玻璃相比", "𝔘𝔫𝔦 code 🎉🎉  end ", "a" * 3000, "Donaudampfschifffahrts" * 40,
    " x\x1c\x85y\xa0z", "ab" * 200 + "é" * 150, "�\u0000 nul", "x" * 100 + " " * 50 + "y",
]


# ---------------------------------------------------------------- token ids
@needs_vocabulary
def test_ids_equal_the_public_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(byte_bpe.VOCABULARY)
    library.encode_special_tokens = True
    rng = random.Random(11)
    texts = ODD + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x3000), 32, 10])) for _ in range(rng.randrange(80))) for _ in range(300)]
    rows = [(i, t, [0]) for i, t in enumerate(texts)] + [(None, "twice", [1]), (0, "twice", [2])]
    out = byte_bpe.token_ids(spark.createDataFrame(rows, "doc_id bigint, text string, ids array<int>"))
    assert out.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.ids) for r in out.collect()))
    want = sorted((d is None, d or 0, library.encode(t, add_special_tokens=False).ids if t else []) for d, t, _ in rows)
    assert got == want
    assert byte_bpe.token_ids(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


@needs_vocabulary
def test_pieces_of_any_length_equal_the_public_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(byte_bpe.VOCABULARY)
    encoder = byte_bpe.Encoder(byte_bpe.VOCABULARY)
    rng = random.Random(12)
    words = {"".join(rng.choice("etaoinshrd") for _ in range(rng.randrange(2, 400))) for _ in range(200)}
    words |= {a * n for a in ("a", "ab", "aab", "é", "試験") for n in (2, 3, 7, 64, 501)} | {"".join(rng.choice("acgt") for _ in range(20_000)), "z" * 200_000}
    encoder.learn(words)
    for w in words:
        assert list(array("i", encoder.words[w])) == library.encode(w, add_special_tokens=False).ids


@needs_vocabulary
def test_texts_come_back(spark):
    rows = list(enumerate(ODD)) + [(None, "no id"), (0, "twice")]
    ids = byte_bpe.token_ids(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = byte_bpe.token_texts(ids.selectExpr("ids", "doc_id", "1 AS text")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    odd = spark.createDataFrame([(1, None), (2, []), (3, [-5, 10**8]), (4, [None])], "doc_id bigint, ids array<int>")
    assert {r.doc_id: r.text for r in byte_bpe.token_texts(odd).collect()} == {1: "", 2: "", 3: "", 4: ""}
    assert byte_bpe.token_texts(ids.limit(0)).count() == 0


# ---------------------------------------------------------------- leaked tests
PASSAGE = (
    "During the festival of 1923 some cousin of Curhut counted 761 cracks in the boiler and envy turned into applause while the guild of Droden "
    "drew a careful plan of the old kiln and bet 705 crowns on a größere Wette before the market spoiled all limestone near Holbek"
)
WORDS = PASSAGE.split()
STOCK = "Like reference signs denote like or similar elements throughout the drawings and a repeated description of them is left out for the sake of brevity"
ITEMS = [(1, PASSAGE + "\nQuestion: Who paid?", "x"), (2, PASSAGE + "\nQuestion: Who was asked?", None), (3, "Other words entirely fill this one. " + STOCK + ". And more.", None), (4, None, None), (5, "", "y")]


def changed(words, *places):
    return " ".join("something" if i in places else w for i, w in enumerate(words))


CASES = [
    ("x " + " ".join(WORDS[3:18]) + " y", {1, 2}),
    ("x " + " ".join(WORDS[3:17]) + " y", set()),
    ("x " + changed(WORDS[2:18], 7) + " y", {1, 2}),
    ("x " + changed(WORDS[2:17], 4, 9) + " y", set()),
    ("x " + changed(WORDS[2:24], 6, 14) + " y", {1, 2}),
    ("x " + changed(WORDS[2:30], 3, 7, 11, 15, 19, 23) + " y", set()),
    (" ".join(WORDS[5:13]) + " extra " + " ".join(WORDS[13:22]), {1, 2}),
    (" ".join(WORDS[5:13]) + " " + " ".join(WORDS[14:23]), {1, 2}),
    (" ".join(WORDS[30:]).upper(), {1, 2} if len(WORDS[30:]) >= 15 else set()),
    ("  ".join(WORDS[5:22]).replace("cracks", "cra-\ncks").replace("turned", "tur\nned"), {1, 2}),
    ("<p>" + " ".join(f"<b>{w}</b>" if i % 3 == 0 else w + ",&nbsp;" for i, w in enumerate(WORDS[22:45])) + "</p>", {1, 2}),
    (STOCK, set()), ("", set()), (None, set()), (" ", set()),
    (" ".join(reversed(WORDS)), set()),
    (" ".join(WORDS[26:]).replace("größere", "größere"), {1, 2}),
]


def test_leaks(spark):
    docs = spark.createDataFrame([(i, t, 7) for i, (t, _) in enumerate(CASES)] + [(0, CASES[0][0], 8)], "doc_id bigint, text string, item_id bigint")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string, answer string")
    stock = spark.createDataFrame([(STOCK,), (None,), ("",)], "text string")
    rows = leakage.leaks(docs, items, stock).collect()
    got = defaultdict(set)
    for r in rows:
        got[r.doc_id].add(r.item_id)
        text = CASES[r.doc_id][0]
        assert len(leakage.words_of(text[r.start_at : r.end_at])) >= 14
    for i, (t, want) in enumerate(CASES):
        assert got[i] == want, t
    assert sum(r.doc_id == 0 for r in rows) == 4
    assert leakage.leaks(docs.limit(0), items, stock).count() == 0
    assert leakage.leaks(docs, items.limit(0), stock).count() == 0
    assert leakage.leaks(docs, items.drop("answer"), stock).count() == len(rows)
    split = leakage.leaks(docs, items, stock, most_item_chars=max(len(t or "") + 1 for _, t, _ in ITEMS))
    assert split.rdd.getNumPartitions() > docs.rdd.getNumPartitions() and sorted(split.collect(), key=str) == sorted(rows, key=str)
    with pytest.raises(ValueError):
        leakage.leaks(docs, items, stock, most_item_chars=10)
    with pytest.raises(ValueError):
        leakage.leaks(docs, items.limit(0), stock, most_item_chars=10)


def test_answers_are_reported_with_their_case(spark):
    items = spark.createDataFrame([(1, PASSAGE, "the Lathe"), (2, PASSAGE, "Nobody"), (3, "Short text", "lathe")], "item_id bigint, text string, answer string")
    docs = spark.createDataFrame([(1, "The\n<b>lathe</b>. " + PASSAGE), (2, PASSAGE + " bathe lathes"), (3, "the lathe")], "doc_id bigint, text string")
    stock = spark.createDataFrame([], "text string")
    got = {(r.doc_id, r.item_id): (r.answer_at, r.answer_end) for r in leakage.leaks(docs, items, stock).collect()}
    assert got == {(1, 1): (0, 12), (1, 2): (None, None), (2, 1): (None, None), (2, 2): (None, None)}


def brute_force(item, counts, doc):
    """Whether any stretch of the item is aligned with the doc within the edit rate, by dynamic programming from every
    pair of equal words: most counting words had for each number of edits."""
    n, m = len(item), len(doc)
    for i0 in range(n):
        for j0 in range(m):
            if item[i0] != doc[j0]:
                continue
            best = {(i0 + 1, j0 + 1): {0: counts[i0]}}
            for i in range(i0 + 1, n + 1):
                for j in range(max(j0 + 1, i - i0 + j0 - 4), min(m, i - i0 + j0 + 4) + 1):
                    for e, got in list(best.get((i, j), {}).items()):
                        steps = []
                        if i < n and j < m:
                            steps.append((i + 1, j + 1, e + (item[i] != doc[j]), got + counts[i], item[i] == doc[j]))
                        if i < n:
                            steps.append((i + 1, j, e + 1, got + counts[i], False))
                        if j < m:
                            steps.append((i, j + 1, e + 1, got, False))
                        for a, b, f, g, same in steps:
                            if f > 3:
                                continue
                            if same and g >= max(15, 10 * f):
                                return True
                            d = best.setdefault((a, b), {})
                            if d.get(f, -1) < g:
                                d[f] = g
    return False


def test_random_edits_against_brute_force():
    rng = random.Random(18)
    stock = [f"s{i:02}" for i in range(9)]
    item = [f"w{i:02}" for i in range(16)] + stock + [f"w{i:02}" for i in range(16, 40)]
    parted = [w for i in range(0, 20, 4) for w in [f"v{j:02}" for j in range(i, i + 4)] + stock[:3]]
    for words, phrase in ((item, stock), (parted, stock[:3])):
        items = leakage.items_of([" ".join(words)], [" ".join(phrase)])
        scanner = leakage.Scanner(items)
        seen = [0, 0]
        for _ in range(400):
            a = rng.randrange(len(words) - 14)
            doc = words[a : a + rng.randrange(15, 40)]
            for _ in range(rng.randrange(5)):
                at = rng.randrange(len(doc))
                way = rng.choice(["same length", "changed", "out", "in"])
                doc[at : at + 1] = {"same length": ["zzz"], "changed": ["another"], "out": [], "in": [doc[at], "more"]}[way]
            want = brute_force(words, items[0].counts, doc)
            seen[want] += 1
            assert bool(scanner.cases(" ".join(doc))) == want, doc
        assert min(seen) > 10


def test_equal_length_changes_before_a_verbatim_rest():
    words = [f"w{i:02}" for i in range(34)]
    doc = words[:5] + ["zzz"] * 10 + words[15:]
    assert set(leakage.Scanner(leakage.items_of([" ".join(words)], [])).cases(" ".join(doc))) == {0}


def test_a_clean_rest_after_a_noisy_beginning_on_one_diagonal():
    item = [f"w{i:03}" for i in range(61)]
    doc = [w[:-1] + "x" if i in (4, 8, 12) else w for i, w in enumerate(item)]
    scanner = leakage.Scanner(leakage.items_of([" ".join(item)], []))
    assert set(scanner.cases(" ".join(doc))) == {0}
    assert set(scanner.cases(" ".join(doc[:23]))) == set()
    assert set(scanner.cases(" ".join(doc[:24]))) == {0}


def is_case(n, edits):
    """By the definition: a stretch between unchanged words of at least 15 words and of ten an edit."""
    clean = [i for i in range(n) if i not in edits]
    return any(b - a + 1 >= max(15, 10 * sum(a < e < b for e in edits)) for a in clean for b in clean if a <= b)


@pytest.mark.parametrize("way", ["changed", "left out"])
def test_all_places_of_edits_against_the_definition(way):
    scanners = {n: leakage.Scanner(leakage.items_of([" ".join(f"w{i:03}" for i in range(n))], [])) for n in (30, 40, 50)}
    rng = random.Random(16)
    places = [(30, p) for e in range(4) for p in combinations(range(30), e)]
    places += [(n, p) for n, e in ((40, 4), (50, 5)) for p in (sorted(rng.sample(range(n), e)) for _ in range(300))]
    places += [(40, range(a, a + 4)) for a in range(37)]
    for n, p in places:
        gone = "" if way == "left out" else "something"
        doc = " ".join(gone if i in p else f"w{i:03}" for i in range(n))
        assert bool(scanners[n].cases(doc)) == is_case(n, p), (n, tuple(p))


def test_offsets_follow_the_stream():
    rng = random.Random(13)
    parts = ["word", "<b>", "</b>", "&amp;", "&auml;x", "ﬁn", "é", "é", "İ", "ß", "-\n", " ", "٣", "日", "\\textit ", "<no", "½"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(20))
        assert len(leakage.stream_offsets(text)) == len("".join(leakage.words_of(text))), text


# ---------------------------------------------------------------- quality
PROSE = [
    "The mirror (16) is inserted on the spherical mirror and can be moved relative to the duct (44).\nA further valve is provided in the housing.",
    "1. A method of aligning with a crusher, comprising the steps of coating a membrane, and sealing the inlet.\n2. Use of the crusher according to claim 1 for sealing in mining.",
    "Der Fachmann erkennt, dass der seitliche Ring auch in einem Hebel befestigt sein kann.",
    "De préférence, le support est en quartz et son épaisseur est de 0.61 µm.",
    "试验表明，与玻璃相比，过热降低了百分之200。图中示出了搅拌器的剖视图。",
]
JUNK = [
    "Download\nContact\nLanguage\nFull text (88)\nLogin (215)", "=====  =====  =====  =====", "1\t1500\tbronze\n2\tn.d.\t11\n3\t71\t24",
    "nozzle, of the condenser, 62; spindle, for a tensioner, 82; hinge, of the mixer, 83, 49, 88", "rotor of the burner\tmade of bronze\t7.5 mm\tto be tested",
    "ilbitxl vknop enbrbvtb ijcupwfu. ujwapoent, krntaao, optezu jimhobpe.", "10-喷嘴玻璃\n转子(12)\n14 法兰\n16-转轴", "=*.□■|1!:□`\\~□¦�\\:~6,1c`b{z", "QX 7764627 A 4.7.1994 OTHMAR\nZR 5428391 A 26.5.1998",
]


REPEATED = ["Insert the form at this place\n" * 20, "".join(f"Dieses Blatt ist ohne Inhalt {i}\n" for i in range(30)), "Voir la planche à la fin.\n" * 25, "本页没有内容，请看下一页。\n" * 20]
_A, _B = "wheel lamp handle tray knob hook".split(), "boat shed cart mill press clock".split()
PHRASES = [
    "\n".join(f"– the {a} of the {b} or its {a}" for a in _A for b in _B),
    "\n".join(f"das {a} in dem {b} und der {a}" for a in "Rad Licht Brett Tuch Glas".split() for b in "Boot Haus Werk Zelt".split()),
    "\n".join(f"* la {a} dans le {b} pour une {a}" for a in "roue lampe table".split() for b in "bateau moulin four pont".split()),
    "\n".join(f"{a}的{b}和其{a}" for a in "轮灯盘钩" for b in "船车磨钟"),
]
OTHER = [
    "El molino del pueblo lleva agua a la casa. En el fondo de la casa hay un horno que no se usa. El agua que sale de la casa va a la huerta de la plaza.",
    "el molino del pueblo\nla casa del agua\nun horno en la casa\nla huerta de la plaza\nel agua de la fuente\nla puerta de la casa",
]
UNSTOPPED = (
    "as the lamp is lit by the boat the keeper who came from the mill in spring walks along the wall and sees that none of the doors which "
    "were open before noon has been shut again while those near the shed stay as they were when he left for the town"
)


def test_statistics():
    s = dict(zip(("lang", *quality.STATISTICS), quality.statistics("The cat is on\na mat.\n\n  \nx9 %%")))
    assert s["lang"] == "en" and s["word_count"] == 7 and s["mean_word_length"] == pytest.approx(16 / 7)
    assert s["symbol_ratio"] == pytest.approx(3 / 19) and s["line_punct_share"] == pytest.approx(1 / 3) and s["common_word_share"] == pytest.approx(3 / 7)
    assert s["sentence_share"] == 0 and s["distinct_line_share"] == 1 and s["words_a_line"] == pytest.approx(7 / 3)
    s = dict(zip(("lang", *quality.STATISTICS), quality.statistics("The cat is on my mat for the day.\nPage 1\nPage 20\nPage 300")))
    assert s["sentence_share"] == pytest.approx(25 / 43) and s["distinct_line_share"] == 0.5
    assert quality.statistics(None) is quality.statistics("") is quality.statistics(" \n\xa0") is None
    assert quality.statistics("!" * 1000)[1:3] == (0, 0.0)
    assert quality.statistics("The mill is at the end of the way. " * 30_000)[6] < 0.01


@pytest.mark.parametrize("han", ["", "一𠀀的"])
def test_words_lines_and_characters_of_odd_texts(han):
    odd = [*"aéßКï7²١_.!?-«»,;\t\r\n \xa0\x85\u3000", "the ", "of 12, ", "\n\n", "\u2028", *han]
    rng = random.Random(2)
    for _ in range(500):
        text = "".join(rng.choice(odd) for _ in range(rng.choice([1, 4, 40, 200])))
        got = quality.statistics(text)
        dense = [c for c in text if not c.isspace()]
        if not dense:
            assert got is None
            continue
        words = quality._TOKEN.findall(text.lower())
        lines = [x for x in (re.sub("[0-9]+", "0", x).strip() for x in text.lower().split("\n")) if x]
        chars = sum(map(len, words))
        want = (len(words), chars / len(words) if words else 0, max(0, len(dense) - chars) / len(dense), len(set(lines)) / len(lines), len(words) / len(lines))
        assert (*got[1:4], *got[7:]) == pytest.approx(want), text


def test_statistics_take_little_time_a_character():
    import time

    def taken(f):
        began = time.thread_time()
        f()
        return time.thread_time() - began

    words = "the of and a wheel “axle” frame über façade holds turns 12 3.5 device coupling, thereof (see fig) is in".split()
    rng = random.Random(3)
    texts = [". ".join(" ".join(rng.choice(words) for _ in range(rng.randrange(20, 50))) for _ in range(12)) + ".\n" for _ in range(100)]
    rounds = [[taken(lambda: [f(x) for x in texts]) for f in (quality.statistics, quality._TOKEN.findall)] for _ in range(9)]
    spent, words_alone = map(min, zip(*rounds))
    assert spent < 2.8 * words_alone  # of finding the words by the pattern, which was a part of the work that took 4.3 times as long


@pytest.mark.parametrize("text", [*PROSE, *PROSE[:1] * 2, UNSTOPPED, OTHER[0], "\n".join(PROSE), "<p>" + PROSE[2] + "<br>\n" + PROSE[3]])
def test_prose(text):
    assert quality.statistics(text)[6] > 0.5


@pytest.mark.parametrize("text", [*JUNK, *REPEATED, *PHRASES, OTHER[1], "x" * 100_000, "QmFzZTY0IHRleHQ/" * 40 + "\nThe lamp is lit by the keeper of the boat."])
def test_junk(text):
    assert quality.statistics(text)[6] < 0.5


def test_no_prose(spark):
    texts = PROSE * 12 + JUNK[:3] + [None, "", "  "]
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else None, 0.5) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, score double")
    found = {r.doc_id for r in quality.no_prose(docs).collect()}
    assert found == {60, 61, 62}
    assert quality.no_prose(docs.limit(0)).count() == 0
    assert quality.no_prose(docs.filter("text is null")).count() == 0
    assert quality.no_prose(docs.drop("lang").filter("doc_id >= 40")).count() == 3


def test_scores_explain_what_is_found(spark):
    rng = random.Random(17)
    nouns = [f"{a}{b}" for a in ("lamp", "boat", "mill", "cart", "clock") for b in ("", "s", "house", "yard")]
    say = ["The {} is at the end of the {}.", "It is known to use a {} with the {} in it.", "If the {} is shut, the {} stays open."]
    texts = [" ".join(rng.choice(say).format(rng.choice(nouns), rng.choice(nouns)) for _ in range(rng.randrange(4, 30))) for _ in range(120)]
    junk = [*REPEATED, *PHRASES, *JUNK]
    docs = spark.createDataFrame(list(enumerate(texts + junk * 3)), "doc_id bigint, text string")
    scores = {r.doc_id: r for r in quality.outlier_scores(docs).collect()}
    found = {r.doc_id for r in quality.no_prose(docs).collect()}
    assert found == set(range(120, 120 + 3 * len(junk))) == {i for i, r in scores.items() if r.rank <= quality.OUTLIER_RANK and r.sentence_share < quality.PROSE_SHARE}
    assert min(scores[i].score for i in found) > sorted(scores[i].score for i in range(120))[-6]


@pytest.mark.parametrize("texts", [PROSE[:2] + [JUNK[0]] * 8, PROSE[:1] + JUNK[:3] * 2, [JUNK[6]], [JUNK[1]] * 2], ids=["copied", "most", "single", "equal"])
def test_no_prose_does_not_depend_on_the_other_texts(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id for r in quality.no_prose(docs).collect()} == {i for i, t in enumerate(texts) if t in JUNK}


def test_tail_probabilities_are_exact(spark):
    from graphloom.scratch import Scratch

    rng = random.Random(14)
    rows = [(rng.randrange(2), rng.choice(["en", "de"]), rng.choice([0.0, 0.5, 0.5, rng.random()]), rng.random() < 0.7) for _ in range(500)]
    groups = defaultdict(list)
    for s, lang, v, counts in rows:
        if counts:
            groups[s, lang].append(v)
    out = quality.tail_probabilities(spark.createDataFrame(rows, "stat int, lang string, value double, counts boolean"), Scratch(spark, "t")).collect()
    assert len(out) == len({r[:3] for r in rows})
    for r in out:
        vs = groups[r.stat, r.lang]
        assert (r.at_most, r.at_least, r.total) == (sum(v <= r.value for v in vs), sum(v >= r.value for v in vs), len(vs))
