"""Collocations against plain counting."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from tabloom.llm import collocations
from tabloom.llm.collocations import mine_collocations, parse_texts
from tests.llm.odd import no_documents, odd_documents

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def plain(rows, least, per_lang=2000):
    """Every phrase counted one by one, exact integers throughout."""
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, 6):
                for at in range(len(words) - size + 1):
                    counts[lang, tuple(words[at : at + size])] += 1
    frequent = {key: a for key, a in counts.items() if a >= least and len(key[1]) > 1}
    longest_inside = Counter()
    for (lang, words), f in frequent.items():
        for size in range(2, len(words)):
            for at in range(len(words) - size + 1):
                key = lang, words[at : at + size]
                longest_inside[key] = max(longest_inside[key], f)
    found = []
    for (lang, phrase), a in frequent.items():
        if longest_inside[lang, phrase] and 100 * longest_inside[lang, phrase] >= 100 * a:
            continue
        n = totals[lang]
        cuts = []
        for k in range(1, len(phrase)):
            l, r = counts[lang, phrase[:k]], counts[lang, phrase[k:]]
            cuts.append((1000 * a * n // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        found.append((lang, " ".join(phrase), a, l, r, n, score))
    out = []
    for lang in {row[0] for row in found}:
        rows = sorted((r for r in found if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(lang, i + 1, *row[1:]) for i, row in enumerate(rows[:per_lang])]
    return sorted(out)


def mined(spark, area, rows, least, **settings):
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    return sorted(map(tuple, mine_collocations(docs, area, least=least, **settings).select(*COLUMNS).collect()))


def texts(seed, count):
    pick = random.Random(seed)
    words = [*"abcdefgh", "Ä", "the", "THE", "\0", "\1", "\2", "a\1", "b\0c"]
    gaps = [" ", "  ", "\t", " ", " ", ", ", ".", "\n", "\r\n", ";"]
    out = ["".join(pick.choice(words) + pick.choice(gaps) for _ in range(pick.randrange(60))) for _ in range(count)]
    return out + out[: count // 3]


def test_counts_every_phrase_as_plain_counting_does(spark, area):
    pick = random.Random(5)
    rows = [(text, pick.choice(["en", "en", "d\0e", None, "und", ""])) for text in texts(1, 250)]
    found = mined(spark, area, rows, 4)
    assert len(found) > 100
    assert found == plain(rows, 4)


def test_phrases_that_never_end_and_hot_words(spark, area):
    rows = [("x " * 3000, "en"), ("x y " * 800 + "!" + "y x " * 500, "en"), ("x", "en")] * 3
    assert mined(spark, area, rows, 5) == plain(rows, 5)


def test_keeps_the_first_of_a_language_with_ties_by_bytes(spark, area):
    rows = [("b c", "en"), ("a d", "en"), ("Z É", "en"), ("é z", "fr")] * 6
    assert mined(spark, area, rows, 6, per_lang=2) == plain(rows, 6, 2)


def test_counts_beyond_64_bits_stay_exact(spark, area):
    big = 3_000_000_000_000
    counted = [("en", "", 0, 9 * big), ("en", "a", 1, big + 7), ("en", "b", 1, big + 1), ("en", "a\0b", 2, big)]
    counts = spark.createDataFrame(counted, "lang string, key string, words int, rows long")
    (row,) = collocations.rank_phrases(counts, area, 5).collect()
    assert row.score == 1000 * big * 9 * big // ((big + 7) * (big + 1))


def test_chunks_hold_every_word_once_before_their_overlap():
    for seed in range(20):
        given = [text.encode() for text in texts(seed, 6)] + [b"", b"word " * 1000]
        docs, chunks = parse_texts(given)
        for number, text in enumerate(given):
            own = [c.split() for c, d in zip(chunks, docs, strict=True) if d == number]
            final = [c.endswith(b"\n") for c, d in zip(chunks, docs, strict=True) if d == number]
            words = [w for part, whole in zip(own, final, strict=True) for w in (part if whole else part[:-4])]
            assert words == re.findall(rb"[^\x20\x09.,;:!?\n-\r]+", text.lower())
            assert final == [False] * (len(own) - 1) + [True] * bool(own)


def test_repeated_passages_share_their_chunks():
    passage = " ".join(f"w{i * i % 97}" for i in range(400)).encode()
    _, chunks = parse_texts([passage, b"one " + passage, b"some other start " + passage + b" and end"])
    assert len(set(chunks)) < len(chunks) / 2


@pytest.mark.parametrize("least", [1, 2, 30])
def test_odd_rows(spark, area, least):
    docs = odd_documents(spark)
    found = mine_collocations(docs, area, least=least, per_lang=50).select(*COLUMNS).collect()
    assert sorted(map(tuple, found)) == plain([(r.text, r.lang) for r in docs.collect()], least, 50)
    assert found if least < 30 else not found


def test_empty_table(spark, area):
    assert mine_collocations(no_documents(spark), area).collect() == []
