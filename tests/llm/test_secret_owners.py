"""Secrets against plain Python over the same rows."""

from __future__ import annotations

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tabloom.llm import secret_owners
from tabloom.llm.secret_owners import KINDS, find_secrets, spans_text
from tests.llm.odd import no_documents, odd_documents

BASE = {
    "assign": r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"()(AKIA[A-Z0-9]+)",
    "hex": r"()([0-9a-f]+)",
}
LEAST = {"assign": 8, "access": 16, "hex": 32}
COLUMNS = "doc_id long, text string, source string, hash string, live string, owner string, row string, digest string"


def plain(rows):
    """Per row: id, spans of all kinds as text, number of examples."""
    tokens, owners, places = [], defaultdict(set), defaultdict(set)
    for doc_id, text, source in rows:
        found = []
        for m in re.finditer("[A-Za-z0-9+_-]{16,}", text or ""):
            word = m[0]
            if re.search("[0-9]", word) and re.search("[A-Za-z]", word) and len(set(word)) >= 8:
                found.append((word, m.start(), m.end()))
                owners[word].add(source)
                places[word].add((source, doc_id if doc_id is not None else f"text {text}"))
        tokens.append(found)
    out = []
    for (doc_id, text, _), found in zip(rows, tokens, strict=True):
        spans = []
        for nth, (kind, pattern) in enumerate(BASE.items()):
            flags = re.ASCII | (re.IGNORECASE if kind == "assign" else 0)
            spans += [(m.start(), nth, m.end()) for m in re.finditer(pattern, text or "", flags) if len(m[2]) >= LEAST[kind]]
        live = [t for t in found if len(owners[t[0]]) == 1 and len(places[t[0]]) <= 8]
        spans += [(start, 3, end) for _, start, end in live]
        examples = sum(len(owners[word]) >= 3 for word, _, _ in found)
        out.append((doc_id, ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans)), examples))
    return sorted(out, key=str)


def found_in(docs, area):
    rows = find_secrets(docs, area)
    text = spans_text({kind: F.col(kind) for kind in KINDS})
    return sorted((tuple(r) for r in rows.select("doc_id", text, "n_example").collect()), key=str)


def checked(spark, area, rows):
    full = [(*row, "h", "l", "o", "r", "d") for row in rows]
    docs = spark.createDataFrame(full, COLUMNS).repartition(4)
    found = found_in(docs, area)
    assert found == plain(rows)
    return found


def token(seed, size=20):
    pick = random.Random(seed)
    return "".join(pick.choice("abcdefghijklmnopqrstuvwxyzABCDEFGH0123456789") for _ in range(size)) + "x7"


def test_spans_of_generated_texts(spark, area):
    pick = random.Random(2)
    parts = [
        "password", "Passwd", "SECRET", "token", "api_key", "APIKEY", "paſſword", "toKen", ":", "=", " ", "  ", "'", '"',
        "short", "longenough1", "a.b/c+d=e", "AKIA", "AKIAABCDEFGHIJKL", "AKIAAKIA0123", "ABC9", "deadbeef", "0123456789abcdef",
        "g", "\n", "é", "🙂", "\0", token(1), token(2), "-", "_",
    ]
    rows = [(i, "".join(pick.choice(parts) for _ in range(pick.randrange(50))), f"s{pick.randrange(4)}") for i in range(500)]
    found = checked(spark, area, rows)
    assert all(any(f"{kind}:" in row[1] for row in found) for kind in KINDS)


def test_a_dropped_match_still_takes_its_place(spark, area):
    rows = [(1, "token: secret: abcdefghij", "s"), (2, "token=key=abcdefgh", "s"), (3, "secret=token=", "s")]
    assert [row[1] for row in checked(spark, area, rows)] == ["", "assign:0:18", ""]


def test_examples_live_tokens_and_those_between(spark, area):
    rows = [(i, f"use {token(5)} here", f"owner{i % 3}") for i in range(30)]  # three owners: an example
    rows += [(100 + i, f"key {token(6)} {token(6)}", "alone") for i in range(8)]  # eight places: live
    rows += [(200 + i, f"{token(7)}", "alone") for i in range(9)]  # nine: neither
    rows += [(300, token(8), "one"), (301, token(8), "two")]  # two owners: neither
    rows += [(400, token(9), None), (401, token(9), None), (None, token(10), None), (None, token(10) + " ", "x")]
    found = dict((row[0], row[1:]) for row in checked(spark, area, rows))
    assert found[3] == ("", 1) and found[100] == ("live:4:26,live:27:49", 0)
    assert found[200] == found[300] == ("", 0) and found[400] == ("live:0:22", 0)


def test_hot_texts_tokens_and_owners(spark, area):
    rows = [(i % 5, f"copied {token(1)} text {token(2)}", "hot") for i in range(3000)]
    rows += [(10_000 + i, f"own {token(100 + i)} and {token(3)}", f"o{i % 7}") for i in range(1500)]
    checked(spark, area, rows)


def test_rows_of_one_text_are_dealt_out(spark, area):
    rows = [(7, f"copied {token(1)}", "hot")] * 2000 + [(i, token(i), "s") for i in range(100, 400)]
    docs = spark.createDataFrame([(*r, "h", "l", "o", "r", "d") for r in rows], COLUMNS)
    found = area.table(secret_owners._matches(docs, "text", "doc_id", "source"), "found")
    joined = secret_owners._join_by_text(found, secret_owners._marks(found, area))
    salts = joined.filter("digest IS NOT NULL").count()
    assert salts == len(rows)
    plan = joined._jdf.queryExecution().toString()
    assert "salt" in plan and "Python" not in plan


def test_very_long_texts(spark, area):
    many = " ".join(f"token={token(i)}" for i in range(12_000))
    rows = [(1, many, "a"), (2, "f" * 2_000_000, "b"), (3, "password" + " " * 1_000_000 + "x", "c"), (4, "Z" * 1_000_000, "d")]
    checked(spark, area, rows)


def test_odd_rows(spark, area):
    docs = odd_documents(spark)
    assert found_in(docs, area) == plain([(r.doc_id, r.text, r.source) for r in docs.collect()])


def test_empty_table(spark, area):
    assert find_secrets(no_documents(spark), area).collect() == []
