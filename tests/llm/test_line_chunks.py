from __future__ import annotations

import random

import pytest

from tabloom.llm import line_chunks
from tests.llm.odd import dicts, documents, no_documents, odd_documents


def brute(rows):
    """(doc_id, text) -> doc_id, n_lines, n_removed, text; repeated rows are one document."""
    seen, out = {}, []
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    left = {}
    for doc_id, text in order:
        lines = (text or "").split("\n")
        keep, gone = [], 0
        for start, end in line_chunks.chunks(lines):
            chunk = tuple(lines[start:end])
            if end - start > 1 and chunk in seen:
                gone += end - start
            else:
                seen.setdefault(chunk, doc_id)
                keep += chunk
        left[doc_id, text] = (doc_id, len(lines), gone, "\n".join(keep))
    out = [left[r] for r in rows]
    return sorted(out, key=str)


def found(docs, area):
    rows = dicts(line_chunks.dedup_lines(docs, area))
    return sorted(((r["doc_id"], r["n_lines"], r["n_removed"], r["text"]) for r in rows), key=str)


def shared_texts(seed: int, count: int = 60) -> list[str]:
    pick = random.Random(seed)
    passages = [[f"passage {p} line {i}" for i in range(pick.randrange(2, 9))] for p in range(4)]
    texts = []
    for d in range(count):
        lines = [f"own {d} {i}" for i in range(pick.randrange(6))]
        at = pick.randrange(len(lines) + 1)
        lines[at:at] = pick.choice(passages) if d % 3 else ["again", "again", "again", "again"]
        texts.append("\n".join(lines))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, area, seed):
    texts = shared_texts(seed)
    result = found(documents(spark, texts).repartition(4), area)
    assert result == brute(list(enumerate(texts)))
    assert any(r[2] for r in result)


def test_boundaries_resist_shifts():
    lines = [f"line {i}" for i in range(200)]
    whole = {tuple(lines[a:b]) for a, b in line_chunks.chunks(lines)}
    moved = ["new"] + lines
    shifted = {tuple(moved[a:b]) for a, b in line_chunks.chunks(moved)}
    assert len(whole - shifted) <= 2


def test_equal_digests_are_told_apart_by_bytes(spark, area, monkeypatch):
    class Same:
        def __init__(self, *_, **__): ...

        def digest(self):
            return b"0" * 16

    monkeypatch.setattr(line_chunks, "blake2b", Same)
    texts = shared_texts(5, 20)
    assert found(documents(spark, texts).coalesce(1), area) == brute(list(enumerate(texts)))


def test_odd_rows_and_empty_table(spark, area):
    docs = odd_documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in dicts(docs)]
    assert [r[0] for r in found(docs, area)] == [r[0] for r in brute(rows)]
    assert found(no_documents(spark), area) == []


def test_no_chunk_is_shorter_than_asked_unless_its_text_is():
    for seed in range(60):
        pick = random.Random(seed)
        lines = [f"line {pick.randrange(9)}" for _ in range(pick.randrange(1, 40))]
        for least in (1, 2, 3, 5):
            spans = line_chunks.chunks(lines, least_lines=least)
            assert [a for a, _ in spans] == [0, *(b for _, b in spans[:-1])] and spans[-1][1] == len(lines)
            assert all(b - a >= least for a, b in spans) or len(spans) == 1


def test_a_later_copy_of_a_text_goes_whole(spark, area):
    """Exact copies of texts of two lines or more lose all their lines."""
    texts = shared_texts(8, 30)
    rows = found(documents(spark, texts + texts), area)
    for doc_id, n_lines, n_removed, _ in rows:
        if doc_id >= len(texts) and n_lines > 1:
            assert n_removed == n_lines
