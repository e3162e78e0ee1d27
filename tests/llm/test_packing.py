from __future__ import annotations

import random

import numpy as np
import pytest

from tabloom.llm import packing
from tabloom.llm.packing import Piece
from tests.llm.odd import dicts, documents, no_documents, odd_documents, prose

public_tokenizers = pytest.importorskip("public_tokenizers")


def expected_ids(text):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    return [*encoder.encode(text or "", add_special_tokens=False).ids, 1]


def verify(rows, docs):
    """Every id is in one piece, sequences have no gaps, and lengths are powers of two."""
    got, sequences = {}, {}
    for r in rows:
        ids = np.frombuffer(r["ids"], dtype="<u4").tolist()
        assert len(ids) == r["length"] > 0
        got.setdefault(r["doc_id"], []).append((r["start"], ids, r["doc_tokens"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["tier"]))
    for doc_id, texts in docs.items():
        whole = sorted(expected_ids(t) for t in texts)
        if len(texts) == 1:
            pieces = sorted(got[doc_id])
            assert [i for _, ids, _ in pieces for i in ids] == whole[0]
            assert {n for _, _, n in pieces} == {len(whole[0])}
        assert sum(len(ids) for _, ids, _ in got[doc_id]) == sum(map(len, whole))
    for parts in sequences.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at == parts[0][2] and at & (at - 1) == 0 and at <= 2048
    return sequences


def test_round_trip(spark):
    texts = [" ".join(prose(i, random.Random(i).choice([0, 3, 40, 200, 900, 4000]))) for i in range(60)]
    texts += ["<|endoftext|> it's  \n\n 1234 ünïcode 漢字 🙂  　x", "a" * 5000, " " * 3000]
    docs = documents(spark, texts).repartition(3)
    rows = dicts(packing.pack_documents(docs, packing.byte_bpe_50k(), buffer_tokens=20_000))
    sequences = verify(rows, {i: [t] for i, t in enumerate(texts)})
    lengths = [sum(n for _, n, _ in parts) for parts in sequences.values()]
    assert {256, 512, 1024, 2048} <= set(lengths)


def test_very_long_blank_runs(spark):
    texts = [" " * 2_000_000, "a <|endoftext|>" + " \n" * 1_000_000 + "ü end", "\n" * 2_000_000, "short"]
    rows = dicts(packing.pack_documents(documents(spark, texts), packing.byte_bpe_50k()))
    verify(rows, {i: [t] for i, t in enumerate(texts)})


def test_odd_rows_and_empty_table(spark):
    docs = odd_documents(spark)
    texts = {}
    for r in dicts(docs):
        texts.setdefault(r["doc_id"], []).append(r["text"])
    verify(dicts(packing.pack_documents(docs, packing.byte_bpe_50k())), texts)
    assert dicts(packing.pack_documents(no_documents(spark), packing.byte_bpe_50k())) == []


def pieces(lengths):
    return [Piece(n, i, 0, (i, None)) for i, n in enumerate(lengths)]


@pytest.mark.parametrize("seed", range(5))
def test_windows_are_full_and_lose_nothing(seed):
    pick = random.Random(seed)
    own = pieces([pick.randrange(1, pick.choice([30, 300, 3000, 9000])) for _ in range(200)])
    windows, left = packing.pack(own)
    assert all(sum(p.length for p in w) == tier for tier, w in windows)
    assert sum(p.length for p in left) < 256
    ends = packing.tail(left)
    covered = sorted((p.order, p.start, p.length) for _, w in [*windows, *ends] for p in w)
    at = {}
    for order, start, length in covered:
        assert start == at.get(order, 0)
        at[order] = start + length
    assert at == {p.order: p.length for p in own}


def test_routes_by_length_and_fills_from_shorter_tiers():
    windows, left = packing.pack(pieces([1500, 548, 600, 424, 300, 212, 200, 56]))
    assert [(t, [p.length for p in w]) for t, w in windows] == [
        (2048, [1500, 548]), (1024, [600, 424]), (512, [300, 212]), (256, [200, 56])
    ]
    assert left == []


def test_step_groups_have_equal_size_and_even_cost():
    windows = [pieces([2048])] * 8 + [pieces([64] * 32)] * 8
    groups = list(packing.balanced(windows, 4))
    assert [len(g) for g in groups] == [4] * 4
    costs = [sum(p.length**2 for w in g for p in w) for g in groups]
    assert max(costs) == min(costs)


def test_steps_hold_equal_tokens(spark):
    docs = documents(spark, [" ".join(prose(i, 700)) for i in range(60)]).coalesce(1)
    rows = dicts(packing.pack_documents(docs, packing.byte_bpe_50k(), step_tokens=8192))
    steps = {}
    for r in rows:
        steps.setdefault(r["step_id"], []).append((r["tier"], r["length"]))
    sizes = [sum(n for _, n in s) for s in steps.values()]
    assert all(len({t for t, _ in s}) == 1 for s in steps.values())
    assert sizes.count(8192) >= len(sizes) - 12 and max(sizes) == 8192
