"""Hierarchical packing of documents into sequences of several context sizes.

Documents are cut into whole longest windows and a rest; the rest goes to the smallest tier that
holds it. Tiers are packed from the longest down: a rest opens a window of its tier, and the gap
is filled with the largest pieces of shorter tiers that fit; where none fits, one is cut. So all
windows are full; the last few ids of a task make windows of smaller powers of two. Windows of one tier are then dealt into step groups of
equal tokens, those with long pieces (costly attention) spread evenly.

A task packs the documents it reads, `BUFFER_TOKENS` at a time; nothing is shuffled.
"""

from __future__ import annotations

import base64
import functools
from bisect import bisect_right, insort
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIERS = (256, 512, 1024, 2048)
STEP_TOKENS = 65_536
BUFFER_TOKENS = 4_000_000
END_ID = 1
#: Bits of a sequence id that number the sequences of a task.
_TASK_BITS = 36


@dataclass(frozen=True)
class Vocabulary:
    """Where a tokenizer's merge ranks lie, its splitting pattern and its special tokens.

    `whole` is its tokenizers file, for texts that tiktoken refuses: its pattern search gives up on
    a run of about a million spaces or line ends. Both give the same ids. Files are opened in the
    tasks, by a path that every executor has.
    """

    path: str
    pattern: str
    whole: str
    special: tuple[tuple[str, int], ...] = ()

    def encode(self, text: str) -> np.ndarray:
        allowed = "all" if self.special else set()
        try:
            found = _encoding(self).encode(text, allowed_special=allowed, disallowed_special=())
        except ValueError:
            found = _tokenizer(self.whole).encode(text, add_special_tokens=False).ids
        return np.array(found, dtype=np.uint32)


@functools.cache
def _encoding(vocabulary: Vocabulary):
    import tiktoken

    with open(vocabulary.path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "packing",
        pat_str=vocabulary.pattern,
        mergeable_ranks=ranks,
        special_tokens=dict(vocabulary.special),
    )


@functools.cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_bpe_50k() -> Vocabulary:
    """The public byte-level vocabulary; its ranks give the same ids as its tokenizers file."""
    import public_tokenizers

    ranks, whole = (str(public_tokenizers.path(f"byte_bpe_50k.{kind}")) for kind in ("tiktoken", "json"))
    return Vocabulary(ranks, public_tokenizers.PATTERN, whole, (("<|endoftext|>", 50256),))


@dataclass(order=True, frozen=True)
class Piece:
    """`length` ids of a document from `start` on."""

    length: int
    order: int
    start: int
    doc: tuple = field(compare=False)  # (id, ids)

    def cut(self, length: int) -> tuple[Piece, Piece]:
        rest = Piece(self.length - length, self.order, self.start + length, self.doc)
        return Piece(length, self.order, self.start, self.doc), rest


def pack(pieces: Sequence[Piece], tiers: Sequence[int] = TIERS) -> tuple[list, list[Piece]]:
    """(windows as (tier, pieces), leftover pieces); the windows are full.

    The leftover is less than one shortest window.
    """
    longest = tiers[-1]
    windows: list[tuple[int, list[Piece]]] = []
    pool: list[Piece] = []
    for piece in pieces:
        while piece.length >= longest:
            head, piece = piece.cut(longest)
            windows.append((longest, [head]))
        if piece.length:
            insort(pool, piece)
    left = sum(p.length for p in pool)
    for at in range(len(tiers) - 1, -1, -1):
        tier, below = tiers[at], tiers[at - 1] if at else 0
        while pool and pool[-1].length > below and left >= tier:
            first = pool.pop()
            if first.length > tier:  # the longer tier could no longer be filled
                first, rest = first.cut(tier)
                insort(pool, rest)
            window, gap = [first], tier - first.length
            while gap:
                fits = bisect_right(pool, gap, key=lambda p: p.length)
                if fits:
                    piece = pool.pop(fits - 1)
                else:
                    piece, rest = pool.pop(0).cut(gap)
                    insort(pool, rest)
                window.append(piece)
                gap -= piece.length
            windows.append((tier, window))
            left -= tier
    return windows, pool


def tail(pieces: list[Piece]) -> list[tuple[int, list[Piece]]]:
    """The rest of a task in windows of smaller and smaller powers of two."""
    left, pieces, windows = sum(p.length for p in pieces), list(pieces), []
    while left:
        size = gap = 1 << (left.bit_length() - 1)
        window = []
        while gap:
            piece = pieces.pop()
            if piece.length > gap:
                piece, rest = piece.cut(gap)
                pieces.append(rest)
            window.append(piece)
            gap -= piece.length
        windows.append((size, window))
        left -= size
    return windows


def balanced(windows: list[list[Piece]], groups: int) -> Iterator[list[list[Piece]]]:
    """The windows in `groups` of equal number, costly ones dealt to and fro."""
    cost = lambda w: (-sum(p.length**2 for p in w), w[0].order, w[0].start)
    dealt: list[list] = [[] for _ in range(groups)]
    for i, window in enumerate(sorted(windows, key=cost)):
        lap, at = divmod(i, groups)
        dealt[groups - 1 - at if lap % 2 else at].append(window)
    yield from dealt


class _Task:
    """Numbers the sequences and steps of one task and turns them into Arrow batches."""

    def __init__(self, tiers: Sequence[int], step_tokens: int, kind: pa.DataType) -> None:
        self.tiers, self.step_tokens, self.kind = tiers, step_tokens, kind
        self.next_sequence = self.next_step = TaskContext.get().partitionId() << _TASK_BITS
        self.waiting: dict[int, list] = {t: [] for t in tiers}

    def add(self, windows, last: bool = False) -> Iterator[pa.RecordBatch]:
        for tier, window in windows:
            self.waiting.setdefault(tier, []).append(window)
        for tier, held in self.waiting.items():
            size = max(1, self.step_tokens // tier)
            groups = len(held) // size
            if groups:
                yield from self.emit(tier, balanced(held[: groups * size], groups))
            self.waiting[tier] = held[groups * size :]
            if last and self.waiting[tier]:
                yield from self.emit(tier, [self.waiting[tier]])

    def emit(self, tier: int, steps) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for step in steps:
            for window in step:
                offset = 0
                for p in window:
                    doc_id, ids = p.doc
                    data = ids[p.start : p.start + p.length].astype("<u4").tobytes()
                    rows.append(
                        (doc_id, p.start, p.length, data, len(ids), self.next_sequence, offset, tier, self.next_step)
                    )
                    offset += p.length
                self.next_sequence += 1
            self.next_step += 1
            if len(rows) > 1000:
                yield self.batch(rows)
                rows = []
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = [self.kind, *[pa.int64()] * 2, pa.binary(), *[pa.int64()] * 5]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, _NAMES)


_NAMES = "doc_id start length ids doc_tokens sequence_id offset tier step_id".split()


def pack_documents(
    docs: DataFrame,
    vocabulary: Vocabulary,
    tiers: Sequence[int] = TIERS,
    step_tokens: int = STEP_TOKENS,
    buffer_tokens: int = BUFFER_TOKENS,
    end_id: int = END_ID,
) -> DataFrame:
    """Pieces: doc_id, start, length, ids, doc_tokens, sequence_id, offset, tier, step_id.

    `ids` are little-endian unsigned 32-bit numbers. Every document ends with `end_id`, so null
    and empty texts are documents of one id. Repeated rows are packed as often as they occur, null
    ids stay null, an empty table gives no piece, and only doc_id and text are read. A sequence is
    as long as its tier; those of the end of a task have smaller powers of two as their tiers.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, tokens, order = None, [], 0, 0
        for batch in batches:
            task = task or _Task(tiers, step_tokens, batch.schema.field(0).type)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(vocabulary.encode(text), np.uint32(end_id))
                held.append(Piece(len(ids), order, 0, (doc_id, ids)))
                tokens, order = tokens + len(ids), order + 1
                if tokens >= buffer_tokens:
                    windows, held = pack(held, tiers)
                    tokens = sum(p.length for p in held)
                    yield from task.add(windows)
        if task:
            windows, held = pack(held, tiers)
            yield from task.add(windows + tail(held), last=True)

    schema = (
        f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, "
        "sequence_id long, offset long, tier long, step_id long"
    )
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)
