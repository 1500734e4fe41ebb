"""Best-fit packing of documents into sequences of several permitted lengths.

Variable-capacity best fit, decreasing: pieces go, longest first, into the open bin that they fill best; where none has room,
a bin of the size with the least cost per token it can still hold is opened; at the end each bin is downsized to the smallest
permitted length that holds its contents. The permitted lengths are optimised jointly: besides the adaptive choice,
each single opening size is tried, and the packing of least total cost stays. The cost of a bin is its length plus a fixed
overhead per sequence.

A document longer than the largest length is cut into full pieces and a rest; all other pieces stay whole.

Defined cases: a null or empty text is one piece of its end id; null and repeated doc_ids are packed like others; an empty table
gives no bin; a piece of exactly a permitted length fills a bin alone. Pieces of equal length are taken in the order in which a task reads them, and
of bins that a piece fills equally well the one that was used last, so which of equal pieces share a bin depends on the order of the rows; the cost doesn't.

Scale: no text is shuffled. Each scan task packs what it reads, in windows of at most `window` pieces, so memory is bounded. Bins
that are full but for `slack` tokens are done; the pieces of all other bins (a few of the last ones of each window) go, as numbers, through a
second round of the same packing, in groups of about a fiftieth of `window` pieces from all tasks, so what is lost at the edges of scan tasks
and windows shrinks to one loose end per group. A bin's id holds its task's or group's number, which a repeated task gives again.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches, task_id
from .tokens import BATCH, default_tokenizer, encoder

LENGTHS, OVERHEAD, WINDOW, SLACK = (512, 1024, 2048, 4096, 8192), 32, 100_000, 8
SCHEMA = "bin_id long, capacity int, position int, doc_id long, piece int, start long, n_tokens int"


def cut(n: int, most: int) -> list[int]:
    """Piece lengths of a document of n tokens."""
    return [most] * (n // most) + ([n % most] if n % most or not n else [])


def fit(n: int, lengths: Sequence[int]) -> int:
    """The smallest permitted length of n or more."""
    return next(c for c in lengths if c >= n)


def _pack(order: list[int], sizes: list[int], lengths: Sequence[int], overhead: int, only: int | None) -> list[list[int]]:
    """Bins as lists of item numbers. only: always open this length where the item fits; else the cheapest per token."""
    left, bins = sum(sizes), []
    open_mask, by_room = 0, {}
    for i in order:
        s = sizes[i]
        mask = open_mask >> s
        if mask:
            room = s + (mask & -mask).bit_length() - 1
            stack = by_room[room]
            b = stack.pop()
            if not stack:
                open_mask &= ~(1 << room)
        else:
            if only and only >= s:
                c = only
            else:
                c = min((c for c in lengths if c >= s), key=lambda c: ((c + overhead) / min(c, left), c))
            b, room = len(bins), c
            bins.append([])
        bins[b].append(i)
        left -= s
        room -= s
        if room:
            by_room.setdefault(room, []).append(b)
            open_mask |= 1 << room
    return bins


def pack(sizes: list[int], lengths: Sequence[int] = LENGTHS, overhead: int = OVERHEAD) -> list[tuple[int, list[int]]]:
    """(capacity, item numbers) of each bin; every size is at least 1 and at most the largest length."""
    lengths = sorted(lengths)
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    best, least = [], None
    for only in (None, *lengths):
        bins = _pack(order, sizes, lengths, overhead, only)
        packed = [(fit(sum(sizes[i] for i in b), lengths), b) for b in bins]
        cost = sum(c + overhead for c, _ in packed)
        if least is None or cost < least:
            best, least = packed, cost
    return best


#: As SCHEMA, and whether the piece's bin has room left.
_SCHEMA = pa.schema([("bin_id", pa.int64()), ("capacity", pa.int32()), ("position", pa.int32()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int32()), ("loose", pa.bool_())])


def _rows(pieces: list[tuple], lengths: Sequence[int], overhead: int, first: int, slack: int) -> tuple[int, pa.RecordBatch]:
    """Number of bins, and the rows of the packed pieces (doc_id, piece, start, n_tokens); bin ids from first on."""
    bins = pack([p[3] for p in pieces], lengths, overhead)
    rows = [(first + b, capacity, at, *pieces[i], loose) for b, (capacity, members) in enumerate(bins) for loose in [capacity - sum(pieces[i][3] for i in members) > slack] for at, i in enumerate(members)]
    return len(bins), pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, lengths: Sequence[int] = LENGTHS, overhead: int = OVERHEAD, window: int = WINDOW, slack: int = SLACK) -> DataFrame:
    """A row for each piece: bin_id, capacity, position in the bin, doc_id, piece, start in the document, n_tokens (end id included)."""
    tokenizer, most = tokenizer or default_tokenizer(), max(lengths)

    def apply(batches):
        first, pieces = task_id() << 32, []
        for batch in batches:
            for a, b in small_batches(batch.column("text"), BATCH):
                _, offsets = encoder(tokenizer).encode(batch.column("text").slice(a, b - a))
                for doc_id, n in zip(batch.column("doc_id").slice(a, b - a).to_pylist(), (np.diff(offsets) + 1).tolist(), strict=True):
                    for k, s in enumerate(cut(n, most)):
                        pieces.append((doc_id, k, k * most, s))
                        if len(pieces) >= window:
                            n_bins, out = _rows(pieces, lengths, overhead, first, slack)
                            yield out
                            first, pieces = first + n_bins, []
        if pieces:
            yield _rows(pieces, lengths, overhead, first, slack)[1]

    def again(table: pa.Table) -> pa.Table:
        (group,) = set(table["group"].to_pylist())
        table = table.sort_by([(c, "ascending") for c in ("n_tokens", "doc_id", "piece", "bin_id", "position")])
        pieces = list(zip(*(table[c].to_pylist() for c in ("doc_id", "piece", "start", "n_tokens")), strict=True))
        return pa.Table.from_batches([_rows(pieces, lengths, overhead, (1 << 62) + (group << 32), slack)[1]])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    packed = materialise(texts.mapInArrow(apply, f"{SCHEMA}, loose boolean"), "packed")
    loose = packed.where("loose")
    groups = max(1, -(-loose.count() // max(2, window // 50)))
    second = loose.withColumn("group", F.pmod(F.xxhash64("bin_id", "position"), F.lit(groups))).groupBy("group").applyInArrow(again, f"{SCHEMA}, loose boolean")
    return packed.where("NOT loose").unionByName(second).drop("loose")
