"""Substring deduplication by relative Lempel-Ziv parsing of documents against indexed reference blocks.

All texts, in the order of their ids, are the reference, cut into blocks of about `block_bytes`. A document is parsed from left to right into
factors: the longest run of words that goes on at the place where its first WINDOW words stand earliest in the reference (an earlier block, or earlier in its own).
A factor shorter than WINDOW words is none. Where a factor ends, the windows over its boundary are looked up on their own, so factors may overlap;
the words in factors are those covered by a window that also starts earlier.

Index. The windows of a block are listed under anchors: a window's anchor is the least hash among its GRAM-word sequences, the same
wherever the window stands. Blocks first exchange their distinct anchors; only windows whose anchor another block holds too go into the index of their block
(window, first place in the block), and each is looked up in the indexes of all blocks by one exchange, which returns its earliest place. So a window costs an exchanged row only where
a sequence of GRAM words near it recurs in another block.

Defined cases: words are maximal runs without ASCII white space, compared byte by byte; a null or empty text has no words and loses none; a null id
comes before all others; rows of equal id are documents of their own, in the order of a hash of their texts and then of the texts, so of equal rows one
stays; texts of under WINDOW words lose nothing; a longer text than a block is a block of its own; an empty table gives an empty result; other columns are not read.

Scale: one exchange of the texts by id range, stored as blocks, and one by block for each of the two passes. A block gives one row for each anchor or window, however
often it repeats there, so a passage that stands in every document gives as many rows as there are blocks. A task holds one block. Windows are
compared by 96 bits of hash (10^13 of them would hold a false pair with a probability of about 1e-3); anchors by 64, where a false match costs work alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, partitions, task_id, text_bytes

#: Words of a duplicate window and of an anchor. A longer anchor makes fewer chance matches, but more anchors for each word: 2 / (WINDOW - GRAM + 2).
WINDOW, GRAM = 20, 8
BLOCK_BYTES, SLICE = 8 << 20, 1 << 20
#: A place is a block number (partition, then 16 bits within it) and the number of a word in the block (28 bits).
WORD_BITS, BLOCK_BITS, MOST_PARTITIONS = 28, 16, 1 << 19
BASE, WORD_BASE, OTHER_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93
APART = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64, made once and as long as needed."""

    def __init__(self, base: int):
        self.base, self.inverse, self.held = base, pow(base, -1, 1 << 64), (np.ones(1, np.uint64), np.ones(1, np.uint64))

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.held[0]) < n:
            self.held = tuple(np.multiply.accumulate(np.append(np.uint64(1), np.full(max(n, SLICE), b, np.uint64))) for b in (self.base, self.inverse))
        return self.held[0][:n], self.held[1][:n]


POWERS = {b: Powers(b) for b in (BASE, WORD_BASE, OTHER_BASE)}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _sums(values: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of values times powers, and the inverse powers: the hash of a range is the difference of sums times the inverse power at its start."""
    up, down = POWERS[base].upto(len(values) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[:-1])]), down


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of a text's bytes, and where it begins. By slices that end between words."""
    apart = APART[data]
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = min(at + SLICE, len(data))
        if end < len(data):
            gaps = np.flatnonzero(apart[at:end])
            end = at + int(gaps[-1]) + 1 if len(gaps) else at + SLICE + int(np.argmax(apart[at + SLICE :])) if apart[at + SLICE :].any() else len(data)
        inside = np.concatenate([[False], ~apart[at:end], [False]])
        first, stop = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
        total, down = _sums(data[at:end].astype(np.uint64) + np.uint64(1), BASE)
        hashes.append(mix((total[stop] - total[first]) * down[first] + (stop - first).astype(np.uint64) * np.uint64(WORD_BASE)))
        starts.append(first + at)
        at = end
    return (np.concatenate(hashes), np.concatenate(starts)) if hashes else (np.empty(0, np.uint64), np.empty(0, np.int64))


class Block:
    """The words of some texts, one text after the other; first: the number of each text's first word."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"\n".join(texts), np.uint8)
        self.words, starts = word_hashes(data)
        begin = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.first = np.searchsorted(starts, begin)
        self.first[-1] = len(self.words)

    def windows(self) -> np.ndarray:
        """Numbers of the words at which a window of one text begins."""
        n = np.diff(self.first)
        fits = np.maximum(n - WINDOW + 1, 0)
        skipped = np.concatenate([[0], np.cumsum(n - fits)])[:-1]
        return np.arange(fits.sum()) + np.repeat(skipped, fits)

    def _ranges(self, words: np.ndarray, base: int, size: int) -> np.ndarray:
        total, down = _sums(words, base)
        n = max(0, len(words) - size + 1)
        return mix((total[size:] - total[:n]) * down[:n]) if n else np.empty(0, np.uint64)

    def anchors(self, at: np.ndarray) -> np.ndarray:
        """The anchor of each window."""
        if not len(at):
            return np.empty(0, np.int64)
        least, span, have = self._ranges(self.words, WORD_BASE, GRAM), WINDOW - GRAM + 1, 1
        while have < span:  # least of `have` neighbours, doubled
            step = min(have, span - have)
            least = np.minimum(least[: len(least) - step], least[step:])
            have += step
        return least[at].view(np.int64)

    def hashes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64 and another 32 bits of each window."""
        if not len(at):
            return np.empty(0, np.int64), np.empty(0, np.int32)
        one = self._ranges(self.words, WORD_BASE, WINDOW)[at]
        two = self._ranges(mix(self.words + np.uint64(BASE)), OTHER_BASE, WINDOW)[at]
        return one.view(np.int64), (two >> np.uint64(32)).astype(np.uint32).view(np.int32)


def earliest(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """For each window the number of the first one that equals it."""
    order = np.argsort(one, kind="stable")
    a, b = one[order], two[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(order) else np.empty(0, bool)
    out = np.empty(len(order), np.int64)
    out[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else order
    return out


def _blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """b, row, doc_id, text: documents in the order of their ids; b orders the blocks, row a block's documents. Stored."""
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text")).withColumn("h", F.xxhash64("text"))

    def number(batches):
        block, row, held = task_id() << BLOCK_BITS, 0, 0
        for batch in batches:
            blocks, rows = [], []
            for size in [len(t.as_buffer()) for t in batch.column("text")]:
                if row and held + size > block_bytes:
                    block, row, held = block + 1, 0, 0
                blocks.append(block)
                rows.append(row)
                row, held = row + 1, held + size
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(rows, pa.int32()), batch.column("doc_id"), batch.column("text")], ["b", "row", "doc_id", "text"])

    n = min(partitions(docs), MOST_PARTITIONS)
    ordered = given.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    return materialise(ordered.mapInArrow(number, "b long, row int, doc_id long, text binary"), "blocks")


def _texts(table: pa.Table) -> tuple[pa.Table, Block]:
    table = table.sort_by("row")
    return table, Block(table.column("text").to_pylist())


def lookups(blocks: DataFrame) -> DataFrame:
    """b, word, source: the windows (by their first word in the block) that stand in an earlier block too, and their earliest place. Stored."""

    def anchors(batches):
        # a block's rows come one after the other
        block, held = None, []
        for batch in batches:
            for a, b in _runs(batch.column("b").to_numpy()):
                number = batch.column("b")[a].as_py()
                if block is not None and number != block:
                    yield _anchor_rows(block, held)
                    held = []
                block, texts = number, Block(batch.column("text").slice(a, b - a).to_pylist())
                held.append(np.unique(texts.anchors(texts.windows())))
        if block is not None:
            yield _anchor_rows(block, held)

    def index(key, left, right):
        _, block = _texts(left)
        at = block.windows()
        at = at[np.isin(block.anchors(at), right.column("anchor").to_numpy())]
        one, two = block.hashes(at)
        first = earliest(one, two) == np.arange(len(at))
        place = (key[0].as_py() << WORD_BITS) + at[first]
        return pa.Table.from_pydict({"one": one[first], "two": two[first], "place": place})

    of = lambda c: F.shiftright(c, WORD_BITS)
    everywhere = Window.partitionBy("anchor")
    found = blocks.select("b", "text").mapInArrow(anchors, "anchor long, b long")
    shared = found.withColumns({"least": F.min("b").over(everywhere), "most": F.max("b").over(everywhere)}).where("least < most").select("b", "anchor")
    shared = materialise(shared, "shared-anchors")
    windows = blocks.groupBy("b").cogroup(shared.groupBy("b")).applyInArrow(index, "one long, two int, place long")
    source = F.min("place").over(Window.partitionBy("one", "two"))
    held = windows.withColumn("source", source).where(of("source") < of("place"))
    return materialise(held.select(of("place").alias("b"), F.col("place").bitwiseAND((1 << WORD_BITS) - 1).alias("word"), "source"), "lookups")


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(keys)) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True)) if len(keys) else []


def _anchor_rows(block: int, held: list[np.ndarray]) -> pa.RecordBatch:
    own = np.unique(np.concatenate(held))
    return pa.RecordBatch.from_pydict({"anchor": own, "b": np.full(len(own), block)})


def parse(block: Block, number: int, words: np.ndarray, sources: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (word of the block), length in words, and source place of each factor of a block's texts. words, sources: its windows found in earlier blocks."""
    at = block.windows()
    first = at[earliest(*block.hashes(at))] if len(at) else at
    source = np.full(len(block.words) + 1, -1, np.int64)
    source[words] = sources
    known = source[first]
    own = np.where(known >= 0, known, np.where(first < at, (number << WORD_BITS) + first, -1))
    kept = own >= 0
    at, own = at[kept], own[kept]
    goes_on = np.append(False, (np.diff(at) == 1) & (np.diff(own) == 1))[: len(at)]
    # windows of two texts never are neighbours: a text's last WINDOW - 1 words begin none
    start = np.flatnonzero(~goes_on)
    length = np.diff(np.append(start, len(at))) + WINDOW - 1
    return at[start], length, own[start]


def _parsed(docs: DataFrame, id_col: str, text_col: str, block_bytes: int, emit: Callable, schema: str) -> DataFrame:
    blocks = _blocks(docs, id_col, text_col, block_bytes)
    found = lookups(blocks)

    def each(key, left, right):
        table, block = _texts(left)
        return emit(table, block, *parse(block, key[0].as_py(), right.column("word").to_numpy(), right.column("source").to_numpy()))

    return blocks.groupBy("b").cogroup(found.groupBy("b")).applyInArrow(each, schema)


def factors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, start, words, source_block, source_word of each factor: words of the document from start (from 0) that also stand at the source."""

    def emit(table, block, start, length, source):
        doc = np.searchsorted(block.first, start, "right") - 1
        ids = table.column("doc_id").combine_chunks().take(pa.array(doc))
        return pa.Table.from_pydict({"doc_id": ids, "start": start - block.first[doc], "words": length, "source_block": source >> WORD_BITS, "source_word": source & ((1 << WORD_BITS) - 1)})

    return _parsed(docs, id_col, text_col, block_bytes, emit, "doc_id long, start long, words long, source_block long, source_word long")


def covered(block: Block, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether each word of a block lies in a factor."""
    change = np.zeros(len(block.words) + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, start + length, -1)
    return np.cumsum(change)[:-1] > 0


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and the words that stay, joined by spaces: text, or with digest kept_sha256."""
    last = "kept_sha256" if digest else "text"

    def emit(table, block, start, length, source):
        stays = ~covered(block, start, length)
        removed = np.concatenate([[0], np.cumsum(~stays)])
        kept = []
        for text, a, b in zip(table.column("text"), block.first[:-1].tolist(), block.first[1:].tolist(), strict=True):
            words = text.as_py().split()
            left = b" ".join(compress(words, stays[a:b].tolist()) if removed[b] > removed[a] else words)
            kept.append(hashlib.sha256(left).hexdigest() if digest else left.decode())
        return pa.Table.from_pydict({"doc_id": table.column("doc_id"), "n_words": np.diff(block.first), "n_removed": removed[block.first[1:]] - removed[block.first[:-1]], last: pa.array(kept, pa.string())})

    return _parsed(docs, id_col, text_col, block_bytes, emit, f"doc_id long, n_words long, n_removed long, {last} string")


SQL = f"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
v AS (SELECT k, i, s FROM (SELECT k, unnest(range(0, len(w) - {WINDOW - 1})) AS i, array_to_string(list_slice(w, i + 1, i + {WINDOW}), ' ') AS s FROM d WHERE len(w) >= {WINDOW})),
r AS (SELECT k, i FROM (SELECT k, i, row_number() OVER (PARTITION BY s ORDER BY k, i) AS n FROM v) WHERE n > 1),
x AS (SELECT k, unnest(range(0, len(w))) AS i, unnest(w) AS word FROM d),
c AS (SELECT k, i, word, max(r.i) OVER (PARTITION BY k ORDER BY i) AS seen FROM x LEFT JOIN r USING (k, i)),
t AS (SELECT k, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept
      FROM (SELECT k, i, word, coalesce(seen > i - {WINDOW}, false) AS gone FROM c) GROUP BY k)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN t USING (k)
"""
