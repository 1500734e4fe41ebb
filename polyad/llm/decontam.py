"""Benchmark decontamination: approximate occurrences of benchmark texts by the q-gram lemma over diagonal bands.

An item of m bytes that occurs with at most k edits shares at least m - q + 1 - k*q of its q-grams with that place, and they lie on
at most k + 1 neighbouring diagonals (text position minus item position). So shared q-grams are counted in bands of 2(k + 1)
diagonals that overlap by half: any k + 1 neighbours lie in one of them. Bands below the bound are put aside; the others are verified by
an alignment of the item within the band.

Texts are compared lower-cased (A-Z) with white space runs as one space. `rate` sets the edit budget: k = floor(rate * m), for every m.
Items too short for the bound with q = 8 (some of under 32 bytes) are searched with the largest q that leaves it positive. An item whose
budget is 0 (under 10 bytes at the usual rate) must stand alone: it is not found inside a longer word.

Defined cases: null and empty texts hold nothing; null and empty items are not searched for; repeated items each report; repeated
rows each report; a text of any length is processed whole (in chunks that overlap by more than an item); an item that occurs several
times in a text is reported at its best place, the first of equals; empty tables give none; other columns are not read.

Scale: texts are read once, map-only, whatever the number of items. Items are grouped, cut into blocks of about `block_bytes` by hash, and
sent as a broadcast each; the driver holds one block at a time. A worker makes a block's index once and keeps the last two, so
a benchmark of many blocks costs time, not memory. Bands are counted in steps of PAIRS while the text goes by, and places of one q-gram in
an item count as runs, so memory is bounded by blocks, the chunk of text and PAIRS, however often a text or an item repeats itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import ClassVar

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches, text_bytes

Q, RATE = 8, 0.10
CHUNK, ITEM_BLOCK = 2 << 20, 4 << 20
SLOT_BITS = 20
#: Pairs of a text position and a band that are held at once, and windows whose verification is remembered.
PAIRS, WINDOWS = 1 << 18, 1024
MIX = np.uint64(0x9E3779B97F4A7C15)


def normal(text: bytes) -> bytes:
    return b" ".join(text.lower().split())


def qgrams(data: np.ndarray, q: int = Q) -> np.ndarray:
    """The q (at most 8) bytes from each position as one number."""
    n = len(data) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    padded = np.concatenate([data, np.zeros(16, np.uint8)]).tobytes()
    codes = np.empty((n + 7) // 8 * 8, np.uint64)
    for o in range(8):
        part = codes[o::8]
        part[:] = np.frombuffer(padded, "<u8", len(part), o)
    return codes[:n] & np.uint64((1 << (8 * q)) - 1) if q < 8 else codes[:n]


def band_align(item: np.ndarray, text: np.ndarray, first: int, width: int, k: int) -> tuple[int, int, int] | None:
    """Best (edits, start, stop) of the whole item in text on paths within diagonals first..first+width-1, if at most k edits."""
    m, n = len(item), len(text)
    c = np.arange(width)
    big = np.int32(1 << 28)
    # row i holds edits with i item bytes used; column c is text position first + c + i
    inside = (first + c >= 0) & (first + c <= n)
    row = np.where(inside, 0, big).astype(np.int32)
    # paths that begin before the text: item bytes deleted up to text position 0
    origin = first + c
    padded = np.concatenate([np.zeros(max(0, -first), np.uint8), text, np.zeros(max(0, first + width + m - n), np.uint8)])
    shift = max(0, -first)
    for i in range(1, m + 1):
        at = first + c + i
        chars = padded[at[0] - 1 + shift : at[0] - 1 + shift + width] if at[0] - 1 + shift >= 0 else None
        if chars is None:
            return None
        straight = row + (chars != item[i - 1])
        straight[(at < 1) | (at > n)] = big
        down = np.empty_like(row)
        down[:-1], down[-1] = row[1:] + 1, big
        down[(at < 0) | (at > n)] = big
        take = down < straight
        best = np.where(take, down, straight)
        from_ = origin.copy()
        from_[:-1] = np.where(take[:-1], origin[1:], origin[:-1])
        run = np.minimum.accumulate(best - c)
        row = (run + c).astype(np.int32)
        lead = np.maximum.accumulate(np.where(best - c == run, c, 0))
        origin = from_[lead]
        row[(at < 0) | (at > n)] = big
        if row.min() > k:
            return None
    j = int(np.argmin(row))
    return (int(row[j]), int(origin[j]), int(first + j + m)) if row[j] <= k else None


def budget(m: int, rate: float = RATE) -> int:
    """Edits allowed in an occurrence of an item of m bytes."""
    return int(rate * m)


def gram_size(m: int, q: int = Q, rate: float = RATE) -> int:
    """The largest q-gram, up to q, of which an item of m bytes shares at least one with any occurrence: m - q + 1 - k * q > 0."""
    return min(q, m // (budget(m, rate) + 1))


class Index:
    """Items (number, bytes) whose q-grams of one size are searched together."""

    def __init__(self, items: list[tuple[int, np.ndarray]], q: int, rate: float):
        self.q, self.items = q, items
        self.m = np.array([len(t) for _, t in self.items], np.int64)
        self.k = np.array([budget(len(t), rate) for _, t in self.items], np.int64)
        self.bound = self.m - q + 1 - self.k * q
        self.longest = int(self.m.max(initial=0))
        codes, owner, place = [], [], []
        for t, (_, data) in enumerate(self.items):
            g = qgrams(data, q)
            codes.append(g)
            owner.append(np.full(len(g), t, np.int64))
            place.append(np.arange(len(g), dtype=np.int64))
        codes = np.concatenate(codes) if codes else np.empty(0, np.uint64)
        order = np.argsort(codes, kind="stable")  # so by code, owner and place
        owner = np.concatenate(owner)[order] if len(order) else np.empty(0, np.int64)
        place = np.concatenate(place)[order] if len(order) else np.empty(0, np.int64)
        self.codes, code = np.unique(codes[order], return_inverse=True)
        # places of a q-gram in an item that lie at most half a band apart are one run: the bands that they reach are neighbours
        pair = code * max(len(self.items), 1) + owner
        new = np.append(True, (np.diff(pair) != 0) | (np.diff(place) > self.k[owner[1:]] + 1))[: len(pair)]
        first = np.flatnonzero(new)
        self.run_owner, self.run_low, self.run_high = owner[first], place[first], place[np.append(first[1:], len(place)) - 1] if len(first) else first
        self.run_at, self.runs = np.unique(code[first], return_index=True)[1], np.bincount(code[first], minlength=len(self.codes))
        self.pair, self.pair_places = np.unique(pair, return_counts=True)
        self.slots = np.zeros(1 << SLOT_BITS, bool)
        self.slots[self._slot(self.codes)] = True

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        return (codes * MIX) >> np.uint64(64 - SLOT_BITS)

    def search(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """(row, edits, start, stop, item number) of occurrences in normalised texts."""
        out: list = []
        rows, starts, held, pieces = [], [], 0, []
        step = max(CHUNK, 4 * self.longest)
        lap = 2 * self.longest + 2 * int(self.k.max(initial=0)) + self.q
        for r, t in enumerate(texts):
            for a in range(0, max(len(t), 1), step):
                piece = t[a : a + step + lap]
                if held and held + len(piece) > step:
                    self._scan(rows, starts, pieces, out)
                    rows, starts, held, pieces = [], [], 0, []
                rows.append(r)
                starts.append(a)
                pieces.append(piece)
                held += len(piece)
        self._scan(rows, starts, pieces, out)
        return out

    def _scan(self, rows, starts, pieces, out) -> None:
        if not pieces or not len(self.codes):
            return
        gap = b"\n" * self.q  # no normalised text or item holds a line break
        data = np.frombuffer(gap.join(pieces), np.uint8)
        begin = np.cumsum([0] + [len(p) + self.q for p in pieces[:-1]])
        codes = qgrams(data, self.q)
        at = np.flatnonzero(self.slots[self._slot(codes)])
        hit = codes[at]
        where = np.minimum(np.searchsorted(self.codes, hit), len(self.codes) - 1)
        same = self.codes[where] == hit
        at, where = at[same], where[same]
        if not len(at):
            return
        seen: dict = {}
        for t, first in zip(*self._bands(at, where, len(data)), strict=True):
            k, m = int(self.k[t]), int(self.m[t])
            piece = max(0, int(np.searchsorted(begin, first + m // 2, "right")) - 1)
            lo, hi = int(begin[piece]), int(begin[piece]) + len(pieces[piece])
            # all that paths within the band can reach
            a = min(max(lo, first), hi)
            window = data[a : max(a, min(hi, first + 2 * (k + 1) + m + k))]
            key = (t, a - first, window.tobytes())
            if key not in seen:  # in a text that repeats itself, windows do too
                if len(seen) >= WINDOWS:
                    seen.clear()
                seen[key] = self._verify(t, window, first - a)
            if found := seen[key]:
                out.append((rows[piece], found[0], starts[piece] + a - lo + found[1], starts[piece] + a - lo + found[2], self.items[t][0]))

    def _verify(self, t: int, window: np.ndarray, first: int) -> tuple[int, int, int] | None:
        item, k = self.items[t][1], int(self.k[t])
        exact = window.tobytes().find(item.tobytes())
        return (0, exact, exact + len(item)) if exact >= 0 else band_align(item, window, first, 2 * (k + 1), k)

    def _bands(self, at: np.ndarray, where: np.ndarray, size: int) -> tuple[list[int], list[int]]:
        """Items and first diagonals of the bands that may hold an occurrence; at: text positions of q-grams that items have, where: their numbers.

        Goes through the text in steps of about PAIRS (position, band) pairs and keeps counts of bands that later positions can still reach.
        A position counts once for a band, whatever the number of item places there.
        """
        wide, ends = np.int64(size + self.longest + 4), np.cumsum(self.runs[where])
        keys, counts, done, pos = np.empty(0, np.int64), np.empty(0, np.int64), [], 0
        while pos < len(at):
            stop = max(pos + 1, int(np.searchsorted(ends, (ends[pos - 1] if pos else 0) + PAIRS, "right")))
            n = self.runs[where[pos:stop]]
            run = _ranges(self.run_at[where[pos:stop]], n)
            p, owner = np.repeat(at[pos:stop], n) + self.longest, self.run_owner[run]
            half = self.k[owner] + 1
            # band b has the diagonals from b * half, two halves wide, so a diagonal lies in two bands
            low, high = np.maximum((p - self.run_high[run]) // half - 1, 0), (p - self.run_low[run]) // half
            new, count = np.unique(np.repeat(owner, high - low + 1) * wide + _ranges(low, high - low + 1), return_counts=True)
            keys, inverse = np.unique(np.concatenate([keys, new]), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([counts, count]), len(keys)).astype(np.int64)
            owner, band = keys // wide, keys % wide
            enough = counts >= self.bound[owner]
            over = (band + 2) * (self.k[owner] + 1) + self.m[owner] - self.longest <= at[stop] if stop < len(at) else np.ones(len(keys), bool)
            done.append(keys[over & enough])
            keys, counts, pos = keys[~over], counts[~over], stop
        keys = np.concatenate(done) if done else keys
        owner, first = keys // wide, keys % wide * (self.k[keys // wide] + 1) - self.longest
        kept = self._held(at, where, owner, first)
        return owner[kept].tolist(), first[kept].tolist()

    def _held(self, at: np.ndarray, where: np.ndarray, owner: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Whether the q-grams in a band's stretch of text have enough places in its item."""
        out, lo = np.zeros(len(owner), bool), np.searchsorted(at, first)
        hi = np.searchsorted(at, first + 2 * (self.k[owner] + 1) + self.m[owner])
        ends, pos, items = np.cumsum(hi - lo), 0, max(len(self.items), 1)
        while pos < len(owner):
            stop = max(pos + 1, int(np.searchsorted(ends, (ends[pos - 1] if pos else 0) + PAIRS, "right")))
            n = hi[pos:stop] - lo[pos:stop]
            codes = np.unique(np.repeat(np.arange(stop - pos), n) * len(self.codes) + where[_ranges(lo[pos:stop], n)])
            band, code = codes // len(self.codes), codes % len(self.codes)
            pair = code * items + owner[pos:stop][band]
            i = np.minimum(np.searchsorted(self.pair, pair), len(self.pair) - 1)
            places = np.bincount(band, np.where(self.pair[i] == pair, self.pair_places[i], 0), stop - pos)
            out[pos:stop] = places >= self.bound[owner[pos:stop]]
            pos = stop
        return out


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its length says, one range after the other."""
    return np.arange(lengths.sum()) + np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) if len(lengths) else np.empty(0, np.int64)


def _inside(text: bytes, i: int) -> bool:
    """Whether byte i of a normalised text belongs to a word."""
    return 0 <= i < len(text) and (text[i] >= 0x80 or text[i : i + 1].isalnum())


def places(word: bytes, text: bytes) -> Iterator[int]:
    """Where word stands alone in text: no part of a longer word on either side."""
    at = text.find(word)
    while at >= 0:
        end = at + len(word)
        if not (_inside(text, at) and _inside(text, at - 1)) and not (_inside(text, end - 1) and _inside(text, end)):
            yield at
        at = text.find(word, at + 1)


class Finder:
    """Finds benchmark items (id, text, times given) in texts."""

    def __init__(self, items: list[tuple], q: int = Q, rate: float = RATE):
        self.items = [(i[0], np.frombuffer(t, np.uint8), i[2] if len(i) > 2 else 1) for i in items if (t := normal(i[1]))]
        self.short, groups = [], {}
        for n, (_, data, _) in enumerate(self.items):
            if budget(len(data), rate):
                groups.setdefault(gram_size(len(data), q, rate), []).append((n, data))
            else:
                self.short.append((n, data.tobytes()))
        self.indexes = [Index(found, size, rate) for size, found in sorted(groups.items())]

    def find(self, texts: list[bytes]) -> list[tuple[int, int | None, int, int, int]]:
        """(row, item id, edits, start, stop) for each item that occurs in texts[row]; positions in the normalised text."""
        texts = [normal(t) for t in texts]
        hits = [h for index in self.indexes for h in index.search(texts)]
        hits += [(r, 0, p, p + len(word), n) for n, word in self.short for r, x in enumerate(texts) if (p := next(places(word, x), -1)) >= 0]
        best: dict = {}
        for hit in hits:
            key = (hit[0], hit[4])
            if key not in best or hit < best[key]:
                best[key] = hit
        found = [(r, self.items[n][0], *place) for r, *place, n in best.values() for _ in range(self.items[n][2])]
        return sorted(found, key=lambda h: (h[0], h[1] is None, h[1] or 0, h[2:]))


class Items:
    """The items as broadcasts of bounded blocks; a worker makes a block's index once and keeps the KEEP last."""

    KEEP = 2
    held: ClassVar[dict] = {}

    def __init__(self, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = ITEM_BLOCK, q: int = Q, rate: float = RATE):
        self.q, self.rate, self.name = q, rate, uuid.uuid4().hex
        given = benchmark.select(F.col(id_col).cast("long").alias("item_id"), text_bytes(text_col).alias("text")).where(F.length("text") > 0)
        given = given.groupBy("item_id", "text").agg(F.count("*").alias("n"))
        # the rows of a block are different ones, so that blocks by hash are even; one is at the driver at a time
        total = given.agg(F.sum(F.length("text"))).first()[0] or 0
        n = -(-total // block_bytes)
        given = materialise(given, "benchmark-items") if n > 1 else given
        send = benchmark.sparkSession.sparkContext.broadcast
        self.blocks = [send(self._block(given.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) if n > 1 else given)) for b in range(n)]

    @staticmethod
    def _block(items: DataFrame) -> list[tuple]:
        return sorted(((r["item_id"], bytes(r["text"]), r["n"]) for r in items.toArrow().to_pylist()), key=str)

    def finders(self) -> Iterator[Finder]:
        for k, block in enumerate(self.blocks):
            found = Items.held.pop((self.name, k), None)
            if found is None:
                found = Finder(block.value, self.q, self.rate)
                while len(Items.held) >= Items.KEEP:
                    Items.held.pop(next(iter(Items.held)))
            Items.held[self.name, k] = found
            yield found


def find_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: int = Q, rate: float = RATE, block_bytes: int = ITEM_BLOCK) -> DataFrame:
    """doc_id, item_id, edits, start, stop (in the normalised text) of each benchmark item that occurs in a document."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    items = Items(benchmark, block_bytes=block_bytes, q=q, rate=rate)

    def search(batches):
        for batch in batches:
            for finder in items.finders():
                for a, b in small_batches(batch.column("text"), CHUNK):
                    ids = batch.column("doc_id").slice(a, b - a).to_pylist()
                    hits = finder.find(batch.column("text").slice(a, b - a).to_pylist())
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([ids[h[0]] for h in hits], pa.int64()), "item_id": pa.array([h[1] for h in hits], pa.int64()), "edits": pa.array([h[2] for h in hits], pa.int32()), "start": pa.array([h[3] for h in hits], pa.int64()), "stop": pa.array([h[4] for h in hits], pa.int64())})

    return texts.mapInArrow(search, "doc_id long, item_id long, edits int, start long, stop long")


def clean_of(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", q: int = Q, rate: float = RATE, block_bytes: int = ITEM_BLOCK) -> DataFrame:
    """The rows of docs whose text holds no benchmark item; columns as they are."""
    items = Items(benchmark, block_bytes=block_bytes, q=q, rate=rate)

    @F.pandas_udf("boolean")
    def holds(parts: pd.Series) -> pd.Series:
        flags, texts = np.zeros(len(parts), bool), [bytes(t) for t in parts]
        for finder in items.finders():
            for a, b in small_batches(pa.array(texts, pa.binary()), CHUNK):
                flags[[a + h[0] for h in finder.find(texts[a:b])]] = True
        return pd.Series(flags)

    return docs.where(~holds(text_bytes(text_col)))
