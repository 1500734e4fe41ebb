"""Ranked lexical search: an inverted index in shards, posting blocks of variable length, and block-max WAND.

Terms are maximal runs of ASCII digits, ASCII letters (lower-cased) and non-ASCII characters. A document's score for a query is the sum, over the
query's distinct terms, of weight times impact, all in whole numbers: the weight falls with the number of documents that hold a term,
the impact (10^9 tf) div (1000 tf + 20 m) grows with its occurrences, where m = 50 + (50 n N) div L is the document's relative length in percent, halved towards 100.

Blocks. The bound of a block is the largest impact in it; its error is the sum of what its postings fall short of it. For each posting list, dynamic
programming finds the cut into blocks of at most WIDTH postings whose errors, with BLOCK_COST for each block, are least together (all lists of a shard go
through the recurrence in step).

Search. In a shard, the blocks of a query's terms cut the documents into intervals; the sum of weight times bound of the blocks over an interval bounds the score of
its documents. Intervals are visited by falling bound, some documents at a time. One below the score of the k-th best document is skipped with all blocks that lie in such intervals only,
unread. Of what is read, a document is scored if the bounds of the terms it really holds reach that score (the weak AND); so no document that belongs to the
best is lost, ties included. A task carries its best documents from shard to shard.

Defined cases: a null or empty text has no terms: it is no candidate and is not counted; a null or empty query has no results; repeated rows count and are ranked
as documents of their own; equal scores are ranked by id, a null id last; repeated queries (equal id and text) are one; equal ids with different texts are
ranked apart; a text of any length is indexed whole; without documents or queries the result is empty; other columns are not read.

Scale: two scans of the texts (one counts terms, one makes the index, map-only). A shard holds `shard_bytes` of text or `shard_docs` documents, or one longer
document. The index is stored and serves any queries: a search reads the rows of its terms and brings a shard's rows together, so no list is
gathered over shards. Queries go out in blocks of `block_bytes`; a task returns k documents for each of them, and Spark ranks those with a limit for each group before and after the exchange.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, small_batches, task_id, text_bytes

SHARD_BYTES, SHARD_DOCS, QUERY_BLOCK, EMIT, COUNTED = 16 << 20, 1 << 16, 4 << 20, 8192, 1 << 20
#: Postings of a block at most, and the cost of one more block in units of bound error (twice the largest impact).
WIDTH, BLOCK_COST = 64, 2_000_000
BEST = 50
LISTS = 1024
IN_TERM = np.array([c >= 0x80 or chr(c).isalnum() for c in range(256)])
FOLD = bytes(ord(chr(c).lower()) if c < 0x80 and IN_TERM[c] else c if IN_TERM[c] else 0x20 for c in range(256))
#: Rows with a term hold its postings in a shard (32-bit numbers): docs, their tf, and of each block the first and last document, the end, and the bound. Rows without hold the shard's documents.
INDEX = "shard long, term string, n long, docs binary, tf binary, first binary, last binary, stop binary, most binary, ids array<long>, lengths array<int>"


def terms(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def count_terms(column: pa.Array) -> np.ndarray:
    """Terms of each of the texts (binary), without splitting them."""
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int32, n + 1, column.offset * 4)
    data = np.frombuffer(column.buffers()[2], np.uint8, offsets[-1] - offsets[0], offsets[0]) if offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    inside = IN_TERM[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at = (offsets - offsets[0]).astype(np.int64)
    starts = at[:-1][at[1:] > at[:-1]]  # a text's first byte has no byte before it
    begins[starts] = inside[starts]
    return np.diff(np.concatenate([[0], np.cumsum(begins)])[at])


def relative_length(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """m of documents of n terms, exact."""
    n = np.asarray(n, np.int64)
    if 50 * docs * int(n.max(initial=0)) >= 1 << 63:
        n = n.astype(object)
    return (50 + (50 * n * docs) // max(total, 1)).astype(np.int64)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def weight(docs: int, df: int) -> int:
    return floor(1000 * log((2 * docs + 2) / (2 * df + 1)))


def cut(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, cost: int = BLOCK_COST, width: int = WIDTH) -> np.ndarray:
    """Whether each posting begins a block, in the cut of each list that has the least sum of block length times largest value, plus cost for each block."""
    begins, back = np.zeros(len(values), bool), np.zeros(len(values), np.uint16)
    order = np.argsort(-lengths, kind="stable")
    for at in range(0, len(order), LISTS):
        own = order[at : at + LISTS]
        s, n = starts[own], lengths[own]
        # by slot of a block's first posting, modulo width: the cost before it, and the largest value since
        before, most = np.full((len(own), width), 1 << 61), np.zeros((len(own), width), np.int64)
        total, active = np.zeros(len(own), np.int64), len(own)
        for i in range(int(n[0])):
            while n[active - 1] <= i:
                active -= 1
            a, slot = active, i % width
            before[:a, slot], most[:a, slot] = total[:a], 0
            np.maximum(most[:a], values[s[:a] + i][:, None], out=most[:a])
            size = (slot - np.arange(width)) % width + 1
            costs = before[:a] + most[:a] * size
            chosen = costs.argmin(axis=1)
            total[:a] = costs[np.arange(a), chosen] + cost
            back[s[:a] + i] = size[chosen]
        end, live = n - 1, np.arange(len(own))
        while len(live):
            end[live] -= back[s[live] + end[live]]
            begins[s[live] + end[live] + 1] = True
            live = live[end[live] >= 0]
    return begins


def _packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary rows of 32-bit values: those between neighbouring bounds."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(((bounds - bounds[0]) * 4).astype("<i4").tobytes()), pa.py_buffer(values[bounds[0] : bounds[-1]].astype("<i4").tobytes())])


class Builder:
    """Gathers documents of one shard and turns them into rows of the index."""

    def __init__(self, docs: int, total: int, shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS):
        self.docs, self.total, self.shard_bytes, self.shard_docs = docs, total, shard_bytes, shard_docs
        self.clear()

    def clear(self) -> None:
        self.bytes, self.vocabulary, self.ids, self.lengths = 0, {}, [], []
        self.term, self.tf, self.held = array("i"), array("i"), array("i")

    def add(self, doc_id: int | None, text: bytes) -> None:
        found = terms(text)
        if not found:
            return
        counts, number = Counter(found), self.vocabulary
        self.term.extend([number.setdefault(t, len(number)) for t in counts])
        self.tf.extend(counts.values())
        self.held.append(len(counts))
        self.ids.append(doc_id)
        self.lengths.append(len(found))
        self.bytes += len(text)

    @property
    def full(self) -> bool:
        return self.bytes >= self.shard_bytes or len(self.ids) >= self.shard_docs

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("n", pa.int64()), *((c, pa.binary()) for c in ("docs", "tf", "first", "last", "stop", "most")), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32()))])
        blank = lambda n, *names: {c: pa.nulls(n, schema.field(c).type) for c in names}
        yield pa.RecordBatch.from_pydict({"shard": [shard], "n": [len(self.ids)], "ids": [self.ids], "lengths": [self.lengths]} | blank(1, "term", "docs", "tf", "first", "last", "stop", "most"), schema=schema)
        term, tf = np.frombuffer(self.term, np.int32), np.frombuffer(self.tf, np.int32)
        doc = np.repeat(np.arange(len(self.ids), dtype=np.int32), np.frombuffer(self.held, np.int32))
        order = np.argsort(term, kind="stable")
        tf, doc = tf[order], doc[order]
        lengths = np.bincount(term, minlength=len(self.vocabulary)).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        values = impact(tf, relative_length(np.array(self.lengths), self.docs, self.total)[doc])
        starts = np.flatnonzero(cut(values, bounds[:-1], lengths))
        most, stops = np.maximum.reduceat(values, starts), np.append(starts[1:], len(values))
        of = np.searchsorted(starts, bounds)  # blocks of each list
        inner = stops - np.repeat(bounds[:-1], np.diff(of))
        names = list(self.vocabulary)
        for a in range(0, len(names), EMIT):
            b = min(a + EMIT, len(names))
            columns = {"shard": np.full(b - a, shard), "term": pa.array(names[a:b], pa.binary()).cast(pa.string()), "n": lengths[a:b], "docs": _packed(doc, bounds[a : b + 1]), "tf": _packed(tf, bounds[a : b + 1])}
            columns |= {c: _packed(v, of[a : b + 1]) for c, v in (("first", doc[starts]), ("last", doc[stops - 1]), ("stop", inner), ("most", most))}
            yield pa.RecordBatch.from_pydict(columns | blank(b - a, "ids", "lengths"), schema=schema)


class Shard:
    """A shard's documents and the posting lists at hand. read: postings that searches have read so far."""

    def __init__(self, ids: list, lengths: np.ndarray, lists: dict[str, dict[str, np.ndarray]], docs: int, total: int):
        self.null = np.array([i is None for i in ids], bool)
        self.ids = np.array([i or 0 for i in ids], np.int64)
        self.m, self.lists, self.read = relative_length(lengths, docs, total), lists, 0

    def search(self, query: list[tuple[str, int]], best: Best) -> None:
        """Offer best all documents that can belong to it. query: terms with their weights."""
        held = [(w, self.lists[t]) for t, w in query if w and t in self.lists]
        if not held:
            return
        edge = np.concatenate([c for _, x in held for c in (x["first"].astype(np.int64), x["last"] + np.int64(1))])
        step = np.concatenate([c for w, x in held for c in (w * x["most"].astype(np.int64), -w * x["most"].astype(np.int64))])
        order = np.argsort(edge, kind="stable")
        edge, bound = edge[order], np.cumsum(step[order])
        final = np.append(edge[1:] != edge[:-1], True)
        edge, bound = edge[final], bound[final]
        size, bound = np.diff(edge), bound[:-1]
        by = np.argsort(-bound, kind="stable")
        covered, at, some = np.cumsum(size[by]), 0, 8 * best.k
        while at < len(by) and bound[by[at]] >= best.least:
            end = int(np.searchsorted(covered, (covered[at - 1] if at else 0) + some)) + 1
            chosen = by[at:end]
            chosen = chosen[bound[chosen] >= best.least]
            change = np.zeros(len(self.ids) + 1, np.int64)
            change[edge[chosen]] += 1
            np.add.at(change, edge[chosen] + size[chosen], -1)
            self._score(held, np.cumsum(change)[:-1] > 0, best)
            at, some = end, 2 * some

    def _score(self, held, inside: np.ndarray, best: Best) -> None:
        among = np.concatenate([[0], np.cumsum(inside)])
        docs, tfs, weights, bounds = [], [], [], []
        for w, x in held:
            blocks = np.flatnonzero(among[x["last"] + 1] > among[x["first"]])
            if not len(blocks):
                continue
            start = np.where(blocks > 0, x["stop"][blocks - 1], 0)
            n = x["stop"][blocks] - start
            places = np.arange(n.sum()) + np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            self.read += len(places)
            kept = inside[x["docs"][places]]
            docs.append(x["docs"][places][kept])
            tfs.append(x["tf"][places][kept])
            weights.append(np.full(kept.sum(), w, np.int64))
            bounds.append(np.repeat(w * x["most"][blocks].astype(np.int64), n)[kept])
        if not docs:
            return
        doc, tf, w = np.concatenate(docs), np.concatenate(tfs), np.concatenate(weights)
        # sums of doubles: whole numbers far below 2^53
        possible = np.bincount(doc, np.concatenate(bounds), len(self.ids)) >= best.least
        some = possible[doc]
        doc, tf, w = doc[some], tf[some], w[some]
        score = np.bincount(doc, w * impact(tf, self.m[doc]), len(self.ids)).astype(np.int64)
        found = np.flatnonzero(score >= best.least)
        best.offer(score[found], self.ids[found], self.null[found])


class Best:
    """The k best (score, id) so far; least: the score that a document needs to be among them."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.score, self.ids, self.null = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def offer(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        score, ids, null = np.concatenate([self.score, score]), np.concatenate([self.ids, ids]), np.concatenate([self.null, null])
        order = np.lexsort((ids, null, -score))[: self.k]
        self.score, self.ids, self.null = score[order], ids[order], null[order]
        if len(order) == self.k:
            self.least = max(1, int(self.score[-1]))


@dataclass(frozen=True)
class LexicalIndex:
    """A stored index (rows as INDEX says), the number of documents with a term, and of all their terms."""

    table: DataFrame
    docs: int
    total: int

    @classmethod
    def build(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS) -> LexicalIndex:
        given = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))

        def count(batches):
            for batch in batches:
                column = batch.column("text")
                for a, b in small_batches(column, COUNTED):
                    n = count_terms(column.slice(a, b - a))
                    yield pa.RecordBatch.from_pydict({"docs": [int((n > 0).sum())], "total": [int(n.sum())]})

        sums = given.select("text").mapInArrow(count, "docs long, total long").agg(F.sum("docs").alias("docs"), F.sum("total").alias("total")).first()
        held, total = sums["docs"] or 0, sums["total"] or 0

        def index(batches):
            shard, made = Builder(held, total, shard_bytes, shard_docs), 0
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                for i, text in zip(ids, batch.column("text"), strict=True):
                    shard.add(i, text.as_py())
                    if shard.full:
                        yield from shard.rows((task_id() << 32) + made)
                        made += 1
                        shard.clear()
            if shard.ids:
                yield from shard.rows((task_id() << 32) + made)

        return cls(materialise(given.mapInArrow(index, INDEX), "lexical-index"), held, total)

    def search(self, queries: DataFrame, k: int = BEST, id_col: str = "item_id", text_col: str = "text", block_bytes: int = QUERY_BLOCK) -> DataFrame:
        """item_id, rank, doc_id, score of each query's k best documents."""
        given = queries.select(F.col(id_col).cast("long").alias("item_id"), text_bytes(text_col).alias("text")).where(F.length("text") > 0).distinct()
        size = given.agg(F.sum(F.length("text"))).first()[0] or 0
        n, out = max(1, -(-size // block_bytes)), None
        given = materialise(given, "queries") if n > 1 else given
        for b in range(n):
            block = given.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) if n > 1 else given
            part = self._search([(r["item_id"], bytes(r["text"])) for r in block.collect()], k)  # of block_bytes
            part = materialise(part, "ranks") if n > 1 else part
            out = part if out is None else out.unionByName(part)
        return out

    def _search(self, queries: list[tuple[int | None, bytes]], k: int) -> DataFrame:
        spark = self.table.sparkSession
        wanted = [sorted({t.decode() for t in terms(text)}) for _, text in queries]
        names = sorted({t for q in wanted for t in q})
        asked = F.broadcast(spark.createDataFrame([(t, True) for t in names], "term string, asked boolean"))
        df = {r["term"]: r["df"] for r in self.table.select("term", "n").join(asked, "term").groupBy("term").agg(F.sum("n").alias("df")).collect()}  # terms of the queries at hand
        weights = {t: weight(self.docs, n) for t, n in df.items()}
        sent = spark.sparkContext.broadcast([[(t, weights[t]) for t in q if t in weights] for q in wanted])
        docs, total = self.docs, self.total
        rows = self.table.join(asked, "term", "left").where("asked OR term IS NULL").drop("asked").repartition("shard").sortWithinPartitions("shard")

        def search(batches):
            best = [Best(k) for _ in sent.value]
            for ids, lengths, lists in _shards(batches):
                shard = Shard(ids, lengths, lists, docs, total)
                for query, own in zip(sent.value, best, strict=True):
                    shard.search(query, own)
            for q, own in enumerate(best):
                ids = pa.array(own.ids, mask=own.null)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q, np.int32)), ids, pa.array(own.score)], ["q", "doc_id", "score"])

        ids = F.broadcast(spark.createDataFrame([(q, i) for q, (i, _) in enumerate(queries)], "q int, item_id long"))
        order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = rows.mapInArrow(search, "q int, doc_id long, score long").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return ranked.join(ids, "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _shards(batches) -> Iterator[tuple[list, np.ndarray, dict]]:
    """ids, lengths and lists of each shard; a shard's rows come one after the other."""
    shard, ids, lengths, lists = None, None, None, {}
    for batch in batches:
        for r in batch.to_pylist():
            if r["shard"] != shard:
                if ids is not None:
                    yield ids, lengths, lists
                shard, ids, lengths, lists = r["shard"], None, None, {}
            if r["term"] is None:
                ids, lengths = r["ids"], np.array(r["lengths"], np.int64)
            else:
                lists[r["term"]] = {c: np.frombuffer(r[c], "<i4") for c in ("docs", "tf", "first", "last", "stop", "most")}
    if ids is not None:
        yield ids, lengths, lists


def lexical_query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every benchmark item against an index of all documents."""
    return LexicalIndex.build(docs).search(benchmark)


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS nn, CAST(sum(len(w)) AS BIGINT) AS ll FROM d WHERE len(w) > 0),
p AS (SELECT k, doc_id, n, t, count(*) AS tf FROM (SELECT k, doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY ALL),
q AS (SELECT item_id, unnest(list_distinct({_WORDS})) AS t FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
f AS (SELECT t, count(*) AS df FROM p WHERE t IN (SELECT t FROM q) GROUP BY t),
x AS (SELECT item_id, doc_id, k, sum(CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll)))) AS score
      FROM p JOIN q USING (t) JOIN f USING (t) CROSS JOIN s GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score
FROM x WHERE score > 0 QUALIFY rank <= {BEST}
"""
