"""Quality rules: text statistics, and a language-specific perplexity band of a modified Kneser-Ney word model.

The model is an n-gram model of order 2 over words as they stand (white space apart), one for each language, counted by Spark over all
documents that pass the base rules. Modified Kneser-Ney: three discounts per order from the counts of counts; pairs use counts, single words
the number of different words before them; both levels interpolated, the lowest with a uniform share. It grows with the corpus: no n-gram
is left out.

A document's score is its mean negative log probability per word (log-perplexity); each word is judged by the model of all
other occurrences, else every rare pair would be sure of itself. Documents outside their language's band are
rejected. A line in 1 / words gives the expected score, another one the variance about it, as short texts scatter more; the limits
are on the deviation in standard deviations. They come from the documents labelled good that pass the base rules and that `of_band`
picks (half of them; the other half is left for measuring): their TAIL and 1 - TAIL quantiles, moved outward by MARGIN of their
distance. A second band comes from all of a language's documents that pass: outside are those beyond both the quantiles and ROBUST interquartile
deviations from the median. What holds lies between the two, by the number n of good documents: n^2 / (n^2 + HALF_GOOD^2) of the first one, and
all of the second one without labels.

Base rules: fewer than `min_words` words, or over `max_repeat` percent of the words in 5-word windows that recur in the text.

Defined cases: a null text has no words and fails the base rules; a null language is a language of its own, and every
language has its own model and band; a document that fails the base rules adds nothing to the model and has no score (null);
an empty table gives an empty result; the row is kept in a struct, so its column names clash with nothing; repeated rows are judged alike.

How it runs. The texts are read once. Each scan task turns the words of a language into a chunk: a file with the sorted 48-bit hashes of its
different words and the sequence of their numbers, as compressed byte planes. All later steps read chunks. Twice, chunks send the
sorted hashes of what they hold with counts as delta-coded arrays, cut by ranges of the hash, to one group per language and range,
which merges them into the model's sorted hash arrays (`Model`, which is stored and scores other documents by searching them) and returns to each chunk the global values of its own keys: first for word pairs
(counts), then for words (occurrences, followers seen once, twice and more often, different words before). With those and the discounts a chunk scores its documents.

Scale: what is shuffled is a few bytes for each distinct pair of a chunk (at most CHUNK_WORDS words), whatever the keys' frequency, so hot
words cost no more than others. Ranges are made so that a group has at most GROUP keys; hashes get KEY_BITS bits more than the
number of words needs, so of a hundred unknown pairs less than one meets another's count, at any size (LEAST_BITS at least, so on small corpora hardly any does). Nothing but chunk names passes through the driver.
Files are named by their attempt, or hold the same bytes whoever writes them, so repeated tasks do no harm.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_few, materialise, open_fs, put, shared_dir, store, text_bytes

MIN_WORDS, MAX_REPEAT, WINDOW = 10, 20, 5
TAIL, MARGIN, HALF_GOOD, ROBUST = 0.005, 0.05, 75, 4.0
#: Words that a task holds before it writes its chunks; keys in a group; bits of a key beyond the number of words, and at least.
CHUNK_WORDS, GROUP, KEY_BITS, LEAST_BITS, WORD_BITS = 4 << 20, 1 << 20, 7, 38, 48
SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\r\x0b\x0c"
CONTINUED = bytes(range(0x80, 0xC0))


# base statistics


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of so many words found twice or more in the text, the first place included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    if len(names) == len(words):
        return 0
    if len(names) <= 1 << (63 // window):
        bits = 63 // window
        code = np.zeros(n, np.int64)
        for j in range(window):
            code |= ids[j : j + n] << (bits * j)
    else:  # numbers of pairs, of pairs of those, and so on: exact for any vocabulary
        code = ids[:n]
        for j in range(1, window):
            code = np.unique(code * np.int64(len(names)) + ids[j : j + n], return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += again
    edge[window : window + n] -= again
    return int((np.cumsum(edge)[:-1] > 0).sum())


def statistics(text: bytes, words: list[bytes] | None = None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split() if words is None else words
    seen, duplicates = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            duplicates += 1
        elif line and not line.isspace():
            seen.add(line)
    return len(words), len(text.translate(None, SPACES + CONTINUED)), len(text) - len(text.translate(None, SYMBOLS)), duplicates, repeated_words(words)


# model


def discounts(n: np.ndarray) -> np.ndarray:
    """Discount for counts 0, 1, 2, 3 and more (Chen and Goodman) from the numbers of n-grams that occur 1 to 4 times."""
    n = np.asarray(n, float)
    if not n.all():
        return np.array([0, 0.5, 0.75, 0.9])
    y = n[0] / (n[0] + 2 * n[1])
    d = np.array([0, 1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]])
    return np.clip(d, [0, 0.05, 0.05, 0.05], [0, 0.95, 1.95, 2.95])


def log_probability(count, total, followers, left, of_pairs, of_words, own: int = 1) -> np.ndarray:
    """Log probability of words after others, by the model of all but one occurrence of each pair; own = 0: by the whole model, for words of other texts.

    count: of the pairs; total and followers (n, 3): occurrences of the first words, and how many different words follow them once, twice,
    more often; left: different words before the second words. of_pairs, of_words: n-grams that occur 1 to 4 times, sum, number.
    """
    d2, d1 = discounts(of_pairs[:4]), discounts(of_words[:4])
    pairs, words = float(of_words[4]), float(of_words[5])
    rest = d1[1:] @ [of_words[0], of_words[1], words - of_words[0] - of_words[1]] / pairs
    # one occurrence less: the pair moves to the next lower class of followers, and a pair seen once has no first word any more
    less, followers = count - own, followers.astype(float)
    if own:
        left, total = np.maximum(left - (count == 1), 0), np.maximum(total - 1, less)
    for i in range(1, 4) if own else ():
        followers[:, i - 1] += (np.minimum(less, 3) == i).astype(float) - (np.minimum(count, 3) == i)
    p1 = (left - d1[np.minimum(left, 3)]) / pairs + rest / words
    known = total > 0
    p2 = (less - d2[np.minimum(less, 3)]) / np.maximum(total, 1) + np.maximum(followers, 0) @ d2[1:] / np.maximum(total, 1) * p1
    return np.log(np.where(known, p2, p1))


# arrays in few bytes


def squeeze(values: np.ndarray) -> bytes:
    """Unsigned integers as zstandard-compressed byte planes, as many as the largest value needs."""
    import zstandard

    values = np.ascontiguousarray(values, "<u8")
    planes = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    raw = values.view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes()
    return struct.pack("<BI", planes, len(values)) + zstandard.ZstdCompressor(level=1).compress(raw)


def expand(data: bytes) -> np.ndarray:
    import zstandard

    planes, n = struct.unpack_from("<BI", data)
    out = np.zeros((n, 8), np.uint8)
    if n and planes:
        out[:, :planes] = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[5:]), np.uint8).reshape(planes, n).T
    return out.view("<u8").reshape(-1)


def squeeze_sorted(keys: np.ndarray) -> bytes:
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def expand_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(expand(data), dtype=np.uint64)


# chunks


class Chunk:
    """Words of documents of one language: hashes of the different words (the last one stands for a text's start), numbers, text lengths."""

    def __init__(self, hashes: np.ndarray, ids: np.ndarray, lengths: np.ndarray):
        self.hashes, self.lengths, n = np.append(hashes, np.uint64(0)), lengths.astype(np.int64), len(hashes)
        before = np.empty(len(ids), np.int64)
        before[1:] = ids[:-1]
        self.starts = np.cumsum(self.lengths) - self.lengths
        before[self.starts] = n
        code, self.of = np.unique(before * (n + 1) + ids.astype(np.int64), return_inverse=True)
        self.first, self.second = code // (n + 1), code % (n + 1)

    def pair_keys(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes of the pairs, and the place of each pair among them."""
        x = self.hashes[self.first] * np.uint64(0x9E3779B97F4A7C15) + self.hashes[self.second] * np.uint64(0xC2B2AE3D27D4EB4F)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return np.unique((x ^ (x >> np.uint64(32))) >> np.uint64(64 - bits), return_inverse=True)

    def word_keys(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(self.hashes >> np.uint64(max(0, WORD_BITS - bits)), return_inverse=True)


def read_chunk(fs, root: str, name: str) -> Chunk:
    with fs.open_input_file(f"{root}/{name}") as source:
        data = source.read()
    sizes = struct.unpack_from("<3Q", data)
    at = np.cumsum([24, *sizes]).tolist()
    hashes, ids, lengths = (expand(data[a:b]) for a, b in zip(at, at[1:], strict=False))
    return Chunk(np.cumsum(hashes, dtype=np.uint64) & np.uint64((1 << WORD_BITS) - 1), ids, lengths)


def chunk_bytes(names: dict[bytes, int], ids: np.ndarray, lengths: list[int]) -> bytes:
    from xxhash import xxh64_intdigest

    hashes = np.fromiter((xxh64_intdigest(w) for w in names), np.uint64, len(names)) >> np.uint64(64 - WORD_BITS)
    hashes, place = np.unique(hashes, return_inverse=True)
    ids = place[ids]
    # frequent words first, so that most numbers are small; sorted within a class of frequency, so that differences are small
    order = np.lexsort((hashes, -np.log2(np.bincount(ids, minlength=len(hashes))).astype(np.int64)))
    number = np.empty(len(order), np.uint64)
    number[order] = np.arange(len(order))
    steps = np.diff(hashes[order], prepend=np.uint64(0)) & np.uint64((1 << WORD_BITS) - 1)
    parts = [squeeze(steps), squeeze(number[ids]), squeeze(np.array(lengths))]
    return struct.pack("<3Q", *map(len, parts)) + b"".join(parts)


class Chunks:
    """What a scan task holds: words of each language, until there are CHUNK_WORDS of them."""

    def __init__(self, path: str):
        self.path, self.open, self.held = path, {}, 0

    def add(self, slot: str, words: list[bytes]) -> tuple[str, int]:
        """Name of the chunk that takes the words, and their document's number there."""
        name, names, ids, lengths = self.open.setdefault(slot, (uuid.uuid4().hex, {}, [], []))
        ids.append(np.fromiter((names.setdefault(w, len(names)) for w in words), np.uint32, len(words)))
        lengths.append(len(words))
        self.held += len(words)
        return name, len(lengths) - 1

    def write(self) -> None:
        if not self.open:
            return
        fs, root = open_fs(self.path)
        fs.create_dir(root, recursive=True)
        for name, names, ids, lengths in self.open.values():
            with fs.open_output_stream(f"{root}/{name}") as sink:
                sink.write(chunk_bytes(names, np.concatenate(ids), lengths))
        self.open, self.held = {}, 0


def language_slots(lang_col: str = "lang"):
    """Column that names the model of a row: its language, one for null."""
    return F.when(F.col(lang_col).isNull(), "null").otherwise(F.concat(F.lit("lang "), F.col(lang_col)))


MARK = "slot string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chunk string, place int"


def marked(docs: DataFrame, path: str, text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """row (the columns, or those in keep) and mark (statistics, and the place in a chunk of a row that passes the base rules) of each document."""

    @F.pandas_udf(MARK)
    def mark(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        chunks = Chunks(path)
        for slots, texts in parts:
            out = []
            for slot, t in zip(slots, texts, strict=True):
                words = bytes(t).split()
                stats = statistics(bytes(t), words)
                passes = stats[0] >= MIN_WORDS and 100 * stats[4] <= MAX_REPEAT * stats[0]
                out.append((slot, *stats, *(chunks.add(slot, words) if passes else (None, None))))
                if chunks.held >= CHUNK_WORDS:
                    chunks.write()
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in MARK.split(", ")])
            yield frame.astype({"slot": object, "chunk": object, "place": "Int32"})
        chunks.write()

    row = F.struct(*docs.columns if keep is None else keep or [F.lit(0).alias("none")])
    return materialise(docs.select(row.alias("row"), mark(language_slots(lang_col), text_bytes(text_col)).alias("mark")), "perplexity-rows")


# global values of the chunks' keys

SENT = "slot string, part int, chunk string, bits int, parts int, keys binary, sums array<binary>"
FOUND = "slot string, part int, chunk string, bits int, parts int, keys binary, sums array<binary>, own binary, facts array<bigint>"
_types = {"string": pa.string(), "int": pa.int32(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary()), "array<bigint>": pa.list_(pa.int64()), "bigint": pa.int64()}


def _table(rows: list[tuple], schema: str):
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), _types[k]) for c, k in zip(columns, kinds, strict=True)], list(names))


def _cut(slot: str, chunk: str, bits: int, parts: int, keys: np.ndarray, columns: list[np.ndarray]) -> list[tuple]:
    """Rows for the groups of ranges of the sorted keys."""
    part = ((keys >> np.uint64(max(bits - 32, 0))) * np.uint64(parts)) >> np.uint64(min(bits, 32))
    edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])).tolist() if len(keys) else []
    return [(slot, int(part[a]), chunk, bits, parts, squeeze_sorted(keys[a:b]), [squeeze(c[a:b]) for c in columns]) for a, b in zip(edge, [*edge[1:], len(keys)], strict=True)]


def merged(table: pa.Table) -> pa.Table:
    """One range of a language's model (a row without chunk: sorted keys and sums), and for each chunk the sums of its keys."""
    rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
    sent = [expand_sorted(r["keys"]) for r in rows]
    keys, first, of = np.unique(np.concatenate(sent), return_index=True, return_inverse=True)
    sums = [np.bincount(of, np.concatenate([expand(r["sums"][c]) for r in rows]).astype(float), len(keys)).astype(np.int64) for c in range(len(rows[0]["sums"]))]
    own = np.zeros(len(of), bool)  # of the chunks that hold a key, one
    own[first] = True
    slot, part, bits, parts = (rows[0][c] for c in ("slot", "part", "bits", "parts"))
    last = sums[-1]
    facts = [*(int((last == i).sum()) for i in range(1, 5)), int(last.sum()), int((last > 0).sum())]
    out, at = [(slot, part, None, bits, parts, squeeze_sorted(keys), [squeeze(s) for s in sums], None, facts)], 0
    for r, k in zip(rows, sent, strict=True):
        of_row = of[at : at + len(k)]
        out.append((slot, part, r["chunk"], bits, parts, None, [squeeze(s[of_row]) for s in sums], np.packbits(own[at : at + len(k)]).tobytes(), None))
        at += len(k)
    return pa.Table.from_batches([_table(out, FOUND)])


def facts(found: DataFrame, name: str) -> DataFrame:
    """slot and the sums of the facts of all its ranges."""
    at = found.groupBy("slot").agg(*[F.sum(F.col("facts")[i]).alias(f"f{i}") for i in range(6)])
    return at.select("slot", F.array(*[f"f{i}" for i in range(6)]).alias(name))


def _answers(rows: list[dict]) -> tuple[list[np.ndarray], np.ndarray]:
    """Sums over all keys of a chunk, and where told its ownership of them, from the rows of its ranges."""
    rows = sorted(rows, key=lambda r: r["part"])
    parts = [[expand(s).astype(np.int64) for s in r["sums"]] for r in rows]
    own = [np.unpackbits(np.frombuffer(r["own"], np.uint8), count=len(p[0])).astype(bool) for r, p in zip(rows, parts, strict=True) if r.get("own")]
    return [np.concatenate(c) for c in zip(*parts, strict=True)], np.concatenate(own) if own else np.empty(0, bool)


@dataclass(frozen=True)
class Model:
    """The stored model: rows (slot, part, bits, parts, keys, sums, facts) of the ranges of each language, for word pairs and for words.

    keys are the sorted hashes of a range, sums the arrays beside them: counts of the pairs; of the words their occurrences, how many different words follow them
    once, twice and more often, and how many different words stand before them.
    """

    pairs: DataFrame
    words: DataFrame

    def save(self, path: str) -> None:
        store(self.pairs, f"{path}/pairs")
        store(self.words, f"{path}/words")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        return cls(spark.read.parquet(f"{path}/pairs"), spark.read.parquet(f"{path}/words"))

    def score(self, docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
        """row (docs' columns), mark and nll of documents that the model was not made from; null where the base rules fail or the language has no model.

        The documents become chunks; their keys go to the ranges of the model, each is searched in the sorted array, and what stands beside it goes back.
        A pair or word that the model doesn't know has counts of zero.
        """
        spark, path = docs.sparkSession, shared_dir(docs.sparkSession, "perplexity-files")
        rows = marked(docs, path, text_col, lang_col)
        sizes = self.pairs.groupBy("slot").agg(F.first("bits").alias("bits"), F.first("parts").alias("parts"))
        chunks = rows.where("mark.chunk IS NOT NULL").select(F.col("mark.slot").alias("slot"), F.col("mark.chunk").alias("chunk")).distinct()
        chunks = materialise(chunks.join(sizes, "slot"), "perplexity-asked")

        def ask(of_pairs: bool):
            def keys(batches):
                fs, root = open_fs(path)
                for r in (r for batch in batches for r in batch.to_pylist()):
                    bits, parts = (r["bits"], r["parts"]) if of_pairs else _of_words(r["bits"], r["parts"])
                    chunk = read_chunk(fs, root, r["chunk"])
                    yield _table(_cut(r["slot"], r["chunk"], bits, parts, (chunk.pair_keys if of_pairs else chunk.word_keys)(bits)[0], []), SENT)

            sent = chunks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "chunk").mapInArrow(keys, SENT)
            held = self.pairs if of_pairs else self.words
            return sent.groupBy("slot", "part").cogroup(held.groupBy("slot", "part")).applyInArrow(_searched, FOUND)

        _scores(chunks, ask(True), ask(False), facts(self.pairs, "of_pairs"), facts(self.words, "of_words"), path, 0)
        return rows.select("row", "mark", F.when(F.col("mark.slot").isin([r["slot"] for r in sizes.select("slot").collect()]), looked_up(path, ".nll", "<f8", "double")).alias("nll"))


def _of_words(bits: int, parts: int) -> tuple[int, int]:
    """Bits and ranges of the words of a language, from those of its pairs."""
    return min(bits, WORD_BITS), -(-parts // 8)


def _searched(sent: pa.Table, held: pa.Table) -> pa.Table:
    """For each chunk the sums of its keys in a range of the model, zero for a key that is not there."""
    model = held.to_pylist()
    known = expand_sorted(model[0]["keys"]) if model else np.empty(0, np.uint64)
    sums = [expand(c) for c in model[0]["sums"]] if model else [np.empty(0, np.uint64)] * 5
    out = []
    for r in sent.to_pylist():
        keys = expand_sorted(r["keys"])
        at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
        there = known[at] == keys if len(known) else np.zeros(len(keys), bool)
        out.append((r["slot"], r["part"], r["chunk"], r["bits"], r["parts"], None, [squeeze(np.where(there, c[at], np.uint64(0)) if len(known) else np.zeros(len(keys), np.uint64)) for c in sums], None, None))
    return pa.Table.from_batches([_table(out, FOUND)])


def fit_and_score(rows: DataFrame, path: str) -> tuple[DataFrame, Model]:
    """(chunk, slot) of all chunks, after a file with its documents' scores was written for each; and the model."""
    spark = rows.sparkSession
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = rows.where("mark.chunk IS NOT NULL").groupBy(F.col("mark.slot").alias("slot"), F.col("mark.chunk").alias("chunk")).agg(F.sum("mark.n_words").alias("n"))
    held = materialise(held, "perplexity-chunks")
    total, n_chunks = held.agg(F.sum("n"), F.count("*")).first()
    group = max(1, min(GROUP, (total or 0) // (3 * shuffled)))
    sizes = held.groupBy("slot").agg(F.sum("n").alias("all"))
    sizes = sizes.select("slot", F.least(F.greatest(F.ceil(F.log2("all")) + KEY_BITS, F.lit(LEAST_BITS)), F.lit(63)).cast("int").alias("bits"), F.ceil(F.col("all") / group).cast("int").alias("parts"))
    chunks = materialise(held.join(sizes, "slot").select("slot", "chunk", "bits", "parts"), "perplexity-sizes")
    tasks = max(shuffled, -(-n_chunks // 8))

    def send_pairs(batches):
        fs, root = open_fs(path)
        for batch in batches:
            for r in batch.to_pylist():
                chunk = read_chunk(fs, root, r["chunk"])
                keys, at = chunk.pair_keys(r["bits"])
                counts = np.bincount(at[chunk.of], minlength=len(keys))
                yield _table(_cut(r["slot"], r["chunk"], r["bits"], r["parts"], keys, [counts]), SENT)

    sent = chunks.repartition(tasks, "chunk").mapInArrow(send_pairs, SENT)
    pairs = materialise(sent.groupBy("slot", "part").applyInArrow(merged, FOUND), "perplexity-pairs")

    def send_words(table: pa.Table) -> pa.Table:
        found = table.to_pylist()
        slot, name, bits, parts = (found[0][c] for c in ("slot", "chunk", "bits", "parts"))
        chunk = read_chunk(*open_fs(path), name)
        (counts,), own = _answers(found)
        mine = own[at := chunk.pair_keys(bits)[1]]
        count, first, second = counts[at][mine], chunk.first[mine], chunk.second[mine]
        keys, at = chunk.word_keys(bits)
        add = lambda words, values: np.bincount(at[words], values, len(keys)).astype(np.int64)
        columns = [add(first, count), *(add(first, c.astype(float)) for c in (count == 1, count == 2, count > 2)), add(second, np.ones(len(second)))]
        return pa.Table.from_batches([_table(_cut(slot, name, *_of_words(bits, parts), keys, columns), SENT)])

    sent = pairs.where("chunk IS NOT NULL").groupBy("chunk").applyInArrow(send_words, SENT)
    words = materialise(sent.groupBy("slot", "part").applyInArrow(merged, FOUND), "perplexity-words")

    model = Model(pairs.where("chunk IS NULL").drop("chunk", "own"), words.where("chunk IS NULL").drop("chunk", "own"))
    told = lambda of: of.where("chunk IS NOT NULL")
    return _scores(chunks, told(pairs), told(words), facts(pairs.where("chunk IS NULL"), "of_pairs"), facts(words.where("chunk IS NULL"), "of_words"), path, 1), model


def _scores(chunks: DataFrame, pairs: DataFrame, words: DataFrame, of_pairs: DataFrame, of_words: DataFrame, path: str, own: int) -> DataFrame:
    """(chunk, slot), after a file with its documents' scores was written for each chunk (slot, chunk, bits, parts), from the sums of its keys."""

    def score(table: pa.Table) -> pa.Table:
        found = {k: [r for r in table.to_pylist() if r["kind"] == k] for k in range(3)}
        (facts_,) = found[0]
        fs, root = open_fs(path)
        chunk = read_chunk(fs, root, facts_["chunk"])
        (counts, *_), _ = _answers(found[1])
        sums, _ = _answers(found[2])
        at = chunk.pair_keys(facts_["bits"])[1]
        word = chunk.word_keys(facts_["bits"])[1]
        first, second = word[chunk.first], word[chunk.second]
        logp = log_probability(counts[at], sums[0][first], np.stack([s[first] for s in sums[1:4]], 1), sums[4][second], facts_["of_pairs"], facts_["of_words"], own)
        nll = -np.add.reduceat(logp[chunk.of], chunk.starts) / chunk.lengths
        put(fs, f"{root}/{facts_['chunk']}.nll", nll.astype("<f8").tobytes())
        return pa.Table.from_batches([_table([(facts_["chunk"], facts_["slot"])], "chunk string, slot string")])

    constant = chunks.join(of_pairs, "slot").join(of_words, "slot")
    none = lambda *names: [F.lit(None).cast(kind).alias(name) for name, kind in names]
    parts = constant.select(F.lit(0).alias("kind"), "chunk", "slot", "bits", "of_pairs", "of_words", *none(("part", "int"), ("sums", "array<binary>")))
    for kind, of in ((1, pairs), (2, words)):
        parts = parts.unionByName(of.select(F.lit(kind).alias("kind"), "chunk", "slot", "bits", *none(("of_pairs", "array<bigint>"), ("of_words", "array<bigint>")), "part", "sums"))
    return materialise(parts.groupBy("chunk").applyInArrow(score, "chunk string, slot string"), "perplexity-scored")


_last: dict = {}


def _array(path: str, name: str, kind: str) -> np.ndarray:
    """A chunk's file as an array; a worker keeps those it used last."""
    found = _last.pop((path, name), None)
    if found is None:
        fs, root = open_fs(path)
        with fs.open_input_file(f"{root}/{name}") as source:
            found = np.frombuffer(source.read(), kind)
        while len(_last) >= 64:
            _last.pop(next(iter(_last)))
    _last[path, name] = found
    return found


def looked_up(path: str, ending: str, kind: str, returns: str):
    """A function of (mark.chunk, mark.place): the document's value in the chunk's file, null without a chunk."""

    @F.pandas_udf(returns)
    def find(chunks: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else _array(path, c + ending, kind)[int(p)] for c, p in zip(chunks, places, strict=True)], dtype="boolean" if returns == "boolean" else "Float64")

    return find(F.col("mark.chunk"), F.col("mark.place"))


# bands


def base_failed(mark: str = "mark"):
    return (F.col(f"{mark}.n_words") < MIN_WORDS) | (100 * F.col(f"{mark}.n_repeat_words") > MAX_REPEAT * F.col(f"{mark}.n_words"))


def of_band(id_col: str = "doc_id"):
    """Whether a labelled document sets bands; the others are held out."""
    return F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(2)) == 0


#: Scores and 1 / words are whole millionths, so that sums don't depend on the order of the rows.
UNIT = 1_000_000


def _line(x: str, y: str, value: str, slope: str, only: str | None = None) -> list:
    """Least-squares line of y in x over exact sums, of the rows where `only` holds: its value at x = 0 and its slope."""
    x, y = (F.col(c) if only is None else F.when(F.col(only), F.col(c)) for c in (x, y))
    exact = lambda c: F.sum(c.cast("decimal(38,0)")).cast("double")
    n, sx, sy = F.count(x), exact(x), exact(y)
    cov, var = exact(x * y) - sx * sy / n, exact(x * x) - sx * sx / n
    steep = F.when(F.max(x) > F.min(x), cov / var).otherwise(0.0)
    return [((sy - steep * sx) / n).alias(value), steep.alias(slope)]


def label_weight(n_good):
    """How much the band of the documents labelled good counts against that of all: from 0 without any towards 1, half at HALF_GOOD. For numbers and columns."""
    return n_good * n_good / (n_good * n_good + HALF_GOOD * HALF_GOOD)


def bands(scored: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Band of each language, from scored (id, slot, n_words, nll): slot, value and slope of the line in 1 / words, var and
    var_slope of the variance about it, and the limits low and high of the deviation over its square root."""
    at = scored.select("id", "slot", F.round(F.col("nll") * UNIT).cast("long").alias("y"), F.round(UNIT / F.col("n_words")).cast("long").alias("x"))
    if labels is None:
        at = at.withColumn("good", F.lit(False))
    else:
        good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("id")).where(of_band("id")).distinct()
        at = at.join(good.withColumn("good", F.lit(True)), "id", "left").withColumn("good", F.coalesce("good", F.lit(False)))
    # two bands of each language, of all its documents and of the good ones, go through the same steps as "all <slot>" and "good <slot>"
    kinds = F.when(F.col("good"), F.array(F.lit("all"), F.lit("good"))).otherwise(F.array(F.lit("all")))
    at = materialise(at.select("slot", "y", "x", F.explode(kinds).alias("kind")).select(F.concat_ws(" ", "kind", "slot").alias("band"), "y", "x"), "perplexity-at")
    lines = materialise(at.groupBy("band").agg(F.count("*").alias("n"), *_line("x", "y", "value", "slope")), "perplexity-lines")
    r = F.col("y") - F.col("value") - F.col("slope") * F.col("x")
    apart = materialise(join_few(at, lines, "band").select("band", "x", r.alias("r"), F.round(r * r / UNIT).cast("long").alias("rr")), "perplexity-apart")
    spread = apart.groupBy("band").agg(F.avg(F.col("rr").cast("decimal(38,0)")).cast("double").alias("flat"), *_line("x", "rr", "var", "var_slope"))
    # a variance that falls below zero somewhere is no variance: the same for all lengths then
    fits = (F.col("var") > 0) & (F.col("var_slope") >= 0)
    spread = materialise(spread.select("band", F.greatest(F.when(fits, F.col("var")).otherwise(F.col("flat")), F.lit(1.0)).alias("var"), F.when(fits, F.col("var_slope")).otherwise(0.0).alias("var_slope")), "perplexity-spread")
    z = F.round(F.least(F.greatest(F.col("r") / F.sqrt(UNIT * (F.col("var") + F.col("var_slope") * F.col("x"))), F.lit(-50.0)), F.lit(50.0)), 3)
    # at most 100,001 values a language, so exact quantiles are bounded
    counted = join_few(apart, spread, "band").select("band", z.alias("z")).groupBy("band", "z").agg(F.count("*").alias("n"))
    q = counted.groupBy("band").agg(F.expr(f"percentile(z, array({TAIL}, 0.25D, 0.5D, 0.75D, {1 - TAIL}), n)").alias("q"))
    q = lines.join(spread, "band").join(q, "band").withColumns({"by_label": F.col("band").startswith("good "), "slot": F.expr("substr(band, instr(band, ' ') + 1)")})
    Q = lambda i: F.col("q")[i]
    wide, robust = MARGIN * (Q(4) - Q(0)), ROBUST * (Q(3) - Q(1)) / 1.349
    low = F.when(F.col("by_label"), Q(0) - wide).otherwise(F.least(Q(0), Q(2) - robust))
    high = F.when(F.col("by_label"), Q(4) + wide).otherwise(F.greatest(Q(4), Q(2) + robust))
    names = ["value", "slope", "var", "var_slope", "low", "high"]
    # a language whose documents all score alike rejects none of them
    q = q.select("slot", "by_label", "n", *names[:4], (low - 0.001).alias("low"), (high + 0.001).alias("high"))
    of = lambda name, label: F.max(F.when(F.col("by_label") == label, F.col(name)))
    both = q.groupBy("slot").agg(F.coalesce(of("n", True), F.lit(0)).cast("double").alias("n"), *[of(c, label).alias(f"{c}_{label}") for c in names for label in (True, False)])
    w = label_weight(F.col("n"))
    return both.select("slot", *[(w * F.coalesce(f"{c}_True", F.lit(0.0)) + (1 - w) * F.col(f"{c}_False")).alias(c) for c in names])


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of all documents that pass the base rules."""
    path = shared_dir(docs.sparkSession, "perplexity-files")
    return fit_and_score(marked(docs, path, text_col, lang_col, []), path)[1]


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None, labels: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """row (docs' columns, or those in keep), mark (statistics), base_failed, nll (mean negative log probability per word) and kept.

    labels (doc_id, quality 0 or 1) set the bands where they are given; id_col, which keep must hold, joins them.
    """
    path = shared_dir(docs.sparkSession, "perplexity-files")
    rows = marked(docs, path, text_col, lang_col, keep)
    chunks, _ = fit_and_score(rows, path)
    nll = looked_up(path, ".nll", "<f8", "double")
    scored = rows.where("mark.chunk IS NOT NULL").select(F.col(f"row.{id_col}").cast("long").alias("id"), "mark.slot", "mark.n_words", nll.alias("nll"))
    limits = chunks.join(bands(scored, labels), "slot")

    def verdicts(batches):
        fs, root = open_fs(path)
        for batch in batches:
            for r in batch.to_pylist():
                x = np.round(UNIT / read_chunk(fs, root, r["chunk"]).lengths)
                y = np.round(_array(path, r["chunk"] + ".nll", "<f8") * UNIT)
                z = (y - r["value"] - r["slope"] * x) / np.sqrt(UNIT * (r["var"] + r["var_slope"] * x))
                put(fs, f"{root}/{r['chunk']}.kept", ((z >= r["low"]) & (z <= r["high"])).tobytes())
            yield batch.select(["chunk"])

    shuffled = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    materialise(limits.repartition(shuffled, "chunk").mapInArrow(verdicts, "chunk string"), "perplexity-verdicts")
    kept = F.coalesce(looked_up(path, ".kept", "bool", "boolean"), F.lit(False))
    return rows.select("row", "mark", base_failed().alias("base_failed"), nll.alias("nll"), kept.alias("kept"))


def quality_query(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    judged = judge(docs, keep=["doc_id"], labels=labels)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("row.doc_id", *(F.col(f"mark.{c}").alias(c) for c in names), "base_failed", "kept", F.exp("nll").alias("perplexity"))


def passing(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that are kept; columns as they are."""
    return judge(docs, **options).where("kept").select("row.*")
