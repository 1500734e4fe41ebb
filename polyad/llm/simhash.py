"""SimHash near-duplicates through an inverted index over byte positions with count filtering.

Two 64-bit fingerprints that differ in at most 3 bits agree in at least 5 of their 8 bytes. The postings of single
(position, byte) pairs would hold a 256th of all fingerprints, so the index holds postings of four positions at once: of
the 4-subsets of the 8 positions, the 14 whose positions XOR to zero are such that any 5 positions contain one of them (any 3
positions lie in exactly one such set, and the sets are closed under complement). So each linked pair meets in a posting
list of one of 14 keys of 32 bits. Within a list the shared positional bytes of each pair are tallied, pairs with fewer
than the guaranteed 5 are put aside, and the rest is verified by Hamming distance.

A list of over LIST members, or of texts of over LIST_BYTES together, is cut into blocks, and each pair of blocks is a list of its own, so no task holds more and no pair is
lost. A list yields a spanning forest of its links (found by a search that takes every member out of the rest as soon as it is reached),
not all pairs; so its output is linear in its length, and so is its time where the members are close to each other. Links of
different lists are joined into components by alternating large-star and small-star steps over tables.

Fingerprints within 3 bits miss many near copies (texts that share 0.8 of their five-word shingles differ in ten bits and more). So
`deduplicated` adds a second kind of fingerprint to the same index: a byte sketch of 128 positional bytes, byte k from the k-th
min-hash of the five-word shingles. Two texts of similarity s agree at a position with probability s. Postings of four
positions at a time (KEYS keys: a pair at 0.8 is missed by all with probability 3e-5) give the pairs, whose shared positional bytes are tallied
over all 128. The tally only finds candidates (at 0.8 less DEVIATIONS standard deviations a pair is lost with probability 3e-4); a link is a pair
whose shingle sets, made again from the two texts, have a Jaccard similarity of `similarity` or more. First a spanning forest of
the pairs that are most likely links is verified. Then texts that still have candidates in another component meet again in
their lists, with their texts, and candidates of different components are verified there. What a list gives is linear in its
length in both; the comparisons in a list of texts that resemble each other a little less than `similarity` are all made.

Defined cases: a null or empty text has fingerprint 0 and is linked like any other; texts of one or two words hash their
whole word sequence; equal fingerprints are one node, whatever their number; a null doc_id keeps its row (the component id is
the smallest non-null doc_id reachable, null if there is none); an empty table gives an empty result; very long texts are hashed
in chunks.

Scale: texts are read once, map-only. Exact copies fall together in a partial aggregation before the index is built. The index
shuffles 14 rows of 17 bytes for each distinct fingerprint. Each star step's table is written to shared storage.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Rounds
from .common import join_skewed, materialise, text_bytes

SEED, SHINGLE, BITS = 42, 3, 3
CHUNK = 1 << 15
#: The byte sketch: positions, words in a shingle, similarity, bytes in a key, keys.
POSITIONS, WORDS, SIMILARITY, KEY, KEYS = 128, 5, 0.8, 4, 20
#: Standard deviations of a tally at the similarity: candidates have so many less, pairs of the first round so many more.
DEVIATIONS, SURE = 3.5, 1.0
WORD_MEMO = 100_000
#: Most members of a posting list that are compared in one place.
LIST = 1 << 16
#: Most bytes of texts in a list that are compared in one place (a single pair may have more).
LIST_BYTES = 32 << 20
#: Edges of which the components are found in one task.
AT_ONCE = 1 << 20
SETS = [(a, b, c, a ^ b ^ c) for a in range(8) for b in range(a + 1, 8) for c in range(b + 1, 8) if a ^ b ^ c > c]


def shingle_hashes(text: bytes, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each word shingle, repeats included; a shorter text is one shingle; no words, no hashes."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: A-Z and the ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins = np.concatenate([[0], ends[: -size]])
    return np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in zip(begins.tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)), np.uint64, len(begins))


def fingerprint(text: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    """Signed 64-bit fingerprint: a bit is 1 if it is set in over half the hashes."""
    hashes = shingle_hashes(text, size, seed)
    total = np.zeros(64, np.int64)
    for a in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[a : a + CHUNK].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        total += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint_column(text_col: str = "text", size: int = SHINGLE) -> Column:
    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(bytes(t), size) for t in texts], dtype="int64")

    return fp(text_bytes(text_col))


def _numbers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_FLIP, _TIMES, _PLACE = _numbers(POSITIONS, 11).astype(np.uint32), _numbers(POSITIONS, 12).astype(np.uint32), _numbers(64, 13)
_words: dict[bytes, int] = {}


def word_shingles(text: bytes, size: int = WORDS) -> np.ndarray:
    """A 64-bit hash of each word shingle, repeats included (a shorter text is one shingle); none without words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(_words) > WORD_MEMO:
        _words.clear()
    for w in set(words).difference(_words):
        _words[w] = xxh64_intdigest(w, SEED)
    codes = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(size, len(codes))
    n = len(codes) - width + 1
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h += codes[j : j + n] * _PLACE[j]
    return (h ^ (h >> np.uint64(31))) * _PLACE[-1]


def similar(a: bytes, b: bytes) -> tuple[int, int]:
    """Shared and all different word shingles of two texts: their quotient is the Jaccard similarity."""
    x, y = np.unique(word_shingles(a)), np.unique(word_shingles(b))
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared, len(x) + len(y) - shared


def sketch(text: bytes, size: int = WORDS) -> bytes | None:
    """Positional bytes of the min-hashes of the text's word shingles (a shorter text is one shingle); None without words."""
    return sketch_of(word_shingles(text, size))


def sketch_of(h: np.ndarray) -> bytes | None:
    if not len(h):
        return None
    h, n = (h >> np.uint64(32)).astype(np.uint32), len(h)
    least = np.full(POSITIONS, np.iinfo(np.uint32).max, np.uint32)
    for a in range(0, n, 512):
        part = h[a : a + 512, None] ^ _FLIP
        part *= _TIMES
        np.minimum(least, part.min(0), out=least)
    # the least values of long texts are small: mix before a byte is taken
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def marks_column(text_col: str = "text", size: int = SHINGLE) -> Column:
    """Struct of fp, sketch, and node: a 64-bit digest of the fingerprint and the set of word shingles."""
    from xxhash import xxh64_intdigest

    @F.pandas_udf("fp long, sketch binary, node long")
    def marks(texts: pd.Series) -> pd.DataFrame:
        fps, sketches, nodes = [], [], []
        for t in texts:
            hashes = word_shingles(bytes(t))
            fps.append(fingerprint(bytes(t), size))
            sketches.append(sketch_of(hashes))
            nodes.append(xxh64_intdigest(np.unique(hashes).tobytes(), fps[-1] % 2**64) - (1 << 63))
        return pd.DataFrame({"fp": pd.Series(fps, dtype="int64"), "sketch": pd.Series(sketches, dtype=object), "node": pd.Series(nodes, dtype="int64")})

    return marks(text_bytes(text_col))


def spanning(names: np.ndarray, reaches) -> list[tuple[int, int]]:
    """(member, root) edges over numbered members; reaches(i, rest) tells which of the members `rest` member i is linked to."""
    rest, out = np.arange(len(names)), []
    while len(rest) > 1:
        root, queue = rest[0], [rest[0]]
        rest = rest[1:]
        while queue and len(rest):
            near = reaches(queue.pop(), rest)
            if near.any():
                out += [(r, int(names[root])) for r in names[rest[near]].tolist()]
                queue += rest[near].tolist()
                rest = rest[~near]
    return out


def forest(fps: np.ndarray, bits: int = BITS, least: int = 8 - BITS) -> list[tuple[int, int]]:
    """(member, root) edges that join what links within `bits` connect; one edge less than members per component."""
    fps = np.unique(fps)

    def reaches(i, rest):
        x = fps[rest] ^ fps[i]
        near = (x.view(np.uint8).reshape(-1, 8) == 0).sum(1) >= least  # count filter, then verification
        near[near] = np.bitwise_count(x[near]) <= bits
        return near

    return spanning(fps.view(np.int64), reaches)


def sketch_forest(sketches: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(member, neighbour) edges of a spanning forest of sketches (a row each) that agree in `least` positions or more."""
    out, rest = [], np.arange(len(sketches))
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            near = (sketches[rest] == sketches[i]).sum(1) >= least
            out += [(r, int(i)) for r in rest[near].tolist()]
            queue += rest[near].tolist()
            rest = rest[~near]
    return out


def unsettled(sketches: np.ndarray, parts: np.ndarray, least: int) -> np.ndarray:
    """Which sketches agree with one of another part in `least` positions or more."""
    out = np.zeros(len(sketches), bool)
    for i in range(len(sketches)) if (parts != parts[:1]).any() else ():
        near = (parts != parts[i]) & ((sketches == sketches[i]).sum(1) >= least)
        out[i] = near.any()
    return out


def part_links(sketches: np.ndarray, parts: np.ndarray, texts: list[bytes], least: int, similarity: float) -> list[tuple[int, int]]:
    """Links (pairs whose shingle sets are similar) that join different parts; none between parts that are joined already."""
    parts, out, sets = parts.copy(), [], [np.unique(word_shingles(t)) for t in texts]
    for i in range(len(texts) - 1):
        other = i + 1 + np.flatnonzero(parts[i + 1 :] != parts[i])
        for r in other[(sketches[other] == sketches[i]).sum(1) >= least].tolist():
            if parts[r] != parts[i]:
                shared = len(np.intersect1d(sets[i], sets[r], assume_unique=True))
                if shared >= similarity * (len(sets[i]) + len(sets[r]) - shared):
                    out.append((r, i))
                    parts[parts == parts[r]] = parts[i]
    return out


def texts_of(used: DataFrame, texts: DataFrame, held: Rounds) -> DataFrame:
    """The texts (node, text) of the nodes in used, one for each; stored in held."""
    used = held.store(used.distinct(), "pair-nodes")
    # a broadcast bit map of at most 2^20 words keeps most other texts out of the shuffle
    word, bit = F.expr("shiftright(pmod(node, 67108864), 6)"), "cast(pmod(node, 64) as int)"
    words = used.groupBy(word.alias("__word")).agg(F.expr(f"bit_or(shiftleft(1L, {bit}))").alias("__bits"))
    texts = texts.withColumn("__word", word).join(F.broadcast(words), "__word").where(f"shiftright(__bits, {bit}) & 1 = 1")
    return held.store(texts.select("node", "text").dropDuplicates(["node"]).join(used, "node", "left_semi"), "pair-texts")


def verified(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of texts (node, text) whose word shingles have that Jaccard similarity or more."""

    def apply(batches):
        for batch in batches:
            a, b, one, two = (batch.column(i) for i in range(4))
            keep = []
            for x, y in zip(one, two, strict=True):
                shared, total = similar(x.as_py(), y.as_py())
                keep.append(total > 0 and shared >= similarity * total)
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(keep, pa.bool_())), b.filter(pa.array(keep, pa.bool_()))], ["a", "b"])

    held = Rounds(pairs.sparkSession)
    texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")), texts, held)
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("one")), "a")
    both = both.join(texts.select(F.col("node").alias("b"), F.col("text").alias("two")), "b")
    out = materialise(both.select("a", "b", "one", "two").mapInArrow(apply, "a long, b long"), "sketch-links")
    held.free()
    return out


def sketch_links(nodes: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Edges (a, b) over nodes (node, sketch) whose texts (node, text) have that similarity or more."""
    deviation = (similarity * (1 - similarity) / POSITIONS) ** 0.5
    least, sure = (int(POSITIONS * (similarity + d * deviation)) for d in (-DEVIATIONS, SURE))
    keys = F.array(*[F.struct(F.lit(k).cast("byte").alias("set"), F.substring("sketch", KEY * k + 1, KEY).alias("key")) for k in range(KEYS)])
    rows = nodes.where("sketch IS NOT NULL").select("node", F.inline(keys))
    # only members of lists of two or more fetch their sketch
    shared = rows.groupBy("set", "key").count().where("count > 1").drop("count")
    members = materialise(rows.join(shared, ["set", "key"]), "sketch-members")

    def over(rows: DataFrame, work, schema: str, most: int | None = None, size: Column | None = None) -> DataFrame:
        """What work(names, members) gives for each list, its members sorted by name: lists of the same members give the same."""
        extra = [c for c in rows.columns if c not in ("node", "set", "key")]
        lists = postings(rows.withColumnRenamed("node", "fp"), F.struct("fp", *extra), most, size).select("m.fp", *(f"m.{c}" for c in extra))

        def apply(batches):
            for batch in batches:
                found = []
                for i in range(batch.num_rows):
                    names = np.asarray(batch.column("fp")[i].values, dtype=np.int64)
                    order = np.argsort(names)
                    table = np.frombuffer(b"".join(batch.column("sketch")[i].as_py()), np.uint8).reshape(-1, POSITIONS)[order]
                    rest = {c: [v[o] for o in order] for c in extra if c != "sketch" for v in [batch.column(c)[i].as_py()]}
                    found += work(names[order].tolist(), table, **rest)
                columns = list(zip(*found, strict=True)) or [()] * len(schema.split(","))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [c.split()[0] for c in schema.split(", ")])

        return lists.mapInArrow(apply, schema)

    pairs = over(members.join(nodes.select("node", "sketch"), "node"), lambda names, t: [(names[i], names[j]) for i, j in sketch_forest(t, sure)], "a long, b long")
    pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    first = verified(materialise(pairs, "sketch-pairs"), texts, similarity)
    member = components(first, "sketch-parts").withColumnRenamed("root", "part")
    parts = nodes.select("node", "sketch").join(member, "node", "left").select("node", "sketch", F.coalesce("part", "node").alias("part"))
    members = members.join(parts, "node")
    left = over(members, lambda names, t, part: [(names[i],) for i in np.flatnonzero(unsettled(t, np.array(part), least))], "node long")
    held = Rounds(nodes.sparkSession)
    members = members.join(texts_of(left, texts, held), "node")
    second = over(members, lambda names, t, part, text: [(names[i], names[j]) for i, j in part_links(t, np.array(part), text, least, similarity)], "a long, b long", max(2, LIST // 16), F.length("text"))
    second = materialise(second.distinct(), "sketch-links")
    held.free()
    return first.unionByName(second)


def postings(rows: DataFrame, member: Column, most: int | None = None, size: Column | None = None) -> DataFrame:
    """Lists m of the members of rows with equal set and key (columns set, key, fp and what member needs), of two or more.

    A list of over `most` members, or of members of over LIST_BYTES bytes (size: those of a row), comes as the lists of all pairs of its blocks.
    """
    keys, most, size = ["set", "key"], most or LIST, F.lit(0) if size is None else size
    counted = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.sum(size).alias("__bytes"))
    long = materialise(counted.where((F.col("__n") > most) | ((F.col("__n") > 2) & (F.col("__bytes") > LIST_BYTES))), "long-lists")
    if not long.isEmpty():
        # a block of no more than one member on average is of no use
        blocks = F.least(F.ceil(F.greatest(F.col("__n") / most, F.col("__bytes") / LIST_BYTES) * 2), F.col("__n")).cast("int")
        own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
        rows = rows.join(long, keys, "left").withColumn("__pair", F.explode(F.coalesce(pairs, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"))))))
        keys = [*keys, "__pair"]
    return rows.groupBy(*keys).agg(F.collect_list(member).alias("m")).where(F.size("m") > 1).select("m")


def links(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """Edges (a, b), b < a in component order, over distinct fingerprints fp."""
    byte = lambda k: F.shiftrightunsigned("fp", 8 * k).bitwiseAND(F.lit(255))
    key = lambda s: sum((F.shiftleft(byte(p), 8 * i) for i, p in enumerate(s)), F.lit(0).cast("long"))
    keys = F.array(*[F.struct(F.lit(i).cast("byte").alias("set"), key(s).alias("key")) for i, s in enumerate(SETS)])
    lists = postings(nodes.select("fp", F.inline(keys)), F.col("fp"))

    def apply(batches):
        for batch in batches:
            edges = [e for fps in batch.column("m") for e in forest(np.asarray(fps.values, dtype=np.int64).view(np.uint64), bits)]
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["a", "b"])

    return lists.mapInArrow(apply, "a long, b long").distinct()


def _joined(batches):
    """node, root of the edges that come: labels sink along edges and jump to the label of their label."""
    found = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if not found:
        return
    nodes, at = np.unique(np.concatenate([x for pair in zip(*found, strict=True) for x in pair]), return_inverse=True)
    a, b = at[: len(at) // 2], at[len(at) // 2 :]
    label, last = np.arange(len(nodes)), None
    while last is None or (label != last).any():
        last, low = label, np.minimum(label[a], label[b])
        label = label.copy()
        for end in (last[a], last[b], a, b):
            np.minimum.at(label, end, low)
        while (label[label] != label).any():
            label = label[label]
    yield pa.RecordBatch.from_pydict({"node": nodes, "root": nodes[label]})


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for all nodes of the edges (a, b), the root being the least node: alternating large-star and small-star until nothing changes.

    At most AT_ONCE edges (16 MB) are solved in one task instead, with the same result. The steps settle after about log(nodes)^2 rounds at most; a table goes when it is no longer read.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    held = Rounds(edges.sparkSession)
    edges = held.store(edges.select(high.alias("a"), low.alias("b")).where("a <> b").distinct(), name)

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before, settled = state(edges), False
    if before[0] <= AT_ONCE:
        out = materialise(edges.coalesce(1).mapInArrow(_joined, "node long, root long"), name)
        held.free()
        return out
    while before[0] and not settled:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # stored, so that the join has an exchange of its own on either side, and a hub's rows can be dealt to several tasks
        least = held.store(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"{name}-least")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = held.store(large.where("a <> b").distinct(), f"{name}-large")
        least = held.store(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}-least")
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = held.store(small.where("a <> b").distinct(), name)
        after = state(edges)
        before, settled = after, after == before
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    out = materialise(edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots), name)
    held.free()
    return out


def classes(marked: DataFrame, bits: int = BITS, id_col: str = "doc_id", fp_col: str = "fp", sketch_col: str | None = None, similarity: float = SIMILARITY, text_col: str = "text", node_col: str = "node") -> DataFrame:
    """With sketch_col, rows are linked by the similarity of their texts too.

    Returns fp, component_id, the representative's fingerprint (rep_fp) and the number of rows n for each distinct fingerprint of the rows in marked."""
    rank = F.struct(F.col(id_col).isNull().alias("null"), F.col(id_col).cast("long").alias("id"), F.col(fp_col).alias("fp"))
    nodes = materialise(marked.groupBy(F.col(fp_col).alias("fp")).agg(F.min(rank).alias("least"), F.count("*").alias("n")), "simhash-nodes")
    edges = links(nodes.select("fp"), bits)
    if sketch_col:
        # different texts of one fingerprint are nodes of their own here; their links join the fingerprint's component
        of_text = materialise(marked.groupBy(F.col(node_col).alias("node")).agg(F.min(fp_col).alias("fp"), F.min(sketch_col).alias("sketch")), "simhash-texts")
        near = sketch_links(of_text, marked.select(F.col(node_col).alias("node"), text_bytes(text_col).alias("text")), similarity)
        for end in ("a", "b"):
            near = near.join(of_text.select(F.col("node").alias(end), F.col("fp").alias(f"fp_{end}")), end)
        edges = edges.unionByName(near.select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b")))
    member = components(edges, "simhash-links")
    linked = nodes.join(member, nodes["fp"] == member["node"])
    of_root = linked.groupBy("root").agg(F.min("least").alias("first"))
    of_node = linked.select("fp", "root").join(of_root, "root").select("fp", "first")
    first = F.coalesce("first", "least")
    return nodes.join(of_node, "fp", "left").select("fp", first["id"].alias("component_id"), first["fp"].alias("rep_fp"), "n")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """doc_id, fp, component_id of each row: documents whose fingerprints are linked by chains of at most `bits` differing bits."""
    marked = materialise(docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint_column(text_col, size).alias("fp")), "simhash")
    named = materialise(classes(marked, bits).select("fp", "component_id", "n"), "simhash-classes")
    return join_skewed(marked, named, "fp", "n").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, bits: int = BITS, similarity: float = SIMILARITY) -> DataFrame:
    """One row of docs for each class of near duplicates: the one with the smallest id; columns as they are.

    Near duplicates are linked by fingerprints within `bits`, or by a five-word similarity of at least `similarity`.

    Rows are written once with their fingerprint, then shuffled once by id and fingerprint to meet the representatives'.
    """
    id_ = F.col(id_col).cast("long")
    # a key without nulls: one partitioning serves the join and the window; the row stands apart, so that its names clash with nothing
    key = [F.coalesce(id_, F.lit(0).cast("long")).alias("id"), id_.isNull().alias("no_id")]
    marked = materialise(docs.select(F.struct(*docs.columns).alias("row"), *key, marks_column(text_col, size).alias("mark")).select("row", "id", "no_id", "mark.fp", "mark.sketch", "mark.node"), "simhash-rows")
    reps = classes(marked, bits, f"row.{id_col}", "fp", "sketch", similarity, f"row.{text_col}", "node").where("fp = rep_fp")
    reps = reps.select(F.coalesce("component_id", F.lit(0).cast("long")).alias("id"), F.col("component_id").isNull().alias("no_id"), F.col("rep_fp").alias("fp"))
    names = ["id", "no_id", "fp"]
    # the same row given twice: one of them
    once = Window.partitionBy(*names).orderBy(F.lit(1))
    return marked.drop("sketch", "node").join(reps, names, "left_semi").withColumn("n", F.row_number().over(once)).where("n = 1").select("row.*")


def simhash_query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
