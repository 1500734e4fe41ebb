"""Quality classifier by co-training.

Two views of a document: its text (byte frequencies, the words that tell most, hashed word 2-grams, and a few word ratios) and its metadata (language,
source, length). The words are hashed into BUCKETS; of all buckets those SELECTED become features whose presence depends most on the label (chi-squared, over
all labelled documents that train). Each view has a logistic regression of its own. In each round both views score all unlabelled documents, and those
of which a view's calibrated probability is confident become, with that pseudo-label, training rows of the *other* view, which is then
trained anew on its labelled and its pseudo-labelled rows. A view that can't be confident teaches nothing, so a weak view does no harm. After the
rounds each view is calibrated (Platt) on labelled rows it wasn't trained on, the calibrated logits are combined by a regression on
the same rows, and all documents are scored.

Training samples (documented bounds): a regression is fitted on about `most_labels` labelled rows at most and, for each pseudo-label, about
`most_taught` rows that carry it: those with the least hashes of id and features, so the same at every run. The pseudo-labels themselves are
given to all documents. A quarter of the labelled rows, by hash, only calibrates.

Defined cases: a null or empty text has zero features and is scored like any other; null metadata is a value of its own; labels
that are null are not used, and a document labelled twice counts as good if any label is; of the rows of a labelled id
the one with the least hash trains; of unlabelled ones all rows get pseudo-labels, and equal ones train once; without labels of both classes among the rows that train and among those that calibrate the score is 0.5 and every document is kept;
repeated rows are scored alike; an empty table gives an empty result; other columns are not read.

Scale: the texts are read twice, map-only: for features (a few hundred small numbers and the document's word buckets, stored) and for the final scores. Words are
counted by bucket and label in each task before they are shuffled, so the exchange is BUCKETS rows a task at most, and SELECTED come to the driver. Labels are joined
to the features by shuffle; rounds read the features only, twice each (how many are sure, then the rows of least hashes), and store nothing. Cuts of the hash's range, set by a count, bound what comes to the
driver: so many rows of features whatever the input.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_bytes

MOST_LABELS, MOST_TAUGHT = 8000, 2000
ROUNDS, CONFIDENT, L2 = 2, 0.97, 1e-2
LANGS, SOURCES, LENGTHS, GRAMS = 16, 64, 24, 64
#: Buckets of hashed words, how many of them are features, and in how many labelled documents such a bucket stands at least.
BUCKETS, SELECTED, LEAST_SEEN = 1 << 16, 512, 5
N_TEXT, N_META = 256 + GRAMS + 7, LANGS + SOURCES + LENGTHS
WORD_MEMO = 100_000
_words: dict[bytes, int] = {}


def text_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bytes 0 to 255: square roots of byte frequencies and of hashed 2-gram frequencies; ratios of distinct words, of words
    equal to the one before, of upper case and of letters; word and text length. And the sorted buckets of the text's words."""
    out, buckets = np.zeros(N_TEXT), np.empty(0, np.uint16)
    n = len(text)
    if not n:
        return out.astype(np.uint8), buckets
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    out[:256] = np.sqrt(counts / n)
    words = text.split()
    k = max(len(words), 1)
    distinct = set(words)
    if words:
        if len(_words) > WORD_MEMO:
            _words.clear()
        for w in distinct.difference(_words):
            _words[w] = zlib.crc32(w)
        codes = np.fromiter(map(_words.__getitem__, words), np.int64, len(words))
        pairs = (codes[:-1] * 31 + codes[1:]) % 65521 % GRAMS
        out[256 : 256 + GRAMS] = np.sqrt(np.bincount(pairs, minlength=GRAMS) / k)
        buckets = np.unique(codes % BUCKETS).astype("<u2")
    letters = counts[65:91].sum() + counts[97:123].sum()
    size = math.log1p(k) / 20
    ratio = len(distinct) / k
    out[-7:] = ratio, sum(map(bytes.__eq__, words, words[1:])) / k, counts[65:91].sum() / max(letters, 1), min(n / k, 50) / 50, min(size, 1), ratio * min(size, 1), letters / n
    return np.round(255 * out).astype(np.uint8), buckets


def with_words(dense: np.ndarray, sets: list[np.ndarray], words: np.ndarray) -> np.ndarray:
    """Dense features with a column for each selected bucket (sorted): whether the row's set holds it."""
    out = np.zeros((len(dense), dense.shape[1] + len(words)))
    out[:, : dense.shape[1]] = dense
    if len(words) and len(sets):
        found = np.concatenate(sets).astype(np.int64)
        at = np.minimum(np.searchsorted(words, found), len(words) - 1)
        hit = words[at] == found
        out[np.repeat(np.arange(len(sets)), [len(s) for s in sets])[hit], dense.shape[1] + at[hit]] = 255
    return out


def meta_features(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """Hashed language and source, and the length's power of two, each as an indicator."""
    out = np.zeros(N_META)
    slot = lambda x, n: zlib.crc32((x if x is not None else "\0").encode()) % n
    out[slot(lang, LANGS)] = 1
    out[LANGS + slot(source, SOURCES)] = 1
    out[LANGS + SOURCES + min(LENGTHS - 1, int(n_chars or 0).bit_length() if not pd.isna(n_chars) else 0)] = 1
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = L2, steps: int = 12) -> np.ndarray:
    """Weights with the intercept last, by Newton's method; l2 is a penalty per row."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], l2 * len(x))
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge) + 1e-9 * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class View:
    """A standardised logistic regression with its calibration."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    calibration: tuple[float, float] = (1.0, 0.0)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, l2: float = L2) -> View:
        mean, scale = x.mean(0), x.std(0)
        scale[scale < 1e-6] = np.inf  # a constant feature has no say
        return cls(mean, scale, logistic((x - mean) / scale, y, l2))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -30, 30) @ self.weights[:-1] + self.weights[-1]

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> View:
        z = self.raw(x)
        spread = z.std() or 1.0
        a, b = logistic(z[:, None] / spread, y, 1e-3)
        self.calibration = (float(a) / spread, float(b))
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.calibration[0] * self.raw(x) + self.calibration[1], -12, 12)


@dataclass
class CoTrained:
    text: View | None = None
    meta: View | None = None
    combine: np.ndarray | None = None
    threshold: float = 0.5
    taught: list = field(default_factory=list)
    words: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    def scores(self, texts: np.ndarray, metas: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Combined probability of good quality, and those of the two views."""
        if self.text is None:
            half = np.full(len(texts), 0.5)
            return half, half, half
        a, b = self.text.logit(texts), self.meta.logit(metas)
        return _sigmoid(np.stack([a, b, np.ones(len(a))], 1) @ self.combine), _sigmoid(a), _sigmoid(b)

    def column(self, text: str = "text", lang: str = "lang", source: str = "source", n_chars: str = "n_chars") -> Column:
        """Struct of score, p_text, p_meta, kept for a document's columns."""

        @F.pandas_udf("score double, p_text double, p_meta double, kept boolean")
        def scored(texts: pd.Series, langs: pd.Series, sources: pd.Series, sizes: pd.Series) -> pd.DataFrame:
            out = []
            for a in range(0, len(texts), 1000):  # features of a thousand rows at a time
                dense, sets = zip(*[text_features(bytes(t)) for t in texts[a : a + 1000]], strict=True)
                x = with_words(np.array(dense), sets, self.words)
                m = np.array([meta_features(*v) for v in zip(langs[a : a + 1000], sources[a : a + 1000], sizes[a : a + 1000], strict=True)]).reshape(-1, N_META)
                p, pt, pm = self.scores(x, m)
                out.append(pd.DataFrame({"score": p, "p_text": pt, "p_meta": pm, "kept": p >= self.threshold}))
            return pd.concat(out) if out else pd.DataFrame({"score": [], "p_text": [], "p_meta": [], "kept": []})

        return scored(text_bytes(text), F.col(lang).cast("string"), F.col(source).cast("string"), F.col(n_chars).cast("long"))


def matrices(rows: pa.Table, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and metadata features of rows (x, w, lang, source, n_chars); words: the selected buckets."""
    x = np.frombuffer(b"".join(v.as_py() for v in rows["x"]), np.uint8).reshape(-1, N_TEXT)
    x = with_words(x, [np.frombuffer(v.as_py(), "<u2") for v in rows["w"]], words)
    m = np.array([meta_features(*v) for v in zip(*(rows[c].to_pylist() for c in ("lang", "source", "n_chars")), strict=True)]).reshape(-1, N_META)
    return x, m


def telling_words(known: DataFrame, selected: int = SELECTED) -> np.ndarray:
    """The buckets whose presence depends most on the label, of labelled rows (w, y) that train; sorted."""

    def count(batches):
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for w, y in zip(batch.column("w"), batch.column("y").to_pylist(), strict=True):
                total[1 if y else 0, np.frombuffer(w.as_py(), "<u2")] += 1
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_pydict({"bucket": at, "bad": total[0, at], "good": total[1, at]})

    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    bad, good = float(n.get(0, 0)), float(sum(v for k, v in n.items() if k))
    if not selected or not bad or not good:
        return np.empty(0, np.int64)
    sums = known.select("w", "y").mapInArrow(count, "bucket long, bad long, good long").groupBy("bucket").agg(F.sum("bad").alias("b"), F.sum("good").alias("g"))
    b, g, total = F.col("b"), F.col("g"), bad + good
    held, left = b + g, total - b - g
    chi = F.pow(g * bad - b * good, 2) * total / (held * left * bad * good)
    top = sums.where((held >= LEAST_SEEN) & (left >= LEAST_SEEN)).orderBy(chi.desc(), "bucket").limit(selected).select("bucket").collect()  # `selected` rows
    return np.array(sorted(r["bucket"] for r in top), np.int64)


def pseudo_labels(views: dict[str, View], x: np.ndarray, m: np.ndarray, confident: float = CONFIDENT) -> dict[str, np.ndarray]:
    """What each view is taught about the rows: the other view's label where that is confident, else -1."""
    out = {}
    for teacher, pupil, rows in (("text", "meta", x), ("meta", "text", m)):
        p = _sigmoid(views[teacher].logit(rows))
        out[pupil] = np.where(p >= confident, 1, np.where(p <= 1 - confident, 0, -1))
    return out


def featured(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", text: str = "text", lang: str = "lang", source: str = "source", n_chars: str = "n_chars") -> DataFrame:
    """The rows (id, x, w, lang, source, n_chars) of docs, with their label y or null and a rank: a hash in 0 to 1, the same for equal rows."""

    @F.pandas_udf("x binary, w binary")
    def features(texts: pd.Series) -> pd.DataFrame:
        found = [text_features(bytes(t)) for t in texts]
        return pd.DataFrame({"x": pd.Series([x.tobytes() for x, _ in found], dtype=object), "w": pd.Series([w.tobytes() for _, w in found], dtype=object)})

    names = ["id", "x", "w", "lang", "source", "n_chars"]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), features(text_bytes(text)).alias("f"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), F.col(n_chars).cast("long").alias("n_chars"))
    rows = rows.select("id", "f.x", "f.w", "lang", "source", "n_chars")
    given = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    rank = (F.xxhash64("id", "x").bitwiseAND(F.lit((1 << 48) - 1)) / float(1 << 48)).alias("rank")
    # by shuffle at any size: a hot or null id is split as a skewed key
    return materialise(rows.join(given.hint("merge"), "id", "left").select(*names, "y", rank), "cotrain-features")


def least_ranked(of: DataFrame, most, *columns: str) -> pa.Table:
    """The different rows of rank below `most` (a number or column: rows wanted over rows there are), in the order of their ranks."""
    table = of.where(F.col("rank") < most).select("rank", "id", *columns).distinct().toArrow()
    return table.sort_by([("rank", "ascending"), ("id", "ascending")])


def first_of_id(rows: DataFrame) -> DataFrame:
    """Of each id, the row with the least rank."""
    return rows.groupBy("id").agg(F.min(F.struct("rank", "x", "w", "lang", "source", "n_chars", "y")).alias("r")).select("id", "r.*")


def held_out(rank: str = "rank") -> Column:
    """Whether a labelled row calibrates and trains nothing."""
    return F.floor(F.col(rank) * (1 << 20)) % 4 == 3


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", most_labels: int = MOST_LABELS, most_taught: int = MOST_TAUGHT, text: str = "text", lang: str = "lang", source: str = "source", n_chars: str = "n_chars", rounds: int = ROUNDS, confident: float = CONFIDENT, threshold: float = 0.5, selected: int = SELECTED) -> CoTrained:
    """Train on documents with labels (id_col, label_col: 1 good, 0 bad)."""
    rows = featured(docs, labels, id_col, label_col, text, lang, source, n_chars)
    free, known = rows.where("y IS NULL"), first_of_id(rows.where("y IS NOT NULL"))

    known = materialise(known.withColumn("held", held_out()), "cotrain-known")
    sample = least_ranked(known, most_labels / max(known.count(), 1), "x", "w", "lang", "source", "n_chars", "y", "held")
    words = telling_words(known.where("NOT held"), selected)
    x, m = matrices(sample, words)
    y, held = np.array(sample["y"].to_pylist(), float), np.array(sample["held"].to_pylist(), bool)
    if any(len(np.unique(y[s])) < 2 for s in (held, ~held)):
        return CoTrained(threshold=threshold)
    own, views, taught = {"text": x, "meta": m}, {}, []
    extra = {v: (np.empty((0, f.shape[1])), np.empty(0)) for v, f in own.items()}  # pseudo-labelled rows of each view
    for r in range(rounds + 1):
        for v, f in own.items():
            views[v] = View.fit(np.vstack([f[~held], extra[v][0]]), np.concatenate([y[~held], extra[v][1]])).calibrate(f[held], y[held])
        if r == rounds:
            break
        given = _taught(free, views, words, confident)
        counts = {(c["view"], c["label"]): c["n"] for c in given.groupBy("view", "label").agg(F.count("*").alias("n")).collect()}
        taught.append({v: sum(n for (w, _), n in counts.items() if w == v) for v in own})
        if not counts:
            break
        share = F.lit(0.0)
        for (v, label), n in counts.items():
            share = F.when((F.col("view") == v) & (F.col("label") == label), most_taught / n).otherwise(share)
        rows_of = least_ranked(given, share, "view", "label", "x", "w", "lang", "source", "n_chars")
        for k, v in enumerate(own):
            parts = [(label, rows_of.filter((pc.field("view") == v) & (pc.field("label") == label))) for label in (1, 0)]
            extra[v] = np.vstack([matrices(t, words)[k] for _, t in parts]), np.concatenate([np.full(len(t), float(label)) for label, t in parts])
    logits = np.stack([views["text"].logit(x[held]), views["meta"].logit(m[held])], 1)
    return CoTrained(views["text"], views["meta"], logistic(logits, y[held], 1e-3), threshold, taught, words)


def _taught(free: DataFrame, views: dict[str, View], words: np.ndarray, confident: float) -> DataFrame:
    """All pseudo-labelled rows: view (the one that is taught), label, and the row with the features which that view reads."""
    schema = "view string, label int, id long, rank double, x binary, w binary, lang string, source string, n_chars long"

    def apply(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for view, labels in pseudo_labels(views, *matrices(table, words), confident).items():
                at = np.flatnonzero(labels >= 0)
                part = table.take(pa.array(at))
                none = lambda kind, n=len(at): pa.nulls(n, kind)
                rest = [part["x"].combine_chunks(), part["w"].combine_chunks(), none(pa.string()), none(pa.string()), none(pa.int64())] if view == "text" else [pa.array([bytes(N_TEXT)] * len(at), pa.binary()), pa.array([b""] * len(at), pa.binary()), *(part[c].combine_chunks() for c in ("lang", "source", "n_chars"))]
                yield pa.RecordBatch.from_arrays([pa.array([view] * len(at), pa.string()), pa.array(labels[at], pa.int32()), part["id"].combine_chunks(), part["rank"].combine_chunks(), *rest], [c.split()[0] for c in schema.split(", ")])

    return free.mapInArrow(apply, schema)


def passing(docs: DataFrame, model: CoTrained) -> DataFrame:
    """The rows of docs that the model keeps; columns as they are."""
    return docs.select(F.struct(*docs.columns).alias("row"), model.column().alias("scored")).where("scored.kept").select("row.*")


def quality_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels)
    scored = docs.select("doc_id", model.column().alias("scored"))
    return scored.select("doc_id", *(F.col(f"scored.{c}").alias(c) for c in ("score", "p_text", "p_meta", "kept")))
