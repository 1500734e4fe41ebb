"""License scan: exact set-similarity join of text blocks with license templates, in DataFrame functions only.

Words are maximal runs of ASCII digits, ASCII letters (lower-cased) and non-ASCII characters. Two parts:

* base: places where the words of a fixed phrase stand one after the other;
* join: a text's words are cut into blocks: windows that overlap by half, of a length that depends on the template (block_of: 64
  words, or more for templates of over 32 words), so that any template that stands in the text, however long, lies in one of its blocks
  whole. A template is found where the block's word set contains at least `threshold` of the template's distinct words; blocks
  are the windows on that grid, and every one of them that meets the threshold is found.

The join is the prefix-filter join. All template words are ordered by their document frequency over the whole corpus,
rarest first. If a block holds `need` of a template's t words, it holds one of the template's first t - need + 1 words in
that order, so only those words are join keys (prefix filter). A pair is dropped where the block has fewer than `need` words of
the vocabulary (length filter), or where the words that are left behind the first common word, on either side, are too few
(positional filter). What remains is verified by intersection. Every filter is a bound, so no match is lost.

Defined cases: a null text has no words: counts 0, first_word and last_word null, empty labels, score 0; a null doc_id keeps
its row; repeated rows each keep theirs; very long texts are more blocks; other columns are not read; an empty table gives
an empty result.

Scale: two scans (document frequencies, then words and blocks). The words of templates are a parameter of fixed size, so the
frequency table and the prefix index have at most as many rows as there are template words. Only blocks of texts that hold a prefix
word are built. Results per text are joined back by id and text hash, narrow rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

# Phrases of the contract, and sentences, headers and whole texts of common licences, in lower-case words.
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
_BSD_START = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
_BSD_TWO = "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_NAME = "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_END = "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_MIT_START = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
_MIT_END = "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
TEMPLATES = (
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("bsd", _BSD_START),
    ("bsd-2", f"{_BSD_START} {_BSD_TWO} {_BSD_END}"),
    ("bsd-3", f"{_BSD_START} {_BSD_TWO} {_BSD_NAME} {_BSD_END}"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program if not see http www gnu org licenses"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("mit", "released under the mit license"),
    ("mit", _MIT_START),
    ("mit", f"{_MIT_START} {_MIT_END}"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
)
THRESHOLD = 0.85
#: Words of the shortest block; a longer template's block has twice as many words as the next power of two.
BLOCK = 64
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str | Column) -> Column:
    """Array of the lower-cased words of a text; null is the empty text."""
    text = F.col(text) if isinstance(text, str) else text
    # lower() would turn the Kelvin sign into an ASCII k; the angstrom sign stays outside ASCII
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("Å")))
    return F.array_remove(F.split(low, SEPARATORS), "")


def _strings(values) -> Column:
    return F.split(F.lit(" ".join(values)), " ") if values else F.array().cast("array<string>")


def need(n: int, threshold: float) -> int:
    return -int(-n * threshold // 1)


def block_of(template: str, least: int = BLOCK) -> int:
    """Words in the blocks that a template is compared with: at least twice its own, so that half-overlapping blocks hold it whole."""
    return max(least, 2 << (len(template.split(" ")) - 1).bit_length())


def phrase_starts(w: Column, phrase: str) -> Column:
    """Word positions at which the phrase's words stand one after the other."""
    parts = phrase.split(" ")
    fits = lambda i: F.array_join(F.slice(w, i + 1, F.lit(len(parts))), " ") == phrase
    # only positions of the first word are tried
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0))), lambda i: (F.get(w, i) == parts[0]) & fits(i))
    return F.when(F.arrays_overlap(w, _strings(parts[:1])), places).otherwise(F.array().cast("array<int>"))


def blocks_of(w: Column, size: int, vocabulary: Column) -> Column:
    """(block, tokens) of the windows of `size` words that overlap by half: the words of the vocabulary in them, in its order."""
    at = F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(size // 2))
    return F.transform(at, lambda s: F.struct(F.lit(size).alias("block"), F.array_intersect(vocabulary, F.slice(w, s + 1, F.lit(size))).alias("tokens")))


def word_order(docs: DataFrame, text_col: str, vocabulary: list[str]) -> list[str]:
    """The vocabulary by document frequency over all documents, rarest first, ties by the word."""
    found = docs.select(F.explode(F.array_intersect(words(text_col), _strings(vocabulary))).alias("word")).groupBy("word").count()
    count = {r["word"]: r["count"] for r in found.collect()}  # at most len(vocabulary) rows
    return sorted(vocabulary, key=lambda w: (count.get(w, 0), w))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict = PHRASES, templates: tuple = TEMPLATES, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of docs."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = word_order(docs, "text", sorted({w for _, t in templates for w in t.split(" ")}))
    rank = {w: i for i, w in enumerate(order)}
    sets = [sorted({*t.split(" ")}, key=rank.get) for _, t in templates]
    prefixes = [s[: len(s) - need(len(s), threshold) + 1] for s in sets]

    w = F.col("w")
    starts = {label: F.array_sort(phrase_starts(w, p)) for label, p in phrases.items()}
    sizes = [block_of(t, block) for _, t in templates]
    held = {b: _strings([x for x in order if any(b == z and x in s for z, s in zip(sizes, sets, strict=True))]) for b in sorted({*sizes})}
    windows = F.flatten(F.array(*[blocks_of(w, b, v) for b, v in held.items()]))
    gate = F.arrays_overlap(w, _strings(sorted({x for p in prefixes for x in p})))
    facts = (
        docs.select("doc_id", F.xxhash64("text").alias("h"), words("text").alias("w"))
        .select("doc_id", "h", F.size("w").cast("long").alias("n_words"), F.array(*[F.struct(F.lit(k).alias("label"), v.alias("at")) for k, v in starts.items()]).alias("base"), F.when(gate, windows).alias("blocks"))
        .select("doc_id", "h", "n_words", F.flatten(F.transform("base", lambda b: b["at"])).alias("at"), F.transform(F.filter("base", lambda b: F.size(b["at"]) > 0), lambda b: b["label"]).alias("base_labels"), "blocks")
    )
    facts = materialise(facts, "license-facts")

    rows = [F.struct(F.lit(" ".join(s)).alias("words"), F.lit(len(s)).alias("size"), F.lit(need(len(s), threshold)).alias("need"), F.lit(label).alias("label"), F.lit(b).alias("block")) for s, b, (label, _) in zip(sets, sizes, templates, strict=True)]
    table = spark.range(1).select(F.inline(F.array(*rows))).withColumn("set", F.split("words", " "))
    # as many rows as the templates have prefix words
    prefix_index = table.select("size", "need", "label", "block", "set", F.posexplode(F.slice("set", F.lit(1), F.col("size") - F.col("need") + 1)).alias("i", "word"))
    blocks = facts.where(F.col("blocks").isNotNull()).select("doc_id", "h", F.inline(F.array_distinct("blocks")))
    keys = blocks.select("doc_id", "h", "block", "tokens", F.size("tokens").alias("held"), F.posexplode("tokens").alias("j", "word"))
    left = F.least(F.col("size") - F.col("i"), F.col("held") - F.col("j"))
    pairs = keys.join(F.broadcast(prefix_index), ["word", "block"]).where((F.col("held") >= F.col("need")) & (left >= F.col("need")))
    common = F.size(F.array_intersect("set", "tokens"))
    found = pairs.select("doc_id", "h", "label", "need", (common / F.col("size")).alias("score"), common.alias("common")).where(F.col("common") >= F.col("need"))
    found = found.groupBy("doc_id", "h").agg(F.max("score").alias("score"), F.collect_set("label").alias("found")).withColumnsRenamed({"doc_id": "id2", "h": "h2"})

    joined = facts.drop("blocks").join(found, F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2")), "left")
    none = F.array().cast("array<string>")
    listed = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return joined.select(
        "doc_id",
        "n_words",
        F.size("at").cast("long").alias("n_base"),
        F.array_min("at").cast("long").alias("first_word"),
        F.array_max("at").cast("long").alias("last_word"),
        listed(F.col("base_labels")).alias("base_labels"),
        listed(F.concat("base_labels", F.coalesce("found", none))).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def _sql() -> str:
    kept = lambda k, p: f"list_filter(range(0, n), lambda i: array_to_string(list_slice(w, i + 1, i + {len(p.split(' '))}), ' ') = '{p}')"
    base = ", ".join(f"{kept(k, p)} AS b{i}" for i, (k, p) in enumerate(PHRASES.items()))
    labels = ", ".join(f"CASE WHEN len(b{i}) > 0 THEN '{k}' END" for i, k in enumerate(PHRASES))
    at = " || ".join(f"b{i}" for i in range(len(PHRASES)))
    values = ", ".join(f"('{k}', {block_of(t)}, {sorted({*t.split(' ')})})" for k, t in TEMPLATES)
    return f"""
WITH ws AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
d AS (SELECT doc_id, w, len(w) AS n FROM ws),
b AS (SELECT doc_id, n, {base} FROM d),
b2 AS (SELECT doc_id, n, {at} AS places, list_filter([{labels}], lambda x: x IS NOT NULL) AS base_labels FROM b),
t(label, size, s) AS (VALUES {values}),
win AS (SELECT doc_id, size, list_distinct(list_slice(w, p + 1, p + size)) AS blk
        FROM (SELECT doc_id, size, w, unnest(range(0, greatest(n, 1), size // 2)) AS p FROM d, (SELECT DISTINCT size FROM t))),
m AS (SELECT doc_id, label, len(list_intersect(s, blk)) / len(s)::DOUBLE AS score FROM win JOIN t USING (size)
      WHERE len(list_intersect(s, blk)) >= ceil(len(s) * {THRESHOLD})),
g AS (SELECT doc_id, max(score) AS score, list(DISTINCT label) AS found FROM m GROUP BY doc_id)
SELECT doc_id, n AS n_words, len(places) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
       array_to_string(list_sort(list_distinct(base_labels)), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(base_labels || coalesce(found, []))), ',') AS labels, coalesce(score, 0.0) AS score
FROM b2 LEFT JOIN g USING (doc_id)
"""


SQL = _sql()
