"""Tokenisation with the tokenizers library, with a memo of the pieces between single spaces.

Byte-level BPE first cuts a text by a pattern in which a space that stands between two other non-space characters always
begins a new pre-token, and no merge crosses pre-tokens. So the ids of such a text are the ids of its pieces (each with
its leading space) one after the other, and every distinct piece has to be encoded only once. Texts with other white
space at a piece's edge (double spaces, a space beside a line break) are encoded whole.

A piece of Latin letters, with or without ASCII punctuation after them, is one or two pre-tokens; the library's BPE model
takes those directly, without the pattern. All other pieces go through the whole tokenizer.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct pieces that a Python worker remembers; later ones are encoded anew in each batch.
MEMO = 150_000
#: Bytes of text that are encoded at once.
BATCH = 8 << 20
PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-&(-/:-@\[-`{-~]*)").fullmatch


def _open_edges(words: pa.Array) -> np.ndarray:
    """Words that are empty, or begin or end with white space or a control character."""
    odd = np.zeros(len(words), bool)
    for a, b in ((0, 1), (-1, None)):
        edge = pc.utf8_slice_codeunits(words, a, b).dictionary_encode()
        odd |= np.array([not c or c.isspace() or unicodedata.category(c)[0] in "ZC" for c in edge.dictionary.to_pylist()], bool)[np.asarray(edge.indices)]
    return odd


def _byte_alphabet() -> dict[int, int]:
    """Byte to the character that stands for it in a byte-level vocabulary: itself where printable, else 256 and up."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: b if b in printable else next(rest) for b in range(256)}


class Encoder:
    """encode(): ids of many texts as one flat array with offsets."""

    def __init__(self, path: str, special_as_text: bool = False, memo: int = MEMO):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if special_as_text:
            self.tokenizer.encode_special_tokens = True
        self.model, self.alphabet = self.tokenizer.model, _byte_alphabet()
        self.space, self.line_end = chr(self.alphabet[32]), self.whole(["\n"])[0]
        self.most, self.memo, self.tails = memo, {"": {}, " ": {}}, {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pre_token(self, s: str) -> bytes:
        s = s.replace(" ", self.space) if s.isascii() else s.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.model.tokenize(s)]).tobytes()

    def _plain(self, word: str, lead: str, new: dict[str, bytes]) -> bytes | None:
        """Ids of letters with punctuation behind them; None for any other word."""
        m = PLAIN(word)
        if not m:
            return None
        head, tail = m.groups()
        ids = self.memo[lead].get(head) or new.get(head)
        if ids is None:
            ids = new[head] = self._pre_token(lead + head)
        if not tail:
            return ids
        end = self.tails.get(tail)
        if end is None:
            end = self._pre_token(tail)
            if len(self.tails) < self.most:
                self.tails[tail] = end
        return ids + end

    def pieces(self, words: list[str], lead: str) -> list[bytes]:
        """Ids of each word with lead (a space or nothing) before it, as bytes."""
        memo = self.memo[lead]
        found = list(map(memo.get, words))
        new: dict[str, bytes] = {}
        first: dict[str, bytes] = {}
        rest = []
        for i, ids in enumerate(found):
            if ids is None:
                word = words[i]
                if "\n" in word:  # a line end between other characters is a pre-token of its own
                    head, *lines = word.split("\n")
                    parts = [self._plain(head, lead, new), *(self._plain(x, "", first) for x in lines)]
                    ids = None if None in parts else self.line_end.join(parts)
                else:
                    ids = self._plain(word, lead, new)
                if ids is None:
                    rest.append(i)
                else:
                    found[i] = ids
        for a in range(0, len(rest), 20_000):
            part = rest[a : a + 20_000]
            for i, ids in zip(part, self.whole([lead + words[i] for i in part]), strict=True):
                found[i] = ids
        if len(memo) < self.most:
            memo.update(new)
            memo.update(zip(words, found, strict=True))
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """texts: a string array without nulls. Returns (ids uint32, offsets int64 with one more entry than texts)."""
        n = len(texts)
        if not n:
            return np.empty(0, np.uint32), np.zeros(1, np.int64)
        split = pc.split_pattern(texts, " ")
        firsts = np.asarray(split.offsets, dtype=np.int64)
        firsts, flat = firsts - firsts[0], split.flatten()
        coded = flat.dictionary_encode()
        words, key = coded.dictionary.to_pylist(), np.asarray(coded.indices).astype(np.int64)
        odd = _open_edges(coded.dictionary)
        odd_docs = np.flatnonzero(np.add.reduceat(odd[key], firsts[:-1], dtype=np.int64)).tolist()
        # the first piece of a text has no leading space: numbers of its own; the last number is for texts that are encoded whole
        many = len(words)
        key[firsts[:-1]] += many
        for i in odd_docs:
            key[firsts[i] : firsts[i + 1]] = 2 * many
        there = np.zeros(2 * many + 1, bool)
        there[key] = True
        rank = np.cumsum(there) - 1
        after, first = np.flatnonzero(there[:many]), np.flatnonzero(there[many : 2 * many])
        parts = self.pieces([words[k] for k in after.tolist()], " ") + self.pieces([words[k] for k in first.tolist()], "") + [b""] * int(there[-1])
        store = np.frombuffer(b"".join(parts), np.uint32)
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        start = np.cumsum(size) - size
        rows = rank[key]
        begin, length = start[rows], size[rows]
        per_doc = np.add.reduceat(length, firsts[:-1])
        whole = {}
        for a in range(0, len(odd_docs), 64):
            whole.update(zip(odd_docs[a : a + 64], self.whole([texts[i].as_py() for i in odd_docs[a : a + 64]]), strict=True))
        for i, ids in whole.items():
            per_doc[i] = len(ids) // 4
        offsets = np.zeros(n + 1, np.int64)
        np.cumsum(per_doc, out=offsets[1:])
        ends = np.cumsum(length)
        source = np.arange(ends[-1], dtype=np.int64) + np.repeat(begin - (ends - length), length)
        if not whole:
            return store[source], offsets
        out, mask = np.empty(offsets[-1], np.uint32), np.ones(offsets[-1], bool)
        for i, ids in whole.items():
            out[offsets[i] : offsets[i + 1]] = np.frombuffer(ids, np.uint32)
            mask[offsets[i] : offsets[i + 1]] = False
        out[mask] = store[source]
        return out, offsets


@lru_cache(maxsize=2)
def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """One encoder in each Python worker; its memo lives as long as the worker."""
    return Encoder(path, special_as_text)


def default_tokenizer() -> str:
    """Path of the 50k byte-level BPE file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
