import random

import numpy as np
import pyarrow as pa
import pytest

from polyad.llm.tokens import Encoder, default_tokenizer

TEXTS = ["", "a", " a", "a  b", "x \n y", "foo bar.\nBaz q", "tab\t x", " x y", "<|endoftext|> b <|endoftext|>", "it's don't 're ok 12 34  ", "日本 語 x y z", "\n\n", "a b\n", "é è à", "foo, bar!! baz*** (qux) #1", "x  y ​ z", "Don't can't", "a\x1c b", "　a b", "ǅ ǆ", "a 'b c", "naïve café’s “quoted” — dash"]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_tokenizer())


@pytest.mark.parametrize("memo", [0, 10, 100_000])
def test_memo_gives_the_library_ids(plain, memo):
    rng = random.Random(5)
    alphabet = list("ab c  d.,'\n\té1*") + [" the", " of", "日"]
    texts = TEXTS + ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(400)]
    encoder = Encoder(default_tokenizer(), memo=memo)
    for _ in range(2):
        ids, offsets = encoder.encode(pa.array(texts))
        for k, text in enumerate(texts):
            assert ids[offsets[k] : offsets[k + 1]].tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_slices_and_empty():
    encoder = Encoder(default_tokenizer())
    all_ids, offsets = encoder.encode(pa.array(TEXTS))
    ids, part = encoder.encode(pa.array(TEXTS).slice(5, 6))
    assert np.array_equal(ids, all_ids[offsets[5] : offsets[11]]) and part[0] == 0
    assert len(encoder.encode(pa.array([], pa.string()))[0]) == 0


def test_special_as_text():
    encoder = Encoder(default_tokenizer(), special_as_text=True)
    ids, _ = encoder.encode(pa.array(["a <|endoftext|> b", "x<|endoftext|>"]))
    assert 50256 not in ids.tolist()
