import pytest
from hypothesis import given
from hypothesis import strategies as st

from polyad.meta import TensorMeta

#: Extents, block extents, blocks per mode, last extents of stored tensors (fixed values).
SHAPES = [
    ((71, 71, 31, 31), (50, 50, 14, 14), (2, 2, 3, 3), (21, 21, 3, 3)),
    ((36, 71, 31, 31), (36, 50, 14, 14), (1, 2, 3, 3), (36, 21, 3, 3)),
    ((50, 50, 20, 20), (8, 50, 14, 14), (7, 1, 2, 2), (2, 50, 6, 6)),
    ((453, 151, 32, 32), (151, 151, 16, 16), (3, 1, 2, 2), (151, 151, 16, 16)),
    ((4, 6), (2, 3), (2, 2), (2, 3)),
]


@pytest.mark.parametrize(("shape", "block", "num", "final"), SHAPES)
def test_block_arithmetic(shape, block, num, final):
    m = TensorMeta(shape, block)
    assert m.block_num == num and m.block_final == final
    assert m.local_shape([n - 1 for n in num]) == final
    assert TensorMeta.from_header(m.to_header()) == m
    assert [m.block_id(m.block_at(k)) for k in range(m.blocks)] == list(range(m.blocks))


@given(st.lists(st.tuples(st.integers(1, 40), st.integers(1, 50)), min_size=1, max_size=4))
def test_blocks_cover_every_index_once(modes):
    m = TensorMeta(tuple(e for e, _ in modes), tuple(k for _, k in modes))
    for n, e in enumerate(m.shape):
        ranges = [m.block_range(n, b) for b in range(m.block_num[n])]
        assert [i for a, b in ranges for i in range(a, b)] == list(range(e))


def test_header_lines_in_any_order_and_bad_headers():
    m = TensorMeta((4, 6), (2, 3))
    lines = ["TensorDims  2 ", *reversed(m.to_header()[1:])]
    assert TensorMeta.from_header(lines) == m
    with pytest.raises(ValueError, match="lacks"):
        TensorMeta.from_header(lines[:2])
    with pytest.raises(ValueError, match="contradicts"):
        TensorMeta.from_header(["TensorDims 3", *lines[1:]])


@pytest.mark.parametrize("args", [((), ()), ((1, 2), (1,)), ((0,), (1,)), ((3,), (0,))])
def test_bad_shapes(args):
    with pytest.raises(ValueError):
        TensorMeta(*args)


def test_block_number_out_of_range():
    with pytest.raises(ValueError):
        TensorMeta((4, 6), (2, 3)).block_at(4)
