"""Shape and blocking of an N-way array, and the text header that describes it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import prod

#: Fixed words of the header's four lines.
HEADER = ("TensorDims", "TensorRank", "BlockRank", "BlockNumber")


@dataclass(frozen=True)
class TensorMeta:
    """Extents per mode, and the nominal extents of the blocks of a regular grid (the last block of a mode may be smaller)."""

    shape: tuple[int, ...]
    block_shape: tuple[int, ...]

    def __post_init__(self):
        object.__setattr__(self, "shape", tuple(int(e) for e in self.shape))
        object.__setattr__(self, "block_shape", tuple(int(k) for k in self.block_shape))
        if not self.shape or len(self.shape) != len(self.block_shape):
            raise ValueError("shape and block_shape need the same number of modes, one at least")
        if min(self.shape) < 1 or min(self.block_shape) < 1:
            raise ValueError("extents are 1 at least")

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> int:
        return prod(self.shape)

    @property
    def block_num(self) -> tuple[int, ...]:
        return tuple(-(-e // k) for e, k in zip(self.shape, self.block_shape, strict=True))

    @property
    def block_final(self) -> tuple[int, ...]:
        """Extent of the last block of each mode."""
        return tuple((e - 1) % k + 1 for e, k in zip(self.shape, self.block_shape, strict=True))

    @property
    def blocks(self) -> int:
        return prod(self.block_num)

    def local_shape(self, block: Sequence[int]) -> tuple[int, ...]:
        return tuple(min(k, e - b * k) for e, k, b in zip(self.shape, self.block_shape, block, strict=True))

    def block_range(self, mode: int, b: int) -> tuple[int, int]:
        """Global indices [start, stop) of block b along a mode."""
        start = b * self.block_shape[mode]
        return start, min(start + self.block_shape[mode], self.shape[mode])

    def block_id(self, block: Sequence[int]) -> int:
        """Linear number of a block, the first mode fastest."""
        number, stride = 0, 1
        for b, n in zip(block, self.block_num, strict=True):
            number, stride = number + b * stride, stride * n
        return number

    def block_at(self, number: int) -> tuple[int, ...]:
        if not 0 <= number < self.blocks:
            raise ValueError(f"block {number} of {self.blocks}")
        out = []
        for n in self.block_num:
            number, b = divmod(number, n)
            out.append(b)
        return tuple(out)

    def replace(self, mode: int, extent: int, block: int | None = None) -> TensorMeta:
        """Another extent for a mode. The block extent stays unless given."""
        put = lambda t, x: (*t[:mode], x, *t[mode + 1 :])
        return TensorMeta(put(self.shape, extent), put(self.block_shape, block or self.block_shape[mode]))

    def to_header(self) -> list[str]:
        values = (str(self.ndim), *(",".join(map(str, v)) for v in (self.shape, self.block_shape, self.block_num)))
        return [f"{k} {v}" for k, v in zip(HEADER, values, strict=True)]

    @classmethod
    def from_header(cls, lines: Sequence[str]) -> TensorMeta:
        """Lines are found by their keyword; what they say must agree."""
        found = {}
        for line in lines:
            word, _, rest = line.strip().partition(" ")
            if word in HEADER:
                found[word] = [int(x) for x in rest.replace(",", " ").split()]
        missing = [w for w in HEADER if w not in found]
        if missing:
            raise ValueError(f"header lacks {', '.join(missing)}")
        meta = cls(tuple(found["TensorRank"]), tuple(found["BlockRank"]))
        if found["TensorDims"] != [meta.ndim] or tuple(found["BlockNumber"]) != meta.block_num:
            raise ValueError("header contradicts itself")
        return meta
