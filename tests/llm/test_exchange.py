"""What one task holds of a chunk while numbers become ids, and what a chunk's texts take on disk."""

import numpy as np

from lamina.llm import bpe
from lamina.llm.shared import packed, unpacked


def test_ids_come_some_rows_at_a_time(monkeypatch):
    monkeypatch.setattr(bpe, "TAKE", 50)
    rng = np.random.default_rng(3)
    size = rng.integers(1, 5, 40)
    begin, values = np.r_[0, np.cumsum(size)[:-1]], rng.integers(0, 9999, size.sum()).astype(np.int32)
    many = rng.choice([0, 1, 7, 30, 80], 60)
    of, flat = np.r_[0, np.cumsum(many)], rng.integers(0, 40, many.sum()).astype(np.uint32)
    want = [[v for k in flat[a:b] for v in values[begin[k] : begin[k] + size[k]]] for a, b in zip(of[:-1], of[1:], strict=True)]
    got, rows = [], 0
    for ids, bounds in bpe._exchanged(flat, of, size, begin, values):
        n = len(bounds) - 1
        assert n == 1 or many[rows : rows + n].sum() <= 50
        got += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        rows += n
    assert got == want


def test_numbers_of_repeated_passages_pack_smaller():
    rng = np.random.default_rng(4)
    passages = [rng.zipf(1.3, 60).clip(max=60_000) for _ in range(400)]
    x = np.concatenate([passages[i] for i in rng.integers(0, 400, 3_000)]).astype(np.uint32)
    assert (unpacked(packed(x, bpe.EFFORT), len(x), np.uint32) == x).all()
    assert len(packed(x, bpe.EFFORT)) < 0.97 * len(packed(x))
