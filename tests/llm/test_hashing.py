import numpy as np

from waymark.llm.hashing import SpanHashes, spans


def test_hashes_tell_nothing_of_place_or_block():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    data[rng.random(5000) < 0.2] = 32
    data[1000:2500] = 98  # one long span
    starts, ends = spans(data != 32)
    whole = SpanHashes(data).of(starts, ends)
    for block in (1, 7, 100, 4096):
        assert (SpanHashes(data, block).of(starts, ends) == whole).all()
    moved = np.concatenate([np.full(37, 32, np.uint8), data])
    assert (SpanHashes(moved).of(starts + 37, ends + 37) == whole).all()
    words = [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    assert len(set(words)) == len(set(whole.tolist())) == len(set(zip(words, whole.tolist(), strict=True)))
    assert len(SpanHashes(data).of(starts[:0], ends[:0])) == 0
