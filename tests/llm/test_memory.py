"""What matching keeps in the memory of a worker, whatever the size of a list."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from namelens.llm import names as N
from namelens.llm import vectors as V


def _words(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    parts = [a + b + c for a in "bdfgklmnprstvz" for b in "aeiou" for c in ("", "n", "r", "l", "k")]
    return list({"".join(rng.choice(parts) for _ in range(rng.randint(2, 4))) for _ in range(n)})


def _peak(work) -> tuple[object, int, int]:
    tracemalloc.start()
    try:
        out = work()
        return out, *tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()


def test_what_is_kept_of_words_is_bounded():
    """Workers live on from stage to stage: what they keep of a million words must leave room beside the executor's heap."""
    words = _words(80_000, 3)

    def work() -> None:
        for x, y in zip(words, words[1:]):
            V.vector(x), N.initials_of(x), N.nickname_groups(x), N.word_likeness(x, y), N.person_words(f"{x} {y}"), N.firm_words(f"{x} {y}")

    _, kept, _ = _peak(work)
    assert kept < 60 << 20


def test_a_bucket_is_compared_in_bounded_parts():
    """Pairs come out in parts while a bucket is compared, the same as of all words with all."""
    words = _words(8_000, 4)
    vectors = [N.vector(w) for w in words]
    table = pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(words))), *(pa.array([V._signed(v >> s & V._HALF) for v in vectors]) for s in (0, 64)), pa.array([V.radius(v.bit_count()) for v in vectors], pa.int32())], names=["w", "v0", "v1", "radius"]
    )
    sent = list(V._bucketed(iter([table]), 2))
    assert max(b.nbytes for b in sent) < sum(b.nbytes for b in sent) / 3

    def work() -> set[tuple[int, int]]:
        found = np.concatenate([np.zeros(0, np.int64), *(b["a"].to_numpy() * len(words) + b["b"].to_numpy() for b in V._met(iter(sent)))])
        return np.unique(found)

    found, _, most = _peak(work)
    assert most < 3 * sum(b.nbytes for b in sent) + (40 << 20)
    v = np.array([[x & V._HALF, x >> 64] for x in vectors], np.uint64)
    r = np.array([V.radius(x.bit_count()) for x in vectors])
    for k in range(0, len(words), 400):
        near = np.flatnonzero((np.bitwise_count(v ^ v[k]).sum(axis=1) <= np.minimum(r, r[k])) & (np.arange(len(words)) != k))
        either = {int(x) % len(words) for x in found[found // len(words) == k]} | {int(x) // len(words) for x in found[found % len(words) == k]}
        assert either == set(near.tolist())
