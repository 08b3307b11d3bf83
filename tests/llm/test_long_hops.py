"""The expansion of intervals takes few rounds and finds what single symbols would; runs of words are those of the least pieces."""

from collections import Counter

import numpy as np
import pytest

from arbordiff.llm import repeats


@pytest.mark.parametrize("length", [20, 51, 57, 100])
@pytest.mark.parametrize("width", [1, 8])
def test_expansion_in_hops(length, width):
    random = np.random.default_rng(length)
    parts = [bytes(random.integers(97, 100, int(n)).astype(np.uint8)) for n in random.integers(1, 300, 6)]
    texts = [b"".join(parts[i] for i in random.integers(0, 6, 4)) for _ in range(12)] + [b"ab" * 200, b"", b"c" * length]
    found = repeats.repeated_starts([t if width == 1 else np.frombuffer(t, np.uint8).astype(np.uint64) * 977 for t in texts], length)
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t, f in zip(texts, found, strict=True):
        assert f.tolist() == [count[t[i : i + length]] > 1 for i in range(len(t) - length + 1)]


def test_few_rounds(monkeypatch):
    hops, plain = [], repeats._before
    monkeypatch.setattr(repeats, "_before", lambda sa, number, room, hop: hops.append(hop) or plain(sa, number, room, hop))
    text = bytes(np.random.default_rng(1).integers(97, 123, 1000).astype(np.uint8))
    first, second = repeats.repeated_starts([text, b"x" + text[100:900]], 400)
    assert np.flatnonzero(first).tolist() == list(range(100, 501)) and second.sum() == 401
    assert hops == [112, 56, 7, 1]


def test_runs_of_words_follow_the_least_piece():
    random = np.random.default_rng(2)
    for text in (b"a " * 300, b" ".join(b"%d" % i for i in range(300)), b" ".join(b"%d" % i for i in random.integers(0, 3, 700)), b" ".join(b"%d" % (i % 60) for i in range(500))):
        keys, first, count, _ = repeats.word_runs(text, 51)
        assert first[0] == 0 and (first[1:] == (first + count)[:-1]).all() and (first + count)[-1] == len(text.split()) - 50
        words = text.split()
        pieces = Counter((b" ".join(words[f : f + 51]), k) for f, k in zip(first.tolist(), keys.tolist(), strict=True))
        assert len({w for w, _ in pieces}) == len(pieces)  # equal strings have equal keys
