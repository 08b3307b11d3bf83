"""Patches between any two versions, from segments, against the fold over the chain."""

import random

from arbordiff import api
from arbordiff.operators import patches, versions
from arbordiff.operators.patches import Options
from arbordiff.operators.terms import Space
from arbordiff.sources import grammars


def history(rng, n):
    lines = [rng.choice("abcdef") for _ in range(5)]
    out = []
    for _ in range(n):
        out.append("\n".join(lines))
        at = rng.randrange(len(lines) + 1)
        lines = lines[:at] + [rng.choice("abcdefgh")] * rng.randint(0, 2) + lines[at + rng.randint(0, 1) :]
        lines = lines or ["x"]
    return out


def test_any_range_is_the_fold_of_its_steps(spark):
    rng = random.Random(11)
    texts = {f"k{i}": history(rng, n) for i, n in enumerate((1, 2, 3, 7, 13, 16, 21))}
    rows = [(k, i, t) for k, ts in texts.items() for i, t in enumerate(ts)]
    rng.shuffle(rows)
    made = api.version_segments(spark.createDataFrame(rows, "doc string, v int, body string"), "doc", "v", "body", "lines")
    ranges = [(k, b, e) for k, ts in texts.items() for b in range(len(ts)) for e in range(b, len(ts)) if rng.random() < 0.3 or b == e == 0]
    ranges += [("k3", 2, 99), ("k3", 5, 2), ("nobody", 0, 1), ("k3", -1, 2)]
    got = {(r.key, r.begin, r.end): r for r in api.patches_between(made, spark.createDataFrame(ranges, "key string, begin long, end long")).collect()}
    assert len(got) == len(set(ranges))
    for k, b, e in ranges:
        r = got[k, b, e]
        if b == e:
            assert (r.status, r.patch, r.n_segments) == ("empty", None, 0)
        elif k == "nobody" or b < 0 or e < b or e >= len(texts[k]):
            assert r.status == "no-such-version" and r.patch is None
        else:
            space = Space()
            trees = [grammars.lines(space, t) for t in texts[k][b : e + 1]]
            whole = patches.diff(space, trees[0], trees[1], Options())
            for x, y in zip(trees[1:], trees[2:]):
                whole = patches.compose(space, patches.diff(space, x, y, Options()), whole)
            mine = patches.decode_patch(space, r.patch)
            assert r.status == "success" and r.n_segments <= 2 * (e - b).bit_length()
            assert patches.apply(space, mine, trees[0]) is trees[-1] is patches.apply(space, whole, trees[0])
            assert patches.patch_equal(space, mine, whole) and patches.patch_equal(space, whole, mine)


def test_numbers_of_versions(spark):
    rows = [("a", i % 40, f"t{i}") for i in range(100)] + [("b", None, "null first"), ("b", 1, "z"), ("b", 1, "y"), (None, 1, "no key"), ("b", 2, None)]
    frame = spark.createDataFrame(rows, "k string, o int, t string").repartition(5)
    got = sorted((r.key, r.number, r.text) for r in versions.numbered(frame, "k", "o", "t").collect() if r.key == "b")
    assert got == [("b", 0, "null first"), ("b", 1, "y"), ("b", 2, "z"), ("b", 3, None)]
    numbers = versions.numbered(frame, "k", "o", "t").where("key = 'a'").collect()
    want = [t for _, t in sorted((o, t) for k, o, t in rows if k == "a")]
    assert [r.text for r in sorted(numbers, key=lambda r: r.number)] == want and {r.number for r in numbers} == set(range(100))


def test_what_cannot_be_parsed_is_a_status(spark):
    rows = [("a", 0, "x[y]"), ("a", 1, "x[["), ("a", 2, "x[z]"), ("a", 3, "x[w]"), ("a", 4, None)]
    made = api.version_segments(spark.createDataFrame(rows, "k string, o int, t string"), "k", "o", "t", "rtree")
    ranges = spark.createDataFrame([("a", 0, 1), ("a", 2, 3), ("a", 0, 3), ("a", 3, 4)], "key string, begin long, end long")
    got = {(r.begin, r.end): r.status for r in api.patches_between(made, ranges).collect()}
    assert got == {(0, 1): "no-patch", (2, 3): "success", (0, 3): "no-patch", (3, 4): "no-patch"}
    empty = api.version_segments(spark.createDataFrame([], "k string, o int, t string"), "k", "o", "t", "rtree")
    assert empty.count() == 0 and api.patches_between(empty, ranges).where("status = 'no-such-version'").count() == 4
