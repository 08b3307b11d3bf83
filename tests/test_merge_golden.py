"""Merges of small labelled trees with known results, in both orders and all modes. None: a conflict is expected."""

import pytest

from arbordiff.operators.merging import merge3
from arbordiff.operators.patches import MODES, Options
from arbordiff.operators.terms import Space
from arbordiff.plans.golden import CASES
from arbordiff.sources.grammars import rtree, unparse_rtree

# The fixed cases are in the module golden: number, A, O, B, expected, expected in patience mode.
BY_NUMBER = {c[0]: c for c in CASES}


@pytest.mark.parametrize("mode", MODES)
@pytest.mark.parametrize("swap", [False, True])
@pytest.mark.parametrize("case", BY_NUMBER)
def test_merge(case, swap, mode):
    _, a, o, b, plain, patient = BY_NUMBER[case]
    want = patient if mode == "patience" else plain
    space = Space()
    a, o, b = (rtree(space, x) for x in (a, o, b))
    if swap:
        a, b = b, a
    status, merged, found = merge3(space, a, o, b, Options(mode=mode))
    if want is None:
        assert status == "conflicting" and found
    else:
        assert (status, merged and unparse_rtree(merged)) == ("success", want)
