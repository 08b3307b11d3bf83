"""Each of the labels of conflicts is reached."""

import pytest

from arbordiff.operators import merging
from arbordiff.operators.alignment import Mod, Prm, Spn
from arbordiff.operators.patches import Change, Options
from arbordiff.operators.terms import Space
from arbordiff.plans.golden import CONFLICTS
from arbordiff.sources import grammars


@pytest.mark.parametrize("label,name,mode,a,o,b", CONFLICTS)
def test_label(label, name, mode, a, o, b):
    space, parse = Space(), grammars.grammar(name)
    status, merged, found = merging.merge3(space, *(parse(space, t) for t in (a, o, b)), Options(min_height=0, mode=mode))
    assert (status, merged) == ("conflicting", None) and label in [c.label for c in found]


def test_a_permuted_variable_with_two_findings():
    """Differences don't give this; alignments made by hand do."""
    space = Space()
    x, y = space.hole(0, "T"), space.hole(1, "T")
    one, two, three = (space.roll("T", c, []) for c in ("one", "two", "three"))
    left = Spn("T", "pair", (Prm(x, y), Prm(x, y)))
    right = Spn("T", "pair", (Mod(Change(one, two)), Mod(Change(one, three))))
    for p, q in ((left, right), (right, left)):
        with pytest.raises(merging.Disagreement) as found:
            merging.Merger(space).merge(p, q)
        assert found.value.args == ("prm-chg",)


def test_these_are_all():
    assert {c[0] for c in CONFLICTS} | {"prm-chg"} == set(merging.LABELS)
