"""Discounts of operator 4 by the formula, and where it has no value."""

import pytest

from termweave.llm import quality


def test_discounts(spark):
    rows = lambda n: spark.createDataFrame([(c,) for c, k in n.items() for _ in range(k)] or [(9,)], "c long")
    # y = n1 / (n1 + 2 n2) = 0.5; D1 = 1 - 2y n2/n1, D2 = 2 - 3y n3/n2, D3 = 3 - 4y n4/n3
    assert quality.discounts(rows({1: 8, 2: 4, 3: 2, 4: 1, 7: 3})) == pytest.approx([0.5, 1.25, 2.0])
    for n in ({1: 8, 2: 4, 3: 2}, {2: 4, 3: 2, 4: 1}, {}):
        assert quality.discounts(rows(n)) == [0.5, 1.0, 1.5]
    assert quality.discounts(rows({1: 1, 2: 9, 3: 1, 4: 9}))[0] == pytest.approx(max(0.0, 1 - 2 * (1 / 19) * 9))
