"""Every registered training-data query stands whatever its consumer asks of it."""

from __future__ import annotations

import pytest

from lumen.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_consumers(spark, sf_dir, name):
    df = Q.queries()[name](spark, sf_dir)
    n = df.count()
    assert n > 0 and not df.isEmpty()
    one = df.columns[-1]
    assert df.select(one).where(f"`{one}` is null or `{one}` is not null").count() == n
    assert df.where(f"`{df.columns[0]}` is not null").count() <= n
    assert df.select(one).distinct().count() <= n
