"""Rows of two engines, held against each other without regard to order."""

from __future__ import annotations

import pandas as pd


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    assert sorted(a.columns) == sorted(b.columns)
    columns = sorted(a.columns)
    x, y = (f[columns].astype(str).sort_values(columns).reset_index(drop=True) for f in (a, b))
    assert len(x) == len(y)
    wrong = ~(x == y).all(axis=1)
    assert not wrong.any(), f"\n{x[wrong].head(3)}\n{y[wrong].head(3)}"
