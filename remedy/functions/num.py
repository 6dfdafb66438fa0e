"""Numeric helpers shared by queries and their SQL oracles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(c, n: int = 6) -> Column:
    """Round to ``n`` places as round(x * 10^n) / 10^n: scaling and rounding to an
    integer give the same double in Spark and DuckDB (both round half away from
    zero), unlike a decimal-place round of a double."""
    c = F.col(c) if isinstance(c, str) else c
    s = float(10 ** n)
    return F.round(c.cast("double") * F.lit(s), 0) / F.lit(s)


def np_rnd(x: np.ndarray, n: int = 6) -> np.ndarray:
    """NumPy twin of :func:`rnd` (half away from zero, not half to even)."""
    s = float(10 ** n)
    y = np.asarray(x, dtype=np.float64) * s
    t = np.trunc(y)
    r = t + np.sign(y) * (np.abs(y - t) >= 0.5)
    return r / s


def sql_rnd(sql: str) -> str:
    """Rewrite every ``round(expr, n)`` in DuckDB SQL to ``(round((expr) * 1en) / 1en)``."""
    out, i = [], 0
    low = sql.lower()
    while True:
        j = low.find("round(", i)
        if j < 0 or (j > 0 and (low[j - 1].isalnum() or low[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k, comma = 0, j + 6, -1
        while k < len(sql):
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                if depth == 0:
                    break
                depth -= 1
            elif ch == "," and depth == 0:
                comma = k
            elif ch == "'":
                k = sql.index("'", k + 1)
            k += 1
        inner = sql[j + 6:k]
        if comma < 0:
            out.append(sql[i:j] + "round(" + sql_rnd(inner) + ")")
        else:
            expr, n = sql[j + 6:comma], sql[comma + 1:k].strip()
            out.append(sql[i:j] + f"(round(({sql_rnd(expr)}) * 1e{n}) / 1e{n})")
        i = k + 1
