"""Registry of named queries: a Spark builder and (where SQL can say it) the
equivalent DuckDB SQL used as the correctness oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


TIE_NUDGE = 1e-9


def tie_safe_sql(sql: str, digits: int = 6) -> str:
    """Rewrite every ``ROUND(expr, 6)`` into ``ROUND((expr) + 1e-9, 6)``.

    Values such as -1/128 sit exactly on a 6-digit rounding tie, and float sums can
    differ by an ulp between runs (aggregation order), which would flip the rounded
    digit.  The Spark side rounds ``x + 1e-9`` as well (``common.r6``), so ulp noise
    can no longer straddle a tie while real differences stay visible."""
    out, i, key = [], 0, "ROUND("
    while True:
        k = sql.find(key, i)
        if k < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, j, comma = 1, k + len(key), -1
        while depth:
            c = sql[j]
            if c == "(":
                depth += 1
            elif c == ")":
                depth -= 1
            elif c == "," and depth == 1:
                comma = j
            j += 1
        inner = sql[k + len(key):j - 1]
        if comma >= 0 and sql[comma + 1:j - 1].strip() == str(digits):
            expr = tie_safe_sql(sql[k + len(key):comma], digits)
            out.append(sql[i:k] + f"ROUND(({expr}) + {TIE_NUDGE}, {digits})")
        else:
            out.append(sql[i:k] + key + tie_safe_sql(inner, digits) + ")")
        i = j


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = tie_safe_sql(sql)
        return fn
    return deco
