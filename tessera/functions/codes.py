"""Scalar functions of the profile steps (F1-F9) as built-in Column expressions.

The reference implements these as row-at-a-time Python UDFs; here they are CASE /
array / date expressions that stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the original workflow: experience code -> years, degree code -> level.
EXPERIENCE_YEARS = {103: 1.0, 104: 1.5, 105: 3.0, 106: 5.5, 107: 10.0}
DEGREE_LEVEL = {209: 1, 208: 2, 206: 3, 202: 4, 203: 5, 204: 6, 205: 7}
NULL_STRING = "无"          # string fill value of the profile steps
DEFAULT_INDUSTRY = 80000    # fill value of the work industry codes
CODE_BASE = 100000          # rebasing offset of the position / industry codes


def _case(c: Column, mapping: dict, default) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = (F.when(c == F.lit(k), F.lit(v)) if expr is None
                else expr.when(c == F.lit(k), F.lit(v)))
    return expr.otherwise(F.lit(default))


def experience_years(code: Column) -> Column:
    """F1: experience code -> years (double; 1.5 and 5.5 kept, see D1)."""
    return _case(code, EXPERIENCE_YEARS, 0.0).cast("double")


def degree_level(code: Column) -> Column:
    """degree code -> level (int), every other code 0."""
    return _case(code, DEGREE_LEVEL, 0).cast("int")


def split_tokens(text: Column, sep: str) -> Column:
    """split a delimited string (``sep`` is a literal, not a pattern)."""
    import re
    return F.split(text, re.escape(sep))


def concat_arrays(*arrays: Column) -> Column:
    """concatenation of arrays."""
    return F.concat(*arrays)


def vector_element(arr: Column, index: int | Column) -> Column:
    """element ``index`` (0-based) as float, null when out of range."""
    idx = F.lit(index) if isinstance(index, int) else index
    return F.get(arr, idx).cast("float")


def first_element(arr: Column) -> Column:
    """first element of a list (null for an empty list)."""
    return F.get(arr, F.lit(0))


def arg_max(arr: Column) -> Column:
    """0-based position of the largest element, ties -> lowest index."""
    return (F.array_position(arr, F.array_max(arr)) - F.lit(1)).cast("int")


def composite_code(major: Column, minor: Column, factor: int = 10000) -> Column:
    """``major * factor + minor``."""
    return major * F.lit(factor) + minor


def rebase(code: Column, base: int = CODE_BASE) -> Column:
    """P10: ``code - base``."""
    return code - F.lit(base)
