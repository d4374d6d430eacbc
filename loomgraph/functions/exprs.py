"""Scalar expressions of the query language as column functions.

The default is SQL's three-valued logic. ``compat=True`` gives the embedded engine's rules: predicates are
never null, null is the smallest value and equals itself, failed conversions give zero values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Predicate = Callable[[Column], Column]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _true(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


# ---- comparison ------------------------------------------------------------------------------------------


def eq(a: Column, b: Column, *, compat: bool = False, nested: bool = False) -> Column:
    """``nested``: arrays and maps, which the embedded engine never finds equal."""
    if not compat:
        return a == b
    return a.isNull() & b.isNull() if nested else a.eqNullSafe(b)


def ne(a: Column, b: Column, *, compat: bool = False, nested: bool = False) -> Column:
    return ~eq(a, b, compat=True, nested=nested) if compat else a != b


def lt(a: Column, b: Column, *, compat: bool = False) -> Column:
    return b.isNotNull() & (a.isNull() | _true(a < b)) if compat else a < b


def gt(a: Column, b: Column, *, compat: bool = False) -> Column:
    return lt(b, a, compat=True) if compat else a > b


def le(a: Column, b: Column, *, compat: bool = False) -> Column:
    return a.isNull() | (b.isNotNull() & _true(a <= b)) if compat else a <= b


def ge(a: Column, b: Column, *, compat: bool = False) -> Column:
    return le(b, a, compat=True) if compat else a >= b


# ---- logic -----------------------------------------------------------------------------------------------


def and_(a: Column, b: Column, *, compat: bool = False) -> Column:
    return _true(a) & _true(b) if compat else a & b


def or_(a: Column, b: Column, *, compat: bool = False) -> Column:
    return _true(a) | _true(b) if compat else a | b


def xor(a: Column, b: Column, *, compat: bool = False) -> Column:
    return _true(a) != _true(b) if compat else a != b


def not_(a: Column, *, compat: bool = False) -> Column:
    return ~_true(a) if compat else ~a


def in_list(x: Column, items: Column, *, compat: bool = False) -> Column:
    """Membership; under ``compat`` null is found among nulls and a null list holds nothing."""
    return _true(F.exists(items, lambda i: i.eqNullSafe(x))) if compat else F.array_contains(items, x)


# ---- strings ---------------------------------------------------------------------------------------------


def _text(x: Column, compat: bool) -> Column:
    return x.cast("string") if compat else x


def starts_with(a: Column, b: Column, *, compat: bool = False) -> Column:
    out = _text(a, compat).startswith(_text(b, compat))
    return _true(out) if compat else out


def ends_with(a: Column, b: Column, *, compat: bool = False) -> Column:
    out = _text(a, compat).endswith(_text(b, compat))
    return _true(out) if compat else out


def contains(a: Column, b: Column, *, compat: bool = False) -> Column:
    out = _text(a, compat).contains(_text(b, compat))
    return _true(out) if compat else out


def lower(x: Column, *, compat: bool = False) -> Column:
    """Unicode by default, A-Z only under ``compat``."""
    return F.coalesce(F.translate(x, _UPPER, _LOWER), F.lit("")) if compat else F.lower(x)


def upper(x: Column, *, compat: bool = False) -> Column:
    return F.coalesce(F.translate(x, _LOWER, _UPPER), F.lit("")) if compat else F.upper(x)


def replace(x: Column, old: Column, new: Column) -> Column:
    return F.replace(x, old, new)


# ---- arithmetic: all results are doubles -----------------------------------------------------------------


def _number(x: Column, compat: bool) -> Column:
    x = x.try_cast("double")
    return F.coalesce(x, F.lit(0.0)) if compat else x


def _finite(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def add(a: Column, b: Column, *, compat: bool = False) -> Column:
    return _number(a, compat) + _number(b, compat)


def subtract(a: Column, b: Column, *, compat: bool = False) -> Column:
    return _number(a, compat) - _number(b, compat)


def multiply(a: Column, b: Column, *, compat: bool = False) -> Column:
    return _number(a, compat) * _number(b, compat)


def divide(a: Column, b: Column, *, compat: bool = False) -> Column:
    """Division by zero gives null."""
    return F.try_divide(_number(a, compat), _number(b, compat))


def modulo(a: Column, b: Column, *, compat: bool = False) -> Column:
    """The sign is the dividend's; by zero null."""
    return F.try_mod(_number(a, compat), _number(b, compat))


def power(a: Column, b: Column, *, compat: bool = False) -> Column:
    return _finite(F.pow(_number(a, compat), _number(b, compat)))


def negate(a: Column, *, compat: bool = False) -> Column:
    return -_number(a, compat)


# ---- conversion ------------------------------------------------------------------------------------------


def to_string(x: Column, *, nested: bool = False, compat: bool = False) -> Column:
    out = F.to_json(x) if nested else x.cast("string")
    return F.coalesce(out, F.lit("null")) if compat else out


def to_integer(x: Column, *, compat: bool = False) -> Column:
    """Null on failure; under ``compat`` 0, and blanks around the number or a fraction are failures."""
    if not compat:
        return x.try_cast("bigint")
    text = x.cast("string")
    return F.coalesce(
        F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("bigint")).when(text == "true", 1), F.lit(0)
    ).cast("bigint")


def to_float(x: Column, *, compat: bool = False) -> Column:
    out = x.try_cast("double")
    return F.coalesce(out, F.lit(0.0)) if compat else out


# ---- lists and maps --------------------------------------------------------------------------------------


def index(items: Column, i: Column, kind: str = "list") -> Column:
    """Of a list 0-based; negative and out of range give null. Of a map by key; a missing one gives null."""
    if kind == "map":
        return F.try_element_at(items, i)
    i = i.cast("int")
    return F.when(i >= 0, F.get(items, i))


def count_distinct(x: Column, *, approx: bool = False) -> Column:
    """Aggregate: the number of different values; ``approx`` keeps a sketch per group instead of the values."""
    return F.approx_count_distinct(x) if approx else F.count_distinct(x)


def slice_(items: Column, start: Column | None, end: Column | None) -> Column:
    """0-based and half-open; negative bounds are 0, a missing one is open."""
    n = F.size(items)

    def bound(x: Column | None, default: Column) -> Column:
        return default if x is None else F.least(F.greatest(F.coalesce(x.cast("int"), default), F.lit(0)), n)

    lo, hi = bound(start, F.lit(0)), bound(end, n)
    return F.when(items.isNotNull(), F.slice(items, lo + 1, F.greatest(hi - lo, F.lit(0))))


def comprehension(items: Column, where: Predicate | None = None, made: Predicate | None = None) -> Column:
    """``[x IN items WHERE p | e]``; no list gives an empty one."""
    there = F.coalesce(items, F.array())
    out = there if where is None else F.filter(there, lambda x: _true(where(x)))
    return out if made is None else F.transform(out, made)


def any_(items: Column, p: Predicate) -> Column:
    """False where there is no list; likewise ``all_``, ``none`` and ``single``."""
    return _true(F.exists(items, lambda x: _true(p(x))))


def all_(items: Column, p: Predicate) -> Column:
    return _true(F.forall(items, lambda x: _true(p(x))))


def none(items: Column, p: Predicate) -> Column:
    return _true(~F.exists(items, lambda x: _true(p(x))))


def single(items: Column, p: Predicate) -> Column:
    return _true(F.size(F.filter(items, lambda x: _true(p(x)))) == 1)


def size(x: Column, kind: str = "list") -> Column:
    """Of a list, a string (characters) or a map; null has none."""
    n = {"list": F.size, "string": F.char_length, "map": lambda m: F.size(F.map_keys(m))}[kind](x)
    return F.when(x.isNull(), 0).otherwise(n).cast("bigint")


def labels(label: Column) -> Column:
    return F.array(label)


def keys(m: Column) -> Column:
    """The sorted keys of a map; those of a JSON object's text with ``F.from_json(x, 'map<string,string>')``."""
    return F.array_sort(F.map_keys(m))


def case_value(x: Column, branches: list[tuple[Column, Column]], default: Column | None = None, *, compat: bool = False) -> Column:
    """``CASE x WHEN v THEN r``."""
    out = None
    for value, result in branches:
        hit = eq(x, value, compat=compat)
        out = F.when(hit, result) if out is None else out.when(hit, result)
    return out if default is None else out.otherwise(default)


# ---- quantities ------------------------------------------------------------------------------------------

# The suffixes of resource quantities and what they stand for.
SUFFIXES = {
    "m": 1e-3, "": 1.0, "k": 1e3, "M": 1e6, "G": 1e9, "T": 1e12, "P": 1e15, "E": 1e18,
    "Ki": 2.0**10, "Mi": 2.0**20, "Gi": 2.0**30, "Ti": 2.0**40, "Pi": 2.0**50, "Ei": 2.0**60,
}
_QUANTITY = "^([+-]?[0-9.]+(?:[eE][+-]?[0-9]+)?)(m|k|M|G|T|P|E|Ki|Mi|Gi|Ti|Pi|Ei)?$"


def quantity(x: Column, unit: str = "", *, legacy: bool = False) -> Column:
    """``128Mi``, ``250m``, ``129e6`` as a number of ``unit`` (a suffix); null if it is none.

    ``legacy``: the memory recipe in MiB of the documented queries, which knows Ti to Ki and takes all
    else as it stands (0 if that is no number).
    """
    if legacy:
        scaled = lambda suffix, by: F.coalesce(F.replace(x, F.lit(suffix), F.lit("")).try_cast("double"), F.lit(0.0)) * by
        out = F.when(x.endswith("Ti"), scaled("Ti", 1024.0 * 1024)).when(x.endswith("Gi"), scaled("Gi", 1024.0))
        out = out.when(x.endswith("Mi"), scaled("Mi", 1.0)).when(x.endswith("Ki"), scaled("Ki", 1 / 1024))
        return out.otherwise(F.coalesce(x.try_cast("double"), F.lit(0.0)))
    number = F.nullif(F.regexp_extract(x, _QUANTITY, 1), F.lit("")).try_cast("double")
    factor = F.create_map(*[F.lit(v) for pair in SUFFIXES.items() for v in pair])
    return number * F.try_element_at(factor, F.regexp_extract(x, _QUANTITY, 2)) / SUFFIXES[unit]
