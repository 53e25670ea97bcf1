"""Column types joined over all files of a table, and values that do not fit them.

The types of raw columns form a lattice: nothing seen, whole numbers of 32 and 64 bits, fractions,
text. Types only ever move up, so what was stored stays readable. Text in a column of numbers does
not turn the column into text: such values are kept as they came in the ``_rescued`` column, a JSON
object of column name and value, as are lines with more or fewer fields than their header (under
``_line``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: From nothing seen up to fractions; text stands apart.
NUMBERS: list[T.DataType] = [T.NullType(), T.IntegerType(), T.LongType(), T.DoubleType()]
TEXT = T.StringType()
RESCUED = "_rescued"
LINE = "_line"


def joined(known: T.DataType | None, seen: T.DataType) -> T.DataType:
    """The type of a column after values of type ``seen`` arrived."""
    if known is None or known == NUMBERS[0]:
        return seen
    if known not in NUMBERS or seen not in NUMBERS:
        return known
    return max(known, seen, key=NUMBERS.index)


def settled(kind: T.DataType | None) -> bool:
    """Can no value move the type any further."""
    return kind is not None and (kind not in NUMBERS or kind == NUMBERS[-1])


def _level(text: Column) -> Column:
    """Place of one value in the lattice; text is one above the numbers.

    A cast that fails raises and is caught, row by row, so what cannot be whole is not cast to it.
    """
    whole = F.when(~text.rlike("[.A-Za-z]"), text)
    fits = [F.lit(0)] + [(text if kind == NUMBERS[-1] else whole).try_cast(kind).isNotNull() for kind in NUMBERS[1:]]
    out = F.when(text.isNull(), 0)
    for level, test in enumerate(fits[1:], start=1):
        out = out.when(test, level)
    return out.otherwise(len(NUMBERS))


def seen_types(texts: DataFrame, columns: list[str], known: dict[str, T.DataType]) -> dict[str, T.DataType]:
    """The joined types of text ``columns``: one aggregate over those whose type may still move."""
    moving = [c for c in columns if not settled(known.get(c))]
    types = dict(known)
    if not moving:
        return types
    level = {c: _level(F.col(f"`{c}`")) for c in moving}
    aggregates = [F.max(level[c]).alias(f"a{i}") for i, c in enumerate(moving)]
    aggregates += [F.max(F.when(level[c] < len(NUMBERS), level[c])).alias(f"n{i}") for i, c in enumerate(moving)]
    found = texts.agg(*aggregates).first()
    for i, c in enumerate(moving):
        is_new = known.get(c) in (None, NUMBERS[0])
        top = (found[f"a{i}"] if is_new else found[f"n{i}"]) or 0
        types[c] = joined(known.get(c), TEXT if top == len(NUMBERS) else NUMBERS[top])
    return types


def fitted(texts: DataFrame, types: dict[str, T.DataType], keep: list[str], line: str | None = None) -> DataFrame:
    """Text columns in their types, the ``keep`` columns, and what does not fit in ``_rescued``.

    ``line`` names a column that holds the whole line where its fields do not match its header.
    """
    misfits, values = [], []
    for name, kind in types.items():
        text = F.col(f"`{name}`")
        if kind == NUMBERS[0]:  # nothing seen yet, nothing to store
            continue
        value = text if kind == TEXT else text.try_cast(kind)
        values.append(value.alias(name))
        if kind != TEXT:
            misfits.append(F.when(text.isNotNull() & value.isNull(), F.struct(F.lit(name).alias("key"), text.alias("value"))))
    if line is not None:
        misfits.append(F.when(F.col(line).isNotNull(), F.struct(F.lit(LINE).alias("key"), F.col(line).alias("value"))))
    found = F.array_compact(F.array(*misfits)) if misfits else F.array()
    rescued = F.when(F.size(found) > 0, F.to_json(F.map_from_entries(found))) if misfits else F.lit(None).cast("string")
    return texts.select(*values, *keep, rescued.alias(RESCUED))


def text_schema(names: list[str], line: bool = False) -> T.StructType:
    return T.StructType([T.StructField(n, TEXT) for n in [*names, *([LINE] if line else [])]])


def needs_rewrite(before: T.StructType, after: T.StructType) -> bool:
    """Did a column move in a way that readers of the stored files cannot follow.

    Files of 32-bit numbers are read as 64-bit numbers or fractions; 64-bit ones are not.
    """
    old = {f.name: f.dataType for f in before}
    return any(old.get(f.name) == T.LongType() and f.dataType == T.DoubleType() for f in after)
