"""Index lists, ranges and combinators on arrays as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from folioq.rules.selector import Indexes, Range


def positions(indexes: Indexes, n: Column) -> Column:
    """Zero-based positions in an array of n, each once, in the order asked for."""
    parts = []
    for item in indexes.items:
        if isinstance(item, Range):
            at = lambda x, default: default if x is None else F.lit(x) if x >= 0 else n + x  # noqa: B023, E731
            start, end = at(item.start, F.lit(0)), at(item.end, n - 1)
            out = ((start < 0) & (end < 0)) | ((start >= n) & (end >= n)) | (n == 0)
            low = lambda x: F.least(F.greatest(x, F.lit(0)), F.greatest(n - 1, F.lit(0)))
            step = F.lit(item.step) if item.step > 0 else F.greatest(n + item.step, F.lit(1))
            span = F.sequence(low(start), low(end), F.when(low(start) <= low(end), step).otherwise(-step))
            parts.append(F.when(out, F.array().cast("array<int>")).otherwise(span))
        else:
            at = F.lit(item) if item >= 0 else n + item
            parts.append(F.when((at >= 0) & (at < n), F.array(at)).otherwise(F.array().cast("array<int>")))
    chosen = F.array_distinct(F.concat(*parts))
    if not indexes.exclude:
        return chosen
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(F.array_except(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), chosen))


def sliced(c: Column, indexes: Indexes) -> Column:
    return F.transform(positions(indexes, F.size(c)), lambda k: F.get(c, k))


def appended(*lists: Column) -> Column:
    return F.concat(*lists)


def first_filled(*lists: Column) -> Column:
    out = lists[-1]
    for x in reversed(lists[:-1]):
        out = F.when(F.size(x) > 0, x).otherwise(out)
    return out


def interleaved(a: Column, b: Column) -> Column:
    """a1 b1 a2 b2 ..., the longer one's rest at the end."""
    pairs = F.flatten(F.zip_with(F.transform(a, lambda x: F.array(x)), F.transform(b, lambda x: F.array(x)), lambda x, y: F.concat(F.coalesce(x, F.array().cast("array<string>")), F.coalesce(y, F.array().cast("array<string>")))))
    return pairs
