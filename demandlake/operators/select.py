"""Exact selection of ranks without a sort.

``values_at`` finds the values that hold given ranks of columns by bracketing: mergeable quantile
sketches propose boundary values, one scan counts the rows at and between them, and the interval that
holds a wanted rank is bracketed again until few distinct values are left in it; those are counted and
the rank is read off. Counts are exact, so a sketch only decides how fast an interval shrinks (by some
thousand times a scan). What leaves a task are sketches and counts per interval, never row-level
values, whatever the number of rows or their skew. ``keys_at`` does the same for rows ordered by
several columns: ties of the first column are told apart by selecting among them by the next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCURACY = 10_000  # of a sketch: ranks are off by up to 1 / ACCURACY of the rows
FEW = 2_000  # distinct values of an interval that are counted one by one

Values = dict[int, tuple[float | int | None, int]]  # rank -> (value, rows before the first of that value)


def _code(x: Column, bounds: list, of) -> Column:
    """2 i + 1 for the i-th boundary, 2 i for the interval before it, found by halving."""
    if not bounds:
        return F.lit(0)

    def halve(a: int, z: int) -> Column:  # bounds[a:z] are still in question
        if a == z:
            return F.lit(2 * a)
        mid = (a + z) // 2
        return F.when(x < of(bounds[mid]), halve(a, mid)).when(x == of(bounds[mid]), F.lit(2 * mid + 1)).otherwise(halve(mid + 1, z))

    return halve(0, len(bounds))


def values_at(df: DataFrame, columns: dict[str, Column], ranks: dict[str, Callable[[int], list[int]]]) -> dict[str, tuple[int, Values]]:
    """{name: (rows that are not null, {rank: (value, rows below)})}; all columns are doubles, or all are longs.

    ``ranks`` gives the wanted ranks (from 0, nulls not counted) for a number of rows. Doubles must hold no NaN.
    """
    names = list(columns)
    src = df.select(*[c.alias(f"_{i}") for i, c in enumerate(columns.values())])
    kind = src.schema["_0"].dataType.simpleString()
    of = (lambda v: F.lit(float(v))) if kind == "double" else (lambda v: F.lit(int(v)).cast("long"))
    cols = [F.col(f"_{i}") for i in range(len(names))]
    total = src.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    wanted = [sorted({r for r in ranks[name](total[i]) if 0 <= r < total[i]}) for i, name in enumerate(names)]
    bounds: list[list] = [[] for _ in names]
    found: list[Values] = [{} for _ in names]
    # (lower bound or None, upper bound or None) -> (rows below the interval, rows in it, wanted ranks)
    open_: list[dict] = [{(None, None): (0, total[i], own)} if own else {} for i, own in enumerate(wanted)]
    while any(open_):
        _add_bounds(src, cols, open_, bounds, kind)
        live = [i for i, o in enumerate(open_) if o]
        code = F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.when(cols[i].isNotNull(), _code(cols[i], bounds[i], of)).alias("code")) for i in live]))
        counts: dict[int, dict[int, int]] = {}
        for r in src.select(code).where("code is not null").groupBy("i", "code").agg(F.count(F.lit(1)).alias("n")).collect():  # a row per boundary and interval
            counts.setdefault(r.i, {})[r.code] = r.n
        small = []
        for i in live:
            pending = sorted(r for _, _, own in open_[i].values() for r in own)
            open_[i], below = {}, 0
            for k in range(2 * len(bounds[i]) + 1):
                n = counts.get(i, {}).get(k, 0)
                own = [r for r in pending if below <= r < below + n]
                if own and k % 2:
                    found[i].update(dict.fromkeys(own, (bounds[i][k // 2], below)))
                elif own:
                    ends = (bounds[i][k // 2 - 1] if k else None, bounds[i][k // 2] if k // 2 < len(bounds[i]) else None)
                    if n <= FEW:
                        small.append((i, k, below, own))
                    else:
                        open_[i][ends] = (below, n, own)
                below += n
        _count_values(src, cols, bounds, small, found, of)
    return {name: (total[i], found[i]) for i, name in enumerate(names)}


def _inside(c: Column, ends: tuple, of) -> Column:
    low, high = ends
    got = c.isNotNull()
    if low is not None:
        got = got & (c > of(low))
    return got if high is None else got & (c < of(high))


def _add_bounds(src: DataFrame, cols: list[Column], open_: list[dict], bounds: list[list], kind: str) -> None:
    """Boundaries around the wanted ranks of every open interval, from one sketch each."""
    of = (lambda v: F.lit(float(v))) if kind == "double" else (lambda v: F.lit(int(v)).cast("long"))
    asked = []
    for i, own in enumerate(open_):
        for ends, (below, n, ranks) in own.items():
            probs = sorted({min(1.0, max(0.0, (r - below) / max(1, n - 1) + side)) for r in ranks for side in (-2 / ACCURACY, 2 / ACCURACY)})
            own_values = F.when(_inside(cols[i], ends, of), cols[i])
            asked.append((i, ends, F.struct(F.percentile_approx(own_values, probs, ACCURACY).alias("q"), F.min(own_values).alias("least"), F.max(own_values).alias("most"))))
    row = src.agg(*[a.alias(f"q{k}") for k, (_, _, a) in enumerate(asked)]).first()
    for k, (i, (low, high), _) in enumerate(asked):
        got = row[k]
        new = {v for v in got.q or [] if (low is None or v > low) and (high is None or v < high)}
        if not new:  # a sketch rounds large integers: halve what is left
            new = {got.least, (got.least + got.most) // 2 if kind != "double" else got.least, got.most}
        bounds[i] = sorted({*bounds[i], *new})


def _count_values(src: DataFrame, cols: list[Column], bounds: list[list], small: list[tuple], found: list[Values], of) -> None:
    """Read the ranks of intervals of few values off the counts of those values."""
    if not small:
        return
    pairs = F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.when(_code(cols[i], bounds[i], of) == code, cols[i]).alias("v")) for k, (i, code, _, _) in enumerate(small)]))
    rows = src.select(pairs).where("v is not null").groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).collect()  # FEW per wanted rank at most
    for k, (i, _, below, ranks) in enumerate(small):
        for v, n in sorted((r.v, r.n) for r in rows if r.k == k):
            found[i].update(dict.fromkeys([r for r in ranks if below <= r < below + n], (v, below)))
            below += n


_EPOCH = "1970-01-01 00:00:00"
_LONGS = ("tinyint", "smallint", "int", "bigint")


def _numeric(df: DataFrame, name: str) -> Column | None:
    """The column as an ordered number, or None for types that have none."""
    kind, c = dict(df.dtypes)[name], F.col(name)
    if kind in _LONGS:
        return c.cast("long")
    if kind == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit(_EPOCH).cast("timestamp_ntz"), c)
    if kind == "timestamp":
        return F.unix_micros(c)
    if kind == "date":
        return F.unix_date(c).cast("long")
    return None


def _back(value: int | None, kind: str) -> Column:
    if value is None:
        return F.lit(None).cast(kind)
    v = F.lit(value).cast("long")
    if kind == "timestamp_ntz":
        return F.timestamp_add("MICROSECOND", v, F.lit(_EPOCH).cast("timestamp_ntz"))
    if kind == "timestamp":
        return F.timestamp_micros(v)
    if kind == "date":
        return F.date_from_unix_date(v.cast("int"))
    return v.cast(kind)


def selectable(df: DataFrame, order_cols: list[str]) -> bool:
    """Whether ``keys_at`` knows how to order by the columns: numbers and times; the last one may be of any type."""
    return all(isinstance(c, str) for c in order_cols) and all(_numeric(df, c) is not None for c in order_cols[:-1] or order_cols)


def keys_at(df: DataFrame, order_cols: list[str], ranks: Callable[[int], list[int]]) -> tuple[int, dict[int, list[Column]]]:
    """(rows, {rank: key}): the order keys, as literal columns, at ranks of the ascending order (nulls first)."""
    n = df.count()
    wanted = sorted({r for r in ranks(n) if 0 <= r < n})
    return n, _keys(df.select(*order_cols), order_cols, wanted)


def _keys(df: DataFrame, order_cols: list[str], wanted: list[int]) -> dict[int, list[Column]]:
    if not wanted:
        return {}
    name, rest = order_cols[0], order_cols[1:]
    kind, x = dict(df.dtypes)[name], _numeric(df, name)
    if x is None:  # a last column of another type, among rows that tie in all before it
        return {r: [F.lit(df.orderBy(F.asc_nulls_first(name)).limit(r + 1).agg(F.max(name)).first()[0]).cast(kind)] for r in wanted}
    nulls = df.where(F.col(name).isNull()).count()
    _, got = values_at(df, {name: x}, {name: lambda n: [r - nulls for r in wanted]})[name]
    out = {}
    groups: dict = {}
    for r in wanted:
        value, below = (None, 0) if r < nulls else (got[r - nulls][0], got[r - nulls][1] + nulls)
        groups.setdefault(value, []).append((r, below))
    for value, own in groups.items():
        first = _back(value, kind)
        if not rest:
            out.update({r: [first] for r, _ in own})
            continue
        ties = _keys(df.where(F.col(name).eqNullSafe(first)).select(*rest), rest, [r - below for r, below in own])
        out.update({r: [first, *ties[r - below]] for r, below in own})
    return out
