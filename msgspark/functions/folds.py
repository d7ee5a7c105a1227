"""Ordered folds over one row, written with Spark's higher-order functions.

``aggregate`` copies its accumulator on every step, so a fold that gathers a long
array pays for its whole length each time. The folds here gather into a short
array first and join it to the long one once per block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 16


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``.

    A fold over nothing whose finish step is the body: unlike ``transform`` it
    does not copy the result, which matters for long texts and arrays.
    """
    nothing = F.expr("cast(array() as array<int>)")
    return F.aggregate(nothing, value, lambda acc, _: acc, body)


def empty_array(ddl: str) -> Column:
    return F.expr(f"cast(array() as array<{ddl}>)")


Push = Callable[[Column, Column], Column]
Step = Callable[[Column, Column, Push], Column]


def _push(acc: Column) -> Push:
    return lambda state, new: F.struct(
        state.alias("st"), F.concat(acc["out"], new).alias("out")
    )


def _join(acc: Column) -> Callable[[Column], Column]:
    return lambda r: F.struct(r["st"].alias("st"), F.concat(acc["out"], r["out"]).alias("out"))


def fold_emit(steps: Column, state: Column, emits: str, step: Step, block: int = BLOCK) -> Column:
    """Run ``step(state, i, push)`` for ``i`` in ``0 .. steps-1`` and gather what it emits.

    A step ends in ``push(next_state, array)`` whose array (DDL element type
    ``emits``) is appended. Returns ``struct<st, out>``.
    """
    nothing = empty_array(emits)

    def one(acc: Column, i: Column) -> Column:
        return step(acc["st"], i, _push(acc))

    def many(acc: Column, b: Column) -> Column:
        indices = F.sequence(b * block, F.least(b * block + (block - 1), steps - 1))
        empty = F.struct(acc["st"].alias("st"), nothing.alias("out"))
        return F.aggregate(indices, empty, one, _join(acc))

    start = F.struct(state.alias("st"), nothing.alias("out"))
    blocks = F.sequence(F.lit(0), F.floor((steps - 1) / block).cast("int"))
    return F.when(steps < 1, start).otherwise(F.aggregate(blocks, start, many))


def walk_emit(
    length: Column,
    emits: str,
    step: Callable[[Column, Push], Column],
    levels: int = 3,
    block: int = BLOCK,
) -> Column:
    """Run ``step(pos, push)`` from position 0 until ``pos >= length``; gather what it emits.

    Every step must move at least one position on. The text is walked in ranges
    of ``block ** levels`` positions, so the steps a range may need are known and
    the idle ones touch only the few elements of that range.
    """
    nothing = empty_array(emits)
    width = block**levels

    def idle(limit: Column, moved: Callable[[Column], Column]) -> Callable[[Column, Column], Column]:
        return lambda acc, _: F.when(acc["st"] >= limit, acc).otherwise(moved(acc))

    def level(n: int, limit: Column) -> Callable[[Column], Column]:
        if n == 0:
            return lambda acc: step(acc["st"], _push(acc))
        return lambda acc: F.aggregate(
            F.expr(f"sequence(1, {block})"),
            F.struct(acc["st"].alias("st"), nothing.alias("out")),
            idle(limit, level(n - 1, limit)),
            _join(acc),
        )

    def ranges(acc: Column, r: Column) -> Column:
        limit = F.least((r + 1) * width, length)
        return F.when(acc["st"] >= limit, acc).otherwise(level(levels, limit)(acc))

    start = F.struct(F.lit(0).alias("st"), nothing.alias("out"))
    all_ranges = F.sequence(F.lit(0), F.floor((length - 1) / width).cast("int"))
    return F.aggregate(all_ranges, start, ranges, lambda r: r["out"])
