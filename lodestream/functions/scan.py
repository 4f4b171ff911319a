"""Running values over an array, in n log n steps: a fold that appends would copy what it has at each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def running(values: Column, combine: Callable[[Column, Column], Column], neutral: Column) -> Column:
    """Array of ``values`` combined from the first up to each, by doubling; ``combine`` takes a value and
    what comes before it, and must be associative."""
    powers = F.array(*[F.lit(1 << i) for i in range(31)])

    def step(acc: Column, k: Column) -> Column:
        before = F.concat(F.array_repeat(neutral, k), F.slice(acc, F.lit(1), F.size(acc) - k))
        return F.zip_with(acc, before, combine)

    return let(values, lambda v: F.aggregate(F.filter(powers, lambda k: k < F.size(v)), v, step))


def running_state(after_false: Column, after_true: Column, start: bool) -> Column:
    """Array of the states of a machine of two states: what each step makes of false, and of true."""
    maps = F.zip_with(after_false, after_true, lambda f, t: F.struct(F.coalesce(f, F.lit(False)).alias("f"), F.coalesce(t, F.lit(False)).alias("t")))

    def after(later: Column, before: Column) -> Column:
        def then(x: Column) -> Column:
            return F.when(x, later["t"]).otherwise(later["f"])

        return F.struct(then(before["f"]).alias("f"), then(before["t"]).alias("t"))

    same = F.struct(F.lit(False).alias("f"), F.lit(True).alias("t"))
    return F.transform(running(maps, after, same), lambda x: x["t"] if start else x["f"])
