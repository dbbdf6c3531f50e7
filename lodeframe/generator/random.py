"""Random columns from hashes: a draw depends on the seed, the stream's name and the row's key, never on partitions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


class Draws:
    """Draws for rows that the key columns identify."""

    def __init__(self, seed: int, *key: str | Column):
        self.seed, self.key = seed, [F.col(k) if isinstance(k, str) else k for k in key]

    def uniform(self, stream: str, *more: Column) -> Column:
        """In [0, 1), with 53 bits."""
        bits = F.xxhash64(F.lit(self.seed), F.lit(stream), *self.key, *more).bitwiseAND(F.lit((1 << 53) - 1))
        return bits / F.lit(float(1 << 53))

    def whole(self, stream: str, low: int, high: int, *more: Column) -> Column:
        """An integer from low to high, both included."""
        return (F.floor(self.uniform(stream, *more) * (high - low + 1)) + low).cast("int")

    def between(self, stream: str, low: float, high: float, *more: Column) -> Column:
        return self.uniform(stream, *more) * (high - low) + low

    def erlang(self, stream: str, shape: int, mean: float | Column, *more: Column) -> Column:
        """Gamma with a whole shape: the sum of exponentials."""
        logs = [F.log(1 - self.uniform(f"{stream}{k}", *more)) for k in range(shape)]
        total = logs[0]
        for x in logs[1:]:
            total = total + x
        return -total * mean / shape

    def normal(self, stream: str, *more: Column) -> Column:
        """Standard normal, by Box and Muller."""
        return F.sqrt(-2 * F.log(1 - self.uniform(f"{stream}r", *more))) * F.cos(2 * math.pi * self.uniform(f"{stream}a", *more))

    def poisson(self, stream: str, mean: Column, most: int = 8, *more: Column) -> Column:
        """By inversion, at most `most`; for small means."""
        u, below, term = self.uniform(stream, *more), None, F.exp(-mean)
        total, count = term, None
        for k in range(1, most + 1):
            step = (u >= total).cast("int")
            count = step if count is None else count + step
            term = term * mean / k
            total = total + term
        return count

    def choice(self, stream: str, options: dict[str, float], *more: Column) -> Column:
        """A key of options, by weight."""
        u, total, at = self.uniform(stream, *more) * sum(options.values()), 0.0, None
        for name, weight in list(options.items())[:-1]:
            total += weight
            at = F.when(u < total, name) if at is None else at.when(u < total, name)
        last = list(options)[-1]
        return F.lit(last) if at is None else at.otherwise(last)

    def one_of(self, stream: str, options: Sequence, *more: Column) -> Column:
        return F.element_at(F.array(*[F.lit(o) for o in options]), self.whole(stream, 1, len(options), *more))


def pick(values: Column, cumulative: Column, u: Column) -> Column:
    """The value whose cumulative weight (an ascending array that ends at 1) first exceeds u."""
    return F.element_at(values, F.least(F.size(F.filter(cumulative, lambda c: c <= u)) + 1, F.size(values)))


def looked_up(table: dict, key: Column) -> Column:
    """table[key] for a small dictionary."""
    flat = [F.lit(x) for pair in table.items() for x in pair]
    return F.element_at(F.create_map(*flat), key)
