"""Aggregates that a caller defines by zero, add, merge and finish, with partial aggregation before the shuffle."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: Keys whose states a task holds before it sends them on.
HELD = 50_000


class Reducer(NamedTuple):
    """zero() makes a state; add(state, values) takes an array of values; merge(a, b) joins two states; finish(state) is the result.

    add and merge must not depend on the order of values; states are small.
    """

    zero: Callable[[], Any]
    add: Callable[[Any, np.ndarray], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], Any]


def _fisher_tail(state: tuple[float, int]) -> float | None:
    x, k = state
    if k == 0:
        return None
    term = total = 1.0
    for i in range(1, k):
        term *= x / i
        total += term
    return float(np.exp(-x) * total)


#: Combined p of independent tests: states are (minus the sum of logarithms, number).
FISHER = Reducer(lambda: (0.0, 0), lambda s, v: (s[0] - float(np.log(v).sum()), s[1] + len(v)), lambda a, b: (a[0] + b[0], a[1] + b[1]), _fisher_tail)
LEAST = Reducer(lambda: None, lambda s, v: float(v.min()) if s is None else min(s, float(v.min())), lambda a, b: b if a is None else a if b is None else min(a, b), lambda s: s)


def _largest(v: np.ndarray) -> float:
    return float(v[np.lexsort((v, np.abs(v)))[-1]])


#: The value of largest size with its sign; of x and -x it is x.
FURTHEST = Reducer(lambda: None, lambda s, v: _largest(v if s is None else np.append(v, s)), lambda a, b: b if a is None else a if b is None else _largest(np.array([a, b])), lambda s: s)


def reduce_by(df: DataFrame, keys: list[str], value: str, how: Reducer, kind: str = "double") -> DataFrame:
    """keys and `value` reduced: tasks add up what they hold of each key, and only states are shuffled and merged.

    NULL and NaN are not added; a key of such values alone has the finish of zero.  The keys' types are any that
    Spark groups by.  A key's group in the merge is as long as tasks that held it, however many rows it has.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    plain = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(value).cast("double").alias("_v"))
    schema = ", ".join([*(f"{n} {plain.schema[n].dataType.simpleString()}" for n in names), "_state binary"])

    def partial(batches):
        held: dict = {}
        schema_ = None

        def out():
            columns = [pa.array([k[i] for k in held], t) for i, t in enumerate(schema_)]
            rb = pa.RecordBatch.from_arrays([*columns, pa.array([pickle.dumps(s) for s in held.values()], pa.binary())], [*names, "_state"])
            held.clear()
            return rb

        for rb in batches:
            if not rb.num_rows:
                continue
            schema_ = [rb.schema.field(n).type for n in names]
            places: dict = {}
            for at, key in enumerate(zip(*(rb.column(n).to_pylist() for n in names))):
                places.setdefault(key, []).append(at)
            v = rb.column("_v").to_numpy(zero_copy_only=False).astype(np.float64)
            for key, at in places.items():
                use = v[at]
                use = use[~np.isnan(use)]
                state = held[key] if key in held else how.zero()
                held[key] = how.add(state, use) if len(use) else state
            if len(held) >= HELD:
                yield out()
        if held:
            yield out()

    def merge(rows: pa.Table) -> pa.Table:
        state = how.zero()
        for s in rows["_state"].to_pylist():
            state = how.merge(state, pickle.loads(s))  # noqa: S301  our own bytes, of this job
        return pa.table({**{n: rows[n][:1] for n in names}, "_out": pa.array([how.finish(state)], rows_type)})

    rows_type = to_arrow_schema(df.sparkSession.createDataFrame([], f"x {kind}").schema).field(0).type
    out_schema = ", ".join([*(f"{n} {plain.schema[n].dataType.simpleString()}" for n in names), f"_out {kind}"])
    merged = plain.mapInArrow(partial, schema).groupBy(*names).applyInArrow(merge, out_schema)
    return merged.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], F.col("_out").alias(value))


def reduce_rows(df: DataFrame, key: str, columns: list[str], how: Reducer, name: str = "value") -> DataFrame:
    """key and a reducer over the columns of each row (the rows of one key together)."""
    long = df.select(key, F.explode(F.array(*[F.col(c).cast("double") for c in columns])).alias(name))
    return reduce_by(long, [key], name, how)


def merge_tables(a: DataFrame, b: DataFrame, keys: list[str], value: str, how: Reducer) -> DataFrame:
    """Both tables' keys; where they collide the reducer joins the values."""
    return reduce_by(a.select(*keys, value).unionByName(b.select(*keys, value)), keys, value, how)
