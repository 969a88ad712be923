"""Train and test splits as values: two conditions over the rows, so that a plan holds any number of them in one scan."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evalml import hash_order

_ALL = 4294967296


def _true(c: Column) -> Column:
    """A condition that is NULL is not met."""
    return F.coalesce(c, F.lit(False))


@dataclass(frozen=True)
class Split:
    """Which rows train and which test; a row may be neither, and is never both."""

    train: Column
    test: Column

    def swap(self) -> Split:
        return Split(self.test, self.train)

    def where(self, kept: Column) -> Split:
        """Both sides, less the rows that do not meet a condition."""
        return Split(self.train & _true(kept), self.test & _true(kept))


class Splits:
    """A sequence of splits with combinators; nothing runs until a table is given."""

    def __init__(self, splits: Iterable[Split]) -> None:
        self._splits = list(splits)

    def __iter__(self) -> Iterator[Split]:
        return iter(self._splits)

    def __len__(self) -> int:
        return len(self._splits)

    def map(self, f: Callable[[Split], Split]) -> Splits:
        return Splits(map(f, self))

    def filter(self, f: Callable[[Split], bool]) -> Splits:
        return Splits(filter(f, self))

    def swap(self) -> Splits:
        return self.map(Split.swap)

    def __add__(self, other: Splits) -> Splits:
        return Splits([*self, *other])

    def sides(self, df: DataFrame) -> DataFrame:
        """df with split and side ('train' or 'test'), a row for each split that it belongs to: one scan for all."""
        each = [F.struct(F.lit(i).alias("split"), F.when(s.train, "train").when(s.test, "test").alias("side")) for i, s in enumerate(self)]
        at = F.explode(F.filter(F.array(*each), lambda x: x["side"].isNotNull())) if each else F.explode(F.array().cast("array<struct<split:int,side:string>>"))
        return df.select("*", at.alias("_at")).select(*[df[c] for c in df.columns], F.col("_at.split").alias("split"), F.col("_at.side").alias("side"))

    def aggregate(self, df: DataFrame, **of: Callable[[Column], Column]) -> DataFrame:
        """A row a split: n_train, n_test and each aggregate on both sides, by conditions in one scan.

        of: name -> f(condition), e.g. total=lambda c: F.sum(F.when(c, F.col("x"))).
        """
        cells = []
        for i, s in enumerate(self):
            cells += [F.count_if(s.train).alias(f"{i}|n_train"), F.count_if(s.test).alias(f"{i}|n_test")]
            for name, f in of.items():
                cells += [f(s.train).alias(f"{i}|{name}_train"), f(s.test).alias(f"{i}|{name}_test")]
        if not cells:
            return df.sparkSession.createDataFrame([], "split int, n_train long, n_test long")
        row = df.agg(*cells)
        names = ["n_train", "n_test", *(f"{n}_{side}" for n in of for side in ("train", "test"))]
        structs = [F.struct(F.lit(i).alias("split"), *[F.col(f"`{i}|{n}`").alias(n) for n in names]) for i in range(len(self))]
        return row.select(F.explode(F.array(*structs)).alias("_s")).select("_s.*")

    def loop(self, df: DataFrame, train: Callable[[DataFrame], Any], evaluate: Callable[[Any, DataFrame], Any] = lambda model, rows: None) -> list[tuple[Any, Any]]:
        """(what train gave on the training rows, what evaluate gave for it on the test rows) of each split."""
        out = []
        for s in self:
            model = train(df.where(s.train))
            out.append((model, evaluate(model, df.where(s.test))))
        return out


def once(key: Column, ratio: float, seed: int = 0) -> Splits:
    """One split: a share of the rows, by a hash of an integer key, trains.  Rows of one key stay together; NULL keys are left out."""
    h = hash_order(key, seed)
    cut = F.lit(int(ratio * _ALL))
    return Splits([Split(_true(h < cut), _true(h >= cut))])


def by_group(group: Column, ratio: float, seed: int = 0) -> Splits:
    """once by any group's value: its rows stay together, and the ratio is one of groups."""
    return once(F.xxhash64(F.when(group.isNotNull(), group)), ratio, seed).map(lambda s: s.where(group.isNotNull()))


def folds(key: Column, k: int, seed: int = 0, replicas: int = 1) -> Splits:
    """k splits, each with a k-th of the keys' hash range to test; replicas repeat with other hashes, k more each."""
    out = []
    for r in range(replicas):
        at = F.floor(hash_order(key, seed + 7919 * r) * k / _ALL)
        out += [Split(_true(at != i), _true(at == i)) for i in range(k)]
    return Splits(out)


def premade(fold: Column, k: int) -> Splits:
    """k splits by a column of fold numbers, such as that of stratified_folds (equal sizes in each stratum)."""
    return Splits([Split(_true(fold != i), _true(fold == i)) for i in range(k)])


def fixed(train: Column, test: Column) -> Splits:
    """A given split; a row that meets both raises when it is read."""
    both = F.assert_true(~(_true(train) & _true(test)), "a row both trains and tests").isNull()
    return Splits([Split(_true(train) & both, _true(test) & both)])


def with_rows(condition: Column) -> Splits:
    """Trains with these rows and tests the rest."""
    return Splits([Split(_true(condition), ~_true(condition))])


def without_rows(condition: Column) -> Splits:
    return with_rows(condition).swap()


def train_all() -> Splits:
    return Splits([Split(F.lit(True), F.lit(False))])


def leave_out(groups: Iterable[Column]) -> Splits:
    """A split for each condition: its rows test, the others train."""
    return Splits([Split(~_true(g), _true(g)) for g in groups])
