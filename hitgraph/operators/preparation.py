"""From screens of several species to one table: symbols harmonised, genes chosen, ranks turned to normal quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from . import ids, linear, plotrows, ranks
from .written import materialize


def orthologs_of_type(pairs: DataFrame, source: str, target: str, kind: str, wanted: str = "ortholog_one2one") -> DataFrame:
    """Distinct (source, target) of one homology type, blanks left out; a source of several targets is in none."""
    some = pairs.where((F.col(kind) == wanted) & (F.length(source) > 0) & (F.length(target) > 0)).select(source, target)
    return ids.one_to_one(some, source, target)


def harmonise(scores: DataFrame, species: str, gene: str, home: str, maps: dict[str, DataFrame], aliases: DataFrame) -> DataFrame:
    """scores with `symbol`: the home species' name of each gene.

    Genes of the home species keep their own; those of a species in `maps` (source, target) get the target, or NULL
    where they have none; species without a map keep theirs.  A symbol that no home gene has gets the only target
    of its alias (alias, symbol), and without one stays; a NULL takes its chance as the gene's own name.
    """
    out = scores
    merged = F.col(gene)
    for i, (name, pairs) in enumerate(maps.items()):
        side = pairs.select(F.col("source").alias(f"_s{i}"), F.col("target").alias(f"_t{i}"))
        out = out.join(side, (F.col(species) == name) & (F.col(gene) == F.col(f"_s{i}")), "left")
        merged = F.when(F.col(species) == name, F.col(f"_t{i}")).otherwise(merged)
    out = out.withColumn("_merged", merged)
    known = scores.where(F.col(species) == home).select(F.col(gene).alias("symbol")).distinct()
    out = out.withColumn("_asked", F.coalesce("_merged", gene))
    return ids.standardise_alias(out, "_asked", known, aliases).withColumn("symbol", F.col("standard")).drop("_merged", "_asked", "standard", *[f"_{x}{i}" for i in range(len(maps)) for x in "st"])


def screen_cells(scores: DataFrame, screen: str, gene: str, score: str, keep: Column) -> DataFrame:
    """Cells (i: screen, j: gene, v) for principal components of screens.

    A score's rank in its screen (ties: the least) over the screen's size; of genes that every screen has and that meet
    `keep` in one at least, the least rank in each screen (a gene may be there twice); ranks of 1 become the largest
    rank below 1, and all of them upper normal quantiles.
    """
    ranked = materialize(ranks.with_rank(scores.withColumn("_keep", F.coalesce(keep, F.lit(False))), [screen], score).where(F.col("rank").isNotNull()))
    cells = ranked.groupBy(F.col(screen).alias("i"), F.col(gene).alias("j")).agg(F.min(F.col("rank") / F.col("group_size")).alias("r"), F.max("_keep").alias("_keep")).where("j is not null")
    cells = materialize(cells)
    n = cells.agg(F.count_distinct("i").alias("n"))  # one row
    common = cells.groupBy("j").agg(F.count(F.lit(1)).alias("_in"), F.max("_keep").alias("_any")).where("_any").crossJoin(F.broadcast(n)).where("_in = n").select("j")
    chosen = cells.join(common, "j").select("i", "j", "r")
    top = chosen.agg(F.max(F.when(F.col("r") < 1, F.col("r"))).alias("top"))  # one row
    clamped = chosen.crossJoin(F.broadcast(top)).select("i", "j", F.when(F.col("r") >= 1, F.col("top")).otherwise(F.col("r")).alias("r"))
    return clamped.select("i", "j", (-stats.qnorm("r")).alias("v"))


def screen_components(cells: DataFrame, k: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(scores of screens, loadings of genes) of the cells' principal components, centred and not scaled."""
    held = materialize(cells)
    scores = materialize(linear.pca(held, k))
    return scores, linear.loadings(held, scores)


def extreme_loadings(loadings: DataFrame, component: int, n: int = 20) -> DataFrame:
    """j, loading, side: the n genes of least and of greatest loading, ties by name; a top-k report."""
    one = loadings.where(F.col("component") == component)
    low = one.orderBy("loading", "j").limit(n).select("j", "loading", F.lit("low").alias("side"))
    high = one.orderBy(F.desc("loading"), F.desc("j")).limit(n).select("j", "loading", F.lit("high").alias("side"))
    return low.unionByName(high)


def by_absolute_rank(loadings: DataFrame, component: int) -> DataFrame:
    """j, loading, place (from 0) of one component, by falling size of the loading."""
    one = loadings.where(F.col("component") == component).withColumn("_size", F.abs("loading"))
    return plotrows.places(one, [], ["_size", "j"], True).select("j", "loading", F.col("ordinal").alias("place"))
