"""Evidence across screens: scores to ranks to p-values, combination, false-discovery control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import nulls, stats
from . import ranks, tables
from .written import materialize


def screen_scores(lineitem: DataFrame) -> DataFrame:
    """screen, gene, score: whole cents, so that ranks are exact."""
    cents = F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("long")
    return lineitem.groupBy(F.col("l_linenumber").alias("screen"), F.col("l_partkey").alias("gene")).agg(F.sum(cents).alias("score"))


def rank_p(scores: DataFrame) -> DataFrame:
    """Adds p, the cubed normalised rank within the screen."""
    r = ranks.with_rank(scores, ["screen"], "score")
    return r.withColumn("p", F.pow(F.col("rank") / F.col("group_size"), 3.0)).select("screen", "gene", "score", "p")


def hit_classes(ps: DataFrame, receptors: list[int], labels: int = 10) -> DataFrame:
    """screen, gene, hit and, for each screen's first genes by score, a label; later rules win over earlier ones."""
    hit = tables.ordered_recode([(F.col("p") > 0.99, F.lit("depleted")), (F.col("p") < 0.01, F.lit("enriched")), (F.col("gene").isin(receptors), F.lit("receptor"))], F.lit("no"))
    first = ranks.numbered(ps, ["screen"], ["score", "gene", "p"])
    return first.select("screen", "gene", hit.alias("hit"), F.when(F.col("i") <= labels, F.col("gene").cast("string")).otherwise("").alias("label"))


def guide_qc(counts: DataFrame, group: str, value: str) -> DataFrame:
    """group, total, pct_zero, med, mad, top, gini (of log2(count + 1)) of whole counts, from each group's distinct values.

    Groups are few and large: ranks come from range shuffles, so that no task sorts a whole group.
    """
    by = materialize(ranks.ranked(counts.select(group, value), [group], value))
    n, lv = F.col("group_size"), F.log2(F.col(value) + 1)
    plain = by.groupBy(group).agg(
        F.sum(F.col(value) * F.col("ties")).cast("long").alias("total"),
        (100.0 * F.sum(F.when(F.col(value) == 0, F.col("ties")).otherwise(0)) / F.max(n)).alias("pct_zero"),
        F.max(value).alias("top"),
        (F.sum((2 * F.col("rank_avg") - n - 1) * lv * F.col("ties")) / (F.max(n) * F.sum(lv * F.col("ties")))).alias("gini"),
    )
    med = ranks.medians(by, [group], value).withColumnRenamed("median", "med")
    off = counts.join(F.broadcast(med), group).select(group, F.abs(F.col(value) - F.col("med")).alias("off"))  # one row a group
    mad = ranks.medians(ranks.ranked(off, [group], "off"), [group], "off").select(group, (1.4826 * F.col("median")).alias("mad"))
    return plain.join(med, group).join(mad, group)


def fisher_combine(ps: DataFrame, by: list[Column | str]) -> DataFrame:
    return ps.groupBy(*by).agg(stats.fisher(F.col("p")).alias("p"), F.count("p").alias("k"))


def bh_cutoff(ps: DataFrame, q: float) -> DataFrame:
    """One row: the largest p with p <= rank * q / m (0 if none), over all rows; ranks without a single-task window."""
    all_ = ps.select(F.lit(0).alias("_g"), "p").where(F.col("p").isNotNull())
    r = ranks.ranked(all_, ["_g"], "p")
    last = F.col("rank_min") + F.col("ties") - 1
    return r.agg(F.coalesce(F.max(F.when(F.col("p") <= last * q / F.col("group_size"), F.col("p"))), F.lit(0.0)).alias("cutoff"))


def bh_adjust(ps: DataFrame, group: list[str]) -> DataFrame:
    """Adds padj = running minimum of p*m/rank from the largest p down, within the group, at most 1; NULL where p is.

    By distinct p: few groups are no few tasks.
    """
    ps = materialize(ps)  # read twice: sums of doubles might differ between two runs, and would then not meet
    r = ranks.ranked(ps, group, "p")
    r = r.select(*group, "p", (F.col("p") * F.col("group_size") / (F.col("rank_min") + F.col("ties") - 1)).alias("_raw"))
    low = ranks.running(r, group, "p", {"_low": ("min", "_raw")}, descending=True)
    return ps.join(low.select(*group, "p", F.least(F.lit(1.0), "_low").alias("padj")), [*group, "p"], "left").select(*[F.col(c) for c in ps.columns], "padj")


def outer_min_p(pos: DataFrame, neg: DataFrame, key: str) -> DataFrame:
    """Full outer join of two p columns with the NaN-aware minimum, as one aggregate over their union."""
    both = pos.select(key, "p").unionByName(neg.select(key, "p"))
    return both.groupBy(key).agg(F.min(nulls.nan_to_null(F.col("p"))).alias("p"))


def score_direction(df: DataFrame, neg: dict[str, str], pos: dict[str, str], rowwise: bool = False) -> DataFrame:
    """Choose the negative or positive columns by score; the guard on good guides is table-wide unless rowwise.

    neg, pos: output name -> column; they must hold 'score' and 'good'.
    """
    good = F.greatest(F.col(neg["good"]), F.col(pos["good"]))
    if rowwise:
        df = df.withColumn("_guard", good > 1)
    else:
        df = df.crossJoin(F.broadcast(df.agg((F.max(good) > 1).alias("_guard"))))  # one row
    use = (F.col(neg["score"]) > F.col(pos["score"])) & F.col("_guard")
    out = df.select("*", *[F.when(use, F.col(neg[k])).otherwise(F.col(pos[k])).alias(f"best_{k}") for k in neg])
    return out.withColumn("direction", F.when(use, "neg").otherwise("pos")).drop("_guard")


def combined_evidence(lineitem: DataFrame, q: float = 0.05) -> DataFrame:
    """Genes by the number of pathogens in which they are significant."""
    ps = rank_p(screen_scores(lineitem)).withColumn("pathogen", F.expr("screen % 3"))
    comb = materialize(fisher_combine(ps, ["pathogen", "gene"]))
    cut = bh_cutoff(comb, q)
    hits = comb.crossJoin(F.broadcast(cut)).groupBy("gene").agg(F.count_if(F.col("p") <= F.col("cutoff")).alias("n_hits"))  # cut is one row
    return hits.groupBy("n_hits").agg(F.count(F.lit(1)).alias("genes"))
