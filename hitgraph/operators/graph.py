"""Weighted graphs as edge tables: stochastic matrices, walks, centrality, sub-graphs, sparse algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .steps import repeated
from .written import materialize


def canonical_pairs(edges: DataFrame) -> DataFrame:
    """src <= dst, equal repeats once; a pair with two weights raises."""
    e = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.col("w").cast("double").alias("w"))
    g = e.groupBy("src", "dst").agg(F.min("w").alias("w"), F.max("w").alias("_hi"))
    return g.withColumn("w", F.when(F.col("w") == F.col("_hi"), F.col("w")).otherwise(F.raise_error(F.lit("a pair has two weights")).cast("double"))).drop("_hi")


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()


def stochastic(edges: DataFrame, nodes: DataFrame | None = None, drop_isolated: bool = False) -> DataFrame:
    """(src, dst, w): src's column sums to 1 over dst.  A vertex without edges keeps a loop of weight 1, or is dropped."""
    nodes = vertices(edges) if nodes is None else nodes.select("id").distinct()
    pairs = canonical_pairs(edges).where("w <> 0")
    both = pairs.union(pairs.where("src <> dst").select(F.col("dst"), F.col("src"), "w"))
    degree = both.groupBy("src").agg(F.sum("w").alias("degree"))
    out = both.join(degree, "src").select("src", "dst", (F.col("w") / F.col("degree")).alias("w"))
    if drop_isolated:
        return out
    alone = nodes.join(degree, nodes["id"] == degree["src"], "left_anti")
    return out.unionByName(alone.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w")))


def edges_within(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges (src, dst, ...) with both ends in given sets (id); two semi-joins, so no edge is made or repeated."""
    return edges.join(sources.select(F.col("id").alias("src")), "src", "left_semi").join(targets.select(F.col("id").alias("dst")), "dst", "left_semi")


def multiply(m: DataFrame, p: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Matrix times vector (id, p); with `by`, times one vector for each of its values."""
    by = by or []
    return m.join(p, m["src"] == p["id"]).groupBy(*by, m["dst"].alias("id")).agg(F.sum(F.col("w") * F.col("p")).alias("p"))


def walk(m: DataFrame, start: DataFrame, steps: int = 15, restart: float = 0.5, by: list[str] | None = None, every: int = 5) -> DataFrame:
    """Random walk with restart: p <- r*p0 + (1-r)*M*p, so many steps: one walk by tiles of cells, or one for each value of `by` by rows."""
    if not by:
        return repeated(m, start, steps, restart)
    keys = [*by, "id"]
    m, p0 = materialize(m), materialize(start)
    p = p0
    for i in range(steps):
        moved = multiply(m, p, by).select(*keys, ((1 - restart) * F.col("p")).alias("p"))
        p = moved.unionByName(p0.select(*keys, (restart * F.col("p")).alias("p"))).groupBy(*keys).agg(F.sum("p").alias("p"))
        if (i + 1) % every == 0 and i + 1 < steps:
            p = materialize(p)  # cuts lineage
    return p


def centrality(m: DataFrame, nodes: DataFrame, steps: int = 100) -> DataFrame:
    """Power iteration from the uniform vector, normalised to sum 1 at the end."""
    p = nodes.select("id", F.lit(1.0).alias("p"))
    p = p.crossJoin(F.broadcast(p.agg(F.sum("p").alias("_n")))).select("id", (F.col("p") / F.col("_n")).alias("p"))  # one row
    p = repeated(m, p, steps)
    return p.crossJoin(F.broadcast(p.agg(F.sum(F.abs("p")).alias("_n")))).select("id", (F.col("p") / F.col("_n")).alias("p"))


def degree_normalise(p: DataFrame, q: DataFrame, how: str) -> DataFrame:
    """none: p; kl: p*(ln p - ln q), 0 if p is 0; lrt: p/q.  q is (id, q)."""
    out = p.join(q, "id")
    if how == "kl":
        return out.select("id", F.when(F.col("p") == 0, F.lit(0.0)).otherwise(F.col("p") * (F.ln("p") - F.ln("q"))).alias("p"))
    return out.select("id", (F.col("p") / F.col("q") if how == "lrt" else F.col("p")).alias("p"))


def propagate(m: DataFrame, nodes: DataFrame, data: DataFrame, steps: int = 15, restart: float = 0.5) -> DataFrame:
    """A gene vector on the graph: unknown genes drop, absent ones are 0, the sum is 1, then a walk."""
    p0 = nodes.join(data, "id", "left").select("id", F.coalesce("p", F.lit(0.0)).alias("p"))
    total = F.broadcast(p0.agg(F.sum("p").alias("_n")))  # one row
    return walk(m, p0.crossJoin(total).select("id", (F.col("p") / F.col("_n")).alias("p")), steps, restart)


def diffusion(m: DataFrame, nodes: DataFrame, steps: int = 15, restart: float = 0.5) -> DataFrame:
    """A walk from every vertex: (source, id, p), all in one batched walk."""
    return walk(m, nodes.select(F.col("id").alias("source"), "id", F.lit(1.0).alias("p")), steps, restart, ["source"])


def gram(cells: DataFrame) -> DataFrame:
    """Transposed matrix times matrix from (i, j, v)."""
    a, b = cells.alias("a"), cells.alias("b")
    return a.join(b, F.col("a.i") == F.col("b.i")).groupBy(F.col("a.j").alias("j1"), F.col("b.j").alias("j2")).agg(F.sum(F.col("a.v") * F.col("b.v")).alias("v"))


def matmul(x: DataFrame, y: DataFrame) -> DataFrame:
    a, b = x.alias("a"), y.alias("b")
    return a.join(b, F.col("a.j") == F.col("b.i")).groupBy(F.col("a.i").alias("i"), F.col("b.j").alias("j")).agg(F.sum(F.col("a.v") * F.col("b.v")).alias("v"))


def gene_multigraph(nodes: DataFrame, edges: DataFrame, genes: DataFrame, gene_type: str) -> DataFrame:
    """Edges among genes of the set, and between those and nodes of other types; (u, v, relation) once, last wins."""
    n = nodes.select("id", F.col("type")).join(genes.select(F.col("id"), F.lit(True).alias("in_set")), "id", "left")
    n = n.select("id", ((F.col("type") == gene_type) & F.col("in_set").isNotNull()).alias("gene"), (F.col("type") != gene_type).alias("other"))
    s, t = n.select(F.col("id").alias("source"), F.col("gene").alias("gs"), F.col("other").alias("os")), n.select(F.col("id").alias("target"), F.col("gene").alias("gt"), F.col("other").alias("ot"))
    e = edges.join(s, "source").join(t, "target").where("(gs and gt) or (gs and ot) or (os and gt)")
    return e.groupBy(F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v"), "relation").agg(F.max_by("attribute", "ordinal").alias("attribute"))


def mashup(graphs: list[DataFrame], nodes: DataFrame, k: int = 10, steps: int = 15, restart: float = 0.5) -> DataFrame:
    """(id, component, value, sigma): rows of U * sqrt(sigma) of the graphs' diffusion states, ln(p + 1/n), side by side.

    graphs: edges (src, dst, w) over the same nodes.  A state that a walk does not reach counts as p = 0, so the matrix
    is dense: n^2 cells a graph, which is what the method asks for.
    """
    n = nodes.count()
    each = []
    for g, edges in enumerate(graphs):
        states = diffusion(stochastic(edges, nodes), nodes, steps, restart)
        pairs = nodes.select(F.col("id").alias("source")).join(nodes, how="cross")
        full = pairs.join(states, ["source", "id"], "left").select(F.col("id").alias("i"), F.struct(F.lit(g).alias("graph"), "source").alias("j"), F.ln(F.coalesce("p", F.lit(0.0)) + 1.0 / max(n, 1)).alias("v"))
        each.append(full)
    from . import linear

    cells = each[0]
    for more in each[1:]:
        cells = cells.unionByName(more)
    return linear.svd_rows(cells, k)
