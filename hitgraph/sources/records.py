"""Further readers and writers: pathway collections, graph files, styles, run settings, cells, sheets, HTML, payloads."""

from __future__ import annotations

import html
import json
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import read_tsv


def pathway_collection(pathways: DataFrame, selection: str) -> DataFrame:
    """(set, member) of a category, or of "category|subcategory"; the names' prefix up to the first _ goes."""
    category, _, sub = selection.partition("|")
    some = pathways.where(F.col("category") == category)
    some = some.where(F.col("subcategory") == sub) if sub else some
    return some.select(F.regexp_replace("name", "^[^_]*_", "").alias("set"), "member").distinct()


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of a CSV, gzipped or not; node_index is text."""
    return spark.read.option("header", True).csv(path)


def read_graph_edges(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("header", True).csv(path)
    return df.withColumns({c: F.col(c).cast("long") for c in ("source", "target") if c in df.columns})


def gene_set(sets: DataFrame, name: str) -> DataFrame:
    """(member) of one named set."""
    return sets.where(F.col("set") == name).select("member")


def read_style(spark: SparkSession, path: str) -> list[tuple[str | None, object, dict[str, object]]]:
    """Rules of a style JSON, for operators.styling.style: [{"selector": "node[attr = 'value']", "style": {..}}]."""
    import re

    text = "\n".join(r.value for r in spark.read.option("wholetext", True).text(path).collect())  # one settings file
    out = []
    for rule in json.loads(text):
        got = re.search(r"""\[\s*([\w-]+)\s*=\s*["']?([^"'\]]*)["']?\s*\]""", rule["selector"])
        out.append((got[1] if got else None, got[2] if got else None, rule.get("style") or rule.get("css") or {}))
    return out


def write_frame(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def read_frame(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_cells(cells: DataFrame, path: str, rows: int, cols: int) -> None:
    """Cells of a sparse matrix, its size in the folder beside."""
    cells.select("i", "j", "v").write.parquet(f"{path}/cells")
    cells.sparkSession.createDataFrame([(rows, cols)], "rows long, cols long").write.parquet(f"{path}/size")


def read_cells(spark: SparkSession, path: str) -> tuple[DataFrame, int, int]:
    size = spark.read.parquet(f"{path}/size").first()
    return spark.read.schema("i long, j long, v double").parquet(f"{path}/cells"), size["rows"], size["cols"]


@dataclass(frozen=True)
class RunConfig:
    """Settings of a run; unknown keys and missing ones are errors."""

    screens: str
    network: str
    gene_sets: str
    output: str
    threads: int = 1

    @classmethod
    def of(cls, settings: dict[str, str]) -> RunConfig:
        known = {f.name: f for f in fields(cls)}
        unknown = settings.keys() - known.keys()
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**{k: int(v) if known[k].type == "int" else v for k, v in settings.items()})


@dataclass(frozen=True, order=True)
class WalkParameters:
    """Hyper-parameters of an embedding, in the order they are compared by."""

    restart: float
    steps: int
    rank: int
    normalise: bool = False

    @property
    def name(self) -> str:
        return f"restart={self.restart:g},steps={self.steps},rank={self.rank},normalise={str(self.normalise).lower()}"


def read_guide_changes(spark: SparkSession, path: str, comparison: str) -> DataFrame:
    """sgrna, gene, lfc, comparison: distinct rows."""
    df = read_tsv(spark, path)
    return df.select("sgrna", "gene", F.col("lfc").try_cast("double").alias("lfc")).distinct().withColumn("comparison", F.lit(comparison))


def read_gene_scores(spark: SparkSession, path: str, comparison: str) -> DataFrame:
    """All columns under plain names, with the comparison."""
    return read_tsv(spark, path).withColumn("comparison", F.lit(comparison))


def guide_counts_path(root: str, report: str, comparison: int) -> str:
    return f"{root.rstrip('/')}/{report}/{comparison}/counts.tsv"


def write_sheets(sheets: dict[str, DataFrame], path: str) -> None:
    """A workbook as one folder of CSV by sheet."""
    for name, df in sheets.items():
        df.write.option("header", True).csv(f"{path}/{name}")


def html_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """(value): each row as a line of an HTML table, escaped; written with write.text, whatever its size."""
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return df.select(F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), safe(c), F.lit("</td>")) for c in columns], F.lit("</tr>")).alias("value"))


def html_table(df: DataFrame, columns: list[str], most: int = 10_000) -> str:
    """A whole table for a report; it is meant for reading, so more rows than `most` are an error."""
    rows = html_rows(df, columns).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows: write html_rows as text")
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    return f"<table><tr>{head}</tr>{''.join(r.value for r in rows)}</table>"


@dataclass(frozen=True)
class Report:
    """Pages of a report, composed with +; each part has a title and HTML."""

    parts: tuple[tuple[str, str], ...] = ()

    def section(self, title: str, body: str) -> Report:
        return Report((*self.parts, (title, body)))

    def __add__(self, other: Report) -> Report:
        return Report(self.parts + other.parts)

    def render(self) -> str:
        toc = "".join(f'<li><a href="#s{k}">{html.escape(t)}</a></li>' for k, (t, _) in enumerate(self.parts))
        return f"<!DOCTYPE html><html><body><ul>{toc}</ul>{''.join(f'<h2 id={chr(34)}s{k}{chr(34)}>{html.escape(t)}</h2>{b}' for k, (t, b) in enumerate(self.parts))}</body></html>"


def csv_lines(df: DataFrame, columns: list[str], sep: str = ",") -> DataFrame:
    """(value): rows as CSV lines, cells quoted where they need it."""

    def cell(c: str) -> Column:
        x = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.when(F.contains(x, F.lit(sep)) | F.contains(x, F.lit('"')) | F.contains(x, F.lit("\n")), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)

    return df.select(F.concat_ws(sep, *[cell(c) for c in columns]).alias("value"))


def graph_object(nodes: DataFrame, edges: DataFrame, types: list[str], names: list[str], rules: list[tuple[str | None, object, dict[str, object]]]) -> tuple[DataFrame, DataFrame]:
    """(styled nodes, styled edges): nodes of the types or names, edges between them.

    nodes: id, name, type.  edges: src, dst and others.
    """
    from ..operators import styling

    some = nodes.where(F.col("type").isin(types) | F.col("name").isin(names))
    ends = some.select("id")
    inner = edges.join(ends, edges["src"] == ends["id"], "left_semi").join(ends, edges["dst"] == ends["id"], "left_semi")
    for_nodes = [r for r in rules if r[0] is None or r[0] in some.columns]
    for_edges = [r for r in rules if r[0] in inner.columns]
    return styling.style(some, for_nodes) if for_nodes else some, styling.style(inner, for_edges) if for_edges else inner


def gene_graph(nodes: DataFrame, edges: DataFrame, genes: DataFrame, gene_type: str, types: list[str], names: list[str], rules: list[tuple[str | None, object, dict[str, object]]]) -> tuple[DataFrame, DataFrame]:
    """(styled nodes, styled edges) of a gene set's multigraph.

    nodes: id, name, type; those of the types or names count.  edges: source, target, relation, attribute, ordinal, one
    for each pair and relation (the last by ordinal).  Edges join genes of the set to each other and to nodes that
    are no genes; the nodes left are those at their ends.  genes: name.
    """
    from ..operators import graph, styling

    some = nodes.where(F.col("type").isin(types) | F.col("name").isin(names))
    chosen = some.join(genes.select("name").distinct(), "name", "left_semi").select("id")
    multi = graph.gene_multigraph(some.select("id", "type"), edges, chosen, gene_type)
    ends = multi.select(F.col("u").alias("id")).union(multi.select("v")).distinct()
    left = some.join(ends, "id", "left_semi")
    for_nodes, for_edges = [r for r in rules if r[0] is None or r[0] in left.columns], [r for r in rules if r[0] in multi.columns]
    return styling.style(left, for_nodes) if for_nodes else left, styling.style(multi, for_edges) if for_edges else multi
