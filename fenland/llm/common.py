"""What the operators share: durable cuts of the lineage, folds, hashes, connected components."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fenland.sources.scratch import shared_folder


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and read them from there.

    The folder is `spark.checkpoint.dir`. Only where a session on one machine has none
    a temporary one is set; on a cluster that is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def fresh(prefix: str, df: DataFrame) -> str:
    """A column name that `df` does not have, whatever its columns are called."""
    taken = {c.lower() for c in df.columns}
    name = f"_{prefix}"
    while name.lower() in taken:
        name = f"_{prefix}_{uuid.uuid4().hex[:8]}"
    return name


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that undirected links (a, b) lead to.

    Each round points every node to its smallest neighbour, follows pointers of
    pointers, and puts the pointers in place of the links' ends, so a round at least
    halves the groups left. Nodes without links to others are not returned. Nothing
    but a row count comes to the driver.
    """
    links = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    label = None
    while not links.isEmpty():
        both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a"))
        parent = cut(both.groupBy("node").agg(F.least("node", F.min("other")).alias("up")))
        moved = 1
        while moved:
            above = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
            # roots are nodes too, so every pointer finds its row
            step = cut(parent.join(above, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
            moved = step.where("moved").limit(1).count()
            parent = step.select("node", "up")
        if label is None:
            label = parent.select("node", F.col("up").alias("component"))
        else:
            renamed = parent.select(F.col("node").alias("component"), "up")
            label = label.join(renamed, "component", "left").select("node", F.coalesce("up", "component").alias("component"))
        label = cut(label)
        ends = links
        for end in ("a", "b"):
            ends = ends.join(parent.select(F.col("node").alias(end), F.col("up").alias(f"{end}_up")), end)
        links = cut(ends.select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).where("a <> b").distinct())
    if label is None:
        kind = edges.schema["a"].dataType.simpleString()
        return edges.sparkSession.createDataFrame([], f"node {kind}, component {kind}")
    return label


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spanning_links(links: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> list[tuple[int, int]]:
    """Links (node, smallest node) that join what the matrix joins; rows and columns are node numbers."""
    of_rows, of_columns = rows.astype(np.int64), columns.astype(np.int64)
    used_rows, used_columns = links.any(axis=1), links.any(axis=0)
    links = links[used_rows][:, used_columns]
    of_rows, of_columns = of_rows[used_rows].copy(), of_columns[used_columns].copy()
    names_r, names_c = of_rows.copy(), of_columns.copy()
    far = np.iinfo(np.int64).max
    while True:
        new_columns = np.minimum(of_columns, np.where(links, of_rows[:, None], far).min(axis=0))
        new_rows = np.minimum(of_rows, np.where(links, new_columns[None, :], far).min(axis=1))
        if (new_rows == of_rows).all() and (new_columns == of_columns).all():
            break
        of_rows, of_columns = new_rows, new_columns
    return [*zip(names_r.tolist(), of_rows.tolist(), strict=True), *zip(names_c.tolist(), of_columns.tolist(), strict=True)]


def roots_of(links: list[tuple[int, int]], n: int) -> np.ndarray:
    """The smallest node that each of n nodes is joined to."""
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return np.array([root(x) for x in range(n)], dtype=np.int64)
