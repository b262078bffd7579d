"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Equal vectors are one class. Classes are hashed into blocks, and each pair of blocks is one
task that takes its vectors through products of int8 values (exact integers). With
x = s q + d (s the vector's scale, |d| known), the true cosine lies within
|d_x| |s_y q_y| + |s_x q_x| |d_y| + |d_x| |d_y| of s_x s_y q_x.q_y, so only pairs whose upper
bound reaches the threshold are computed again in double precision. No pair leaves
its task: a task gives link counts per class and the links of a spanning forest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fenland.llm.common import components, cut, roots_of, spanning_links

BLOCK = 8192  # vectors of one block
TILE = 1024  # rows and columns of one product
EXACT_DIMS = 1000  # 127 * 127 * 1000 is below 2 ** 24, so float32 sums of int8 products are exact


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values (held as float32), scale and length of the rounding error of each row."""
    scale = np.abs(unit).max(axis=1) / 127.0
    scale[scale == 0] = 1.0
    q = np.rint(unit / scale[:, None])
    error = np.linalg.norm(unit - q * scale[:, None], axis=1)
    return q.astype(np.float32), scale, error


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = a[:, :EXACT_DIMS] @ b[:, :EXACT_DIMS].T
    if a.shape[1] > EXACT_DIMS:
        total = total.astype(np.float64)
        for k in range(EXACT_DIMS, a.shape[1], EXACT_DIMS):
            total += a[:, k : k + EXACT_DIMS] @ b[:, k : k + EXACT_DIMS].T
    return total


def _links(a, b, threshold: float) -> np.ndarray | None:
    """Boolean matrix of the pairs at or over the threshold, None if there is none."""
    (ua, qa, sa, ea), (ub, qb, sb, eb) = a, b
    worst = 1 + 2 * max(ea.max(), eb.max())
    upper = _products(qa, qb)
    upper *= sa[:, None].astype(np.float32)
    upper *= sb[None, :].astype(np.float32)
    # float32 rounding of the two scalings is far below the slack of 1e-5
    need = (threshold - 1e-5 - worst * ea)[:, None] - (worst * eb)[None, :]
    rows, columns = np.nonzero(upper >= need)
    if not len(rows):
        return None
    out = np.zeros(upper.shape, bool)
    if len(rows) > upper.size // 20:
        maybe = upper >= need
        out = maybe & (ua @ ub.T >= threshold)
    else:
        for k in range(0, len(rows), 65536):
            r, c = rows[k : k + 65536], columns[k : k + 65536]
            good = np.einsum("ij,ij->i", ua[r], ub[c]) >= threshold
            out[r[good], c[good]] = True
    return out if out.any() else None


def _compare(pdf: pd.DataFrame, threshold: float, dtype: str) -> pd.DataFrame:
    pdf = pdf.sort_values(["side", "key"], ignore_index=True)
    raw = np.frombuffer(b"".join(pdf["vector"]), dtype=dtype).reshape(len(pdf), -1).astype(np.float64)
    unit = raw / np.abs(raw).max(axis=1, keepdims=True)  # first, so that squares neither overflow nor vanish
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    q, scale, error = quantised(unit)
    copies, side = pdf["copies"].to_numpy(np.int64), pdf["side"].to_numpy()
    second = int(np.searchsorted(side, 1))
    inner = second == len(pdf)  # one block with itself
    links = np.zeros(len(pdf), np.int64)
    forest: list[tuple[int, int]] = []
    part = lambda k: (unit[k], q[k], scale[k], error[k])
    for i in range(0, second, TILE):
        left = slice(i, min(i + TILE, second))
        for j in range(i if inner else second, len(pdf), TILE):
            right = slice(j, min(j + TILE, len(pdf)))
            found = _links(part(left), part(right), threshold)
            if found is None:
                continue
            if inner and i == j:
                np.fill_diagonal(found, False)
                if not found.any():
                    continue
                links[left] += found @ copies[right]
            else:
                links[left] += found @ copies[right]
                links[right] += copies[left] @ found
            forest += spanning_links(found, np.arange(left.start, left.stop), np.arange(right.start, right.stop))
    roots = roots_of(forest, len(pdf))
    keys = pdf["key"].to_numpy(np.int64)
    used = links > 0
    return pd.DataFrame({"key": keys[used], "links": links[used], "root": keys[roots[used]]})


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.95, id_column: str = "vec_id", vector_column: str = "embedding", block: int = BLOCK
) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Vectors that are null, empty, zero or hold a null or non-finite component link with
    nothing, and so does a row without an id (its component_id is null, it is kept).
    Vectors of different length do not link. A repeated row counts as a vector of its
    own; of rows that share the smallest id each is kept. Other columns stay out.
    """
    element = vectors.schema[vector_column].dataType.elementType
    dtype = "float32" if isinstance(element, T.FloatType) else "float64"
    width = "float" if dtype == "float32" else "double"
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast(f"array<{width}>").alias("vector"))
    limit = float(np.finfo(dtype).max)
    sound = (
        F.col("vec_id").isNotNull()
        & (F.size("vector") > 0)
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= F.lit(limit).cast(width)))
        & F.exists("vector", lambda x: x != 0)
    )
    rows = rows.withColumn("key", F.when(F.coalesce(sound, F.lit(False)), F.xxhash64("vector")))
    classes = rows.where("key IS NOT NULL").groupBy("key", "vector").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))

    pack = "vector binary, key long, least long, copies long, dims int"

    def packed(batches):
        for pdf in batches:
            data = [np.asarray(v, dtype=dtype).tobytes() for v in pdf["vector"]]
            yield pdf.assign(dims=[len(v) for v in pdf["vector"]], vector=data)[["vector", "key", "least", "copies", "dims"]]

    classes = cut(classes.mapInPandas(packed, pack))
    blocks = max(1, -(-classes.count() // block))
    own = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(blocks)).cast("int")
    spread = classes.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    tiles = spread.select(
        "dims",
        F.least("own", "other").alias("first"),
        F.greatest("own", "other").alias("second"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
        "key",
        "copies",
        "vector",
    )
    compare = lambda pdf: _compare(pdf, threshold, dtype)
    found = cut(tiles.groupBy("dims", "first", "second").applyInPandas(compare, "key long, links long, root long"))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    reached = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    linked = classes.select("key", "least", "copies").join(links, "key", "left")
    linked = linked.join(reached.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    smallest = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    by_class = linked.join(smallest, "component").select(
        "key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    out = rows.select("vec_id", "key").join(by_class, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
