"""Embedding near-duplicates by a pivot-permutation index (operator 8).

A vector is described by its nearest reference points (pivots) in order.  Vectors that are close
see the same pivots first, so they share several of their first pivots.  The index is inverted:
each pair of a vector's first pivots is a posting list, and vectors found in one list share at
least two pivots.  Candidates are verified by their exact cosine, a block of a list at a time.
Equal vectors are described and compared once, with the number of their copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import lean, written


@dataclass(frozen=True)
class PivotParams:
    """``prefix`` nearest of the pivots describe a vector; lists are cut into blocks of ``block``.

    The number of pivots of a dimension grows with the square root of the number of its vectors, so
    that lists stay short; they are the vectors of the least hashes.  ``max_pivots`` (reached at
    some 10^9 vectors) bounds what a task holds; beyond it lists grow, and no link is lost by that.
    """

    cosine: float = 0.95
    prefix: int = 6
    min_pivots: int = 32
    max_pivots: int = 1 << 16
    block: int = 2000


def _unit(vectors: DataFrame, id_name: str, vector_name: str) -> DataFrame:
    """(id, v) of the usable vectors, scaled to length 1 in double precision."""
    v = F.transform(F.col(vector_name), lambda x: x.cast("double"))
    rows = vectors.where(F.col(id_name).isNotNull() & F.col(vector_name).isNotNull()).select(F.col(id_name).cast("long").alias("id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    largest = F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    rows = rows.where(finite).withColumn("m", largest).where("m > 0").select("id", F.transform("v", lambda x: x / F.col("m")).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return rows.withColumn("n", norm).select("id", F.transform("v", lambda x: x / F.col("n")).alias("v"))


def _described(pivots: dict[int, np.ndarray], p: PivotParams):
    """Adds the ordered nearest pivots of the vector's dimension; a dimension without pivots has one vector, which is left out."""

    def near_of(v: np.ndarray, own: np.ndarray) -> np.ndarray:
        prefix = min(p.prefix, len(own))
        scores = v @ own.T
        top = np.argpartition(-scores, prefix - 1, axis=1)[:, :prefix] if prefix < len(own) else np.tile(np.arange(prefix), (len(v), 1))
        return np.sort(top, axis=1).astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column("v").offsets.to_numpy())
            for size in np.unique(sizes).tolist():
                if size not in pivots:
                    continue
                rows = np.flatnonzero(sizes == size)
                step = max(1, (1 << 21) // len(pivots[size]))
                for part in range(0, len(rows), step):
                    own = batch.take(pa.array(rows[part : part + step]))
                    near = near_of(own.column("v").flatten().to_numpy().reshape(own.num_rows, size), pivots[size])
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(list(near), pa.list_(pa.int32()))], ["id", "v", "copies", "near"])

    return run


def _pivots(own: DataFrame, p: PivotParams) -> dict[int, np.ndarray]:
    """For each dimension of two or more vectors its pivots; one row a dimension and the pivots come to the driver."""
    sizes = {r.size: r.n for r in own.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).where("n > 1").collect()}
    wanted = {size: int(min(p.max_pivots, n, max(p.min_pivots, 2 * n**0.5))) for size, n in sizes.items()}
    if not wanted:
        return {}
    # about twice as many as are wanted pass a threshold of the hash, so few rows travel and none are sorted by Spark
    shares = [(size, n_wanted, min(1.0, (2 * n_wanted + 64) / sizes[size])) for size, n_wanted in wanted.items()]
    bound = own.sparkSession.createDataFrame(shares, "size int, wanted int, share double")
    h = F.xxhash64("id")
    hashed = own.select(F.size("v").alias("size"), "id", "v", h.alias("h"), (F.pmod(h, F.lit(1 << 30)) / (1 << 30)).alias("place"))
    rows = sorted(hashed.join(bound, "size").where("place < share").select("size", "place", "id", "v").collect(), key=lambda r: (r.size, r.place, r.id))
    return {size: np.array([r.v for r in rows if r.size == size][: wanted[size]]) for size in wanted}


def links(vectors: DataFrame, id_name: str = "vec_id", vector_name: str = "embedding", params: PivotParams = PivotParams()) -> DataFrame:
    """One row a vector: id, n_links (other vectors linked directly), component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and
    vectors of different dimensions don't link with each other; each dimension has its own pivots,
    however few vectors it has.  Rows with a null id are left out; rows that repeat an id
    count once, with the least of its usable vectors.  Columns that clash with the output's aren't
    read.  Equal directions are verified like any others, so ties need no rule.

    A list of very many vectors is cut into blocks, and each pair of blocks is one group; a group
    returns how many links each of its vectors has and links that span its parts, never all pairs.
    A pair that shares several lists is counted in the first of them only.
    """
    spark = vectors.sparkSession
    all_ids = vectors.where(F.col(id_name).isNotNull()).select(F.col(id_name).cast("long").alias("id")).distinct()
    unit = written(_unit(vectors, id_name, vector_name).groupBy("id").agg(F.min("v").alias("v")).withColumn("key", F.sha2(F.array_join(F.col("v").cast("array<string>"), " "), 256)), "vectors")
    # of equal vectors that of the least id stands for all
    own = written(unit.groupBy("key").agg(F.min(F.struct("id", "v")).alias("least"), F.count("*").alias("copies")).select("key", "least.id", "least.v", "copies"), "distinct-vectors")
    counts, edges = _links(own.drop("key"), _pivots(own, params), params)
    edges = written(edges, "edges")
    counts = counts.groupBy("id").agg(F.sum("n_links").alias("n_links"))
    parts = components(edges) if not edges.isEmpty() else spark.createDataFrame([], "node long, component long")
    # the rows of the distinct vectors are written, so that a vector of very many copies is a skewed key that Spark splits
    each = own.select("key", "id", "copies").join(counts, "id", "left").join(parts.withColumnRenamed("node", "id"), "id", "left")
    each = written(each.select("key", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")), "linked")
    usable = unit.select("id", "key").join(each, "key").drop("key")
    out = all_ids.join(usable, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_name), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def _links(own: DataFrame, pivots: dict[int, np.ndarray], p: PivotParams) -> tuple[DataFrame, DataFrame]:
    """(id, n_links) within lists and (src, dst) that span what is linked; a list belongs to one dimension."""
    m = max((len(x) for x in pivots.values()), default=0) + 1
    held = own.sparkSession.sparkContext.broadcast(pivots)
    described = own.mapInArrow(lean(lambda batches: _described(held.value, p)(batches)), "id long, v array<double>, copies long, near array<int>")
    place = lambda a, b: (F.size("v").cast("long") * m + a) * m + b
    pair = F.flatten(F.transform("near", lambda a: F.transform(F.filter("near", lambda b: b > a), lambda b: place(a, b))))
    described = written(described, "described")
    sizes = described.select(F.explode(pair).alias("list")).groupBy("list").agg(F.count("*").alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / p.block).cast("int")
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    listed = described.select("id", "v", "copies", "near", F.explode(pair).alias("list")).join(sizes, "list").withColumn("blocks", blocks).withColumn("mine", mine)
    # a vector goes to the groups of its own block with every block
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = listed.select("id", "v", "copies", "near", "list", "mine", other).select("id", "v", "copies", "near", "list", "mine", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))
    result = dealt.groupBy("list", "lo", "hi").applyInArrow(_verify(m, p.cosine), "id long, other long, n_links long")
    result = written(result, "links")
    return result.where("other is null").select("id", "n_links"), result.where("other is not null").select(F.col("id").alias("src"), F.col("other").alias("dst"))


def _verify(m: int, cosine: float):
    none = pa.table({"id": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "n_links": pa.array([], pa.int64())})

    def run(group: pa.Table) -> pa.Table:
        plain = lambda name: group.column(name).to_numpy()
        wide = lambda name: group.column(name).combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1)
        ids, mine, copies, v, near = plain("id"), plain("mine"), plain("copies"), wide("v"), wide("near")
        this, lo, hi = (group.column(c)[0].as_py() for c in ("list", "lo", "hi"))
        first, second = this // m % m, this % m
        rows = np.arange(len(ids)) if lo == hi else np.flatnonzero(mine == lo)
        columns = np.arange(len(ids)) if lo == hi else np.flatnonzero(mine == hi)
        has = np.zeros((len(ids), int(near.max()) + 1), dtype=bool)
        has[np.arange(len(ids))[:, None], near] = True
        count = np.zeros(len(ids), dtype=np.int64)
        label = np.arange(len(ids))
        for part in range(0, len(rows), 512):
            r = rows[part : part + 512]
            linked = v[r] @ v[columns].T >= cosine
            if lo == hi:
                linked &= columns[None, :] > r[:, None]
            i, j = np.nonzero(linked)
            i, j = r[i], columns[j]
            # the pair's first list is that of its two smallest shared pivots
            both = has[i] & has[j]
            one = both.argmax(axis=1)
            both[np.arange(len(i)), one] = False
            ours = (one == first) & (both.argmax(axis=1) == second)
            i, j = i[ours], j[ours]
            count += np.bincount(i, copies[j], len(ids)).astype(np.int64) + np.bincount(j, copies[i], len(ids)).astype(np.int64)
            label = _merged(label, i, j)
        some = np.flatnonzero(count)
        if not len(some):
            return none
        other = np.flatnonzero(label != np.arange(len(ids)))
        return pa.table({
            "id": pa.array(np.concatenate([ids[some], ids[other]]), pa.int64()),
            "other": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(ids[label[other]], pa.int64())]),
            "n_links": pa.array(np.concatenate([count[some], np.zeros(len(other), dtype=np.int64)]), pa.int64()),
        })

    return run


def _merged(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (roots, by the least position) after the pairs are linked too."""
    label = label.copy()
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart]))
        while not (label[label] == label).all():
            label = label[label]
