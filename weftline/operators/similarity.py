"""Exact pairs of similar vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.session import parallelism, stage, unchunked

#: Pivots, at least and at most (about a root of the vectors between), and members of a class of copies in one task's part.
LEAST_PIVOTS, MOST_PIVOTS, PART = 16, 1024, 2048
#: Numbers of the vectors in one block, its least vectors, and products that a task holds at once.
BLOCK, LEAST_BLOCK, STRIP = 1 << 21, 1024, 1 << 21


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    norm = np.sqrt((rows**2).sum(1, keepdims=True))
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def _block(dim: Column) -> Column:
    """Vectors of one block."""
    return F.greatest(F.lit(LEAST_BLOCK), (F.lit(BLOCK) / F.greatest(dim, F.lit(1))).cast("int"))


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, base): (store, id, rep) with the least id of exact copies, and each such vector once.

    base: store, id, embedding, dim and own, the cosine of the vector with its
    copies: 0 of a zero vector, null of one with null or NaN.
    """
    hashed = vectors.withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.hash("embedding"))
    own = F.when(F.exists("embedding", lambda x: x.isNull() | F.isnan(x)), None).when(F.exists("embedding", lambda x: x != 0), 1.0).when(F.col("embedding").isNotNull(), 0.0)
    # copies of one task fall together before they are sent
    least = hashed.groupBy("store", "h1", "h2").agg(F.min("id").alias("id"), F.min_by("embedding", "id").alias("embedding"))
    base = stage(least.select("store", "id", "embedding", F.size("embedding").alias("dim"), own.alias("own"), "h1", "h2"))
    members = hashed.select("store", "id", "h1", "h2").join(base.select("store", "h1", "h2", F.col("id").alias("rep")), ["store", "h1", "h2"])
    return stage(members.select("store", "id", "rep")), base.drop("h1", "h2")


def similar_pairs(vectors: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(pairs, membership): all pairs of different vectors of a store with cosine >= threshold, and the copies.

    pairs: store, a, b, score with a < b, both least of their copies; membership:
    store, id, rep. Exact: the vectors of a store are cut into blocks, and every
    two blocks meet in one task, so that a vector is sent once for each block.
    Zero vectors have no similar ones when threshold > 0. One dimension a store.
    """
    members, base = _classes(vectors)
    return _pairs(base, threshold), members


def _pivots(base: DataFrame, reach: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """dim -> pivots and their distances, of the dimensions whose vectors are sent no more often with pivots than without."""
    of_stores = base.groupBy("store", "dim").agg(F.count("*").alias("n"))
    dims = of_stores.groupBy("dim").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.ceil(F.col("n") / _block(F.col("dim")))) / F.sum("n")).alias("copies")).limit(1001).collect()
    if len(dims) > 1000:
        raise ValueError("more than 1000 dimensions in one table")
    pivots = {}
    for dim, n, copies in dims:
        if copies <= 1:
            continue
        count = max(LEAST_PIVOTS, min(MOST_PIVOTS, int(n**0.5)))
        some = base.where((F.col("dim") == dim) & (F.col("own") > 0)).orderBy(F.xxhash64("id"), "store", "id").limit(2 * count).toPandas()
        if len(some) <= count:
            continue
        x = _unit(np.stack(some["embedding"]))
        p = x[:count]
        gaps = np.sqrt((2 - 2 * p @ p.T).clip(0))
        if _visits(x[count:], p, gaps, reach)[1].sum(1).mean() <= max(2, copies):
            pivots[dim] = p, gaps
    return pivots


def _visits(x: np.ndarray, p: np.ndarray, gaps: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest pivot, and whether it may be similar to one that lives with another, lesser pivot."""
    s = x @ p.T
    home = s.argmax(1)
    rows, gap = np.arange(len(x)), gaps[home]
    # sine of the angle between the vector and the plane that parts the two pivots' halves
    plane = np.divide(s[rows, home][:, None] - s, gap, out=np.zeros_like(s), where=gap > 0)
    near = (plane <= reach) & (np.arange(len(p)) < home[:, None])
    near[rows, home] = True
    return home, near


def _pairs(base: DataFrame, threshold: float) -> DataFrame:
    """Pairs of base as of similar_pairs.

    Where a store has several blocks and the vectors are clustered, each lives
    with its nearest pivot and also visits the lesser pivots whose half-space it
    is near enough to, so two vectors within the angle of the threshold meet
    once, where one of them lives. Without clusters all live in one cell. A cell
    larger than a block is cut: those living there meet each other and the
    visitors block by block.
    """
    base = base.where(F.col("own").isNotNull() if threshold <= 0 else F.col("own") > 0)
    reach = float(np.sqrt(max(0.0, 1 - threshold**2))) + 1e-6 if threshold > 0 else np.inf
    pivots = _pivots(base, reach)
    kind = base.schema["embedding"].dataType.simpleString()
    if pivots:
        sent = base.sparkSession.sparkContext.broadcast(pivots)

        def place(batches):
            for batch in batches:
                for dim, rows in batch.groupby("dim"):
                    if dim in sent.value:
                        home, near = _visits(_unit(np.stack(rows["embedding"])), *sent.value[dim], reach)
                    else:
                        home, near = np.zeros(len(rows), dtype=int), np.ones((len(rows), 1), dtype=bool)
                    yield unchunked(rows.assign(home=home.astype("int32"), visits=[np.flatnonzero(r).astype("int32").tolist() for r in near])[["store", "dim", "id", "embedding", "home", "visits"]])

        placed = base.select("store", "dim", "id", "embedding").mapInPandas(place, f"store string, dim int, id bigint, embedding {kind}, home int, visits array<int>")
        visits = placed.select("store", "dim", F.explode("visits").alias("cell"), (F.col("home") == F.col("cell")).alias("lives"), "id", "embedding")
    else:
        visits = base.select("store", "dim", F.lit(0).alias("cell"), F.lit(True).alias("lives"), "id", "embedding")
    blocks = lambda n: F.ceil(n / _block(F.col("dim"))).cast("int")
    sizes = visits.groupBy("store", "dim", "cell").agg(F.count_if("lives").alias("live"), F.count_if(~F.col("lives")).alias("come"))
    # few: a large cell has more vectors, visits counted, than a block
    large = sizes.where(F.col("live") + F.col("come") > _block(F.col("dim"))).select("store", "dim", "cell", blocks(F.col("live")).alias("b"), blocks(F.col("come")).alias("p"))
    at = visits.join(F.broadcast(stage(large)), ["store", "dim", "cell"], "left").withColumn("b", F.coalesce("b", F.lit(1))).withColumn("p", F.coalesce("p", F.lit(0)))
    h = F.xxhash64("id")
    at = at.withColumn("k", F.when(F.col("lives"), F.pmod(h, "b")).when(F.col("p") > 0, F.col("b") + F.pmod(h, "p")).otherwise(0).cast("int"))
    # a block of those living there meets itself and every later block
    earlier = F.transform(F.sequence(F.lit(0), F.least("k", F.col("b") - 1)), lambda i: F.struct(i.alias("i"), F.col("k").alias("j")))
    later = F.when(F.col("lives") & (F.col("k") + 1 < F.col("b") + F.col("p")), F.transform(F.sequence(F.col("k") + 1, F.col("b") + F.col("p") - 1), lambda j: F.struct(F.col("k").alias("i"), j.alias("j")))).otherwise(F.array())
    met = at.select("store", "dim", "cell", F.explode(F.concat(earlier, later)).alias("of"), "k", "lives", "id", "embedding").select("store", "dim", "cell", "of.i", "of.j", "k", "lives", "id", "embedding")

    def compare(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, dim, _, i, j = (x.as_py() for x in key)
        parts = [(b["id"].to_numpy(), (b["k"].to_numpy() == i) & b["lives"].to_numpy(zero_copy_only=False), b["embedding"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim)) for b in batches]
        ids, live, x = (np.concatenate(column) for column in zip(*parts))
        del parts
        order = np.argsort(~live, kind="stable")
        ids, x, left = ids[order], x[order], int(live.sum())
        unit = _unit(x).astype(np.float32)
        # single products differ from double ones by less
        slack = (dim + 8) * 2.0**-23
        step = max(1, min(STRIP // max(1, len(ids)), 1024))
        for low in range(0, left, step):
            rows = slice(low, min(low + step, left))
            first = low if i == j else left
            s = unit[rows] @ unit[first:].T
            m, n = np.divmod(np.flatnonzero(s >= threshold - slack), max(1, s.shape[1]))
            if i == j:
                m, n = m[keep := n > m], n[keep]
            for some in range(0, len(m), 1 << 16):
                a, b = m[some : some + (1 << 16)] + low, n[some : some + (1 << 16)] + first
                score = np.einsum("ij,ij->i", _unit(x[a]), _unit(x[b]))
                keep = (score >= threshold) & (ids[a] != ids[b])
                a, b, score = ids[a[keep]], ids[b[keep]], score[keep]
                yield pa.RecordBatch.from_arrays([pa.array([store] * len(a), pa.string()), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(score)], ["store", "a", "b", "score"])

    found = met.groupBy("store", "dim", "cell", "i", "j").applyInArrow(compare, "store string, a bigint, b bigint, score double")
    return found.groupBy("store", "a", "b").agg(F.max("score").alias("score"))


def _lists(members: DataFrame) -> DataFrame:
    """(store, rep, part, of): the members of each class as lists, in parts of about PART."""
    large = members.groupBy("store", "rep").agg(F.ceil(F.count("*") / F.lit(PART)).cast("int").alias("parts")).where("parts > 1")
    filed = members.join(F.broadcast(stage(large)), ["store", "rep"], "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int"))
    return stage(filed.groupBy("store", "rep", "part").agg(F.collect_list(F.struct("id", "name")).alias("of")))


def merge_candidates(vectors: DataFrame, threshold: float = 0.85, names: DataFrame | None = None) -> DataFrame:
    """(store, a, b, score) of all pairs of entity vectors (store, id, embedding) at least threshold similar, a < b.

    With names (id, name), also name_a and name_b.

    Vectors are compared once for all their copies; every pair of copies and
    every pair of a copy with what its vector is similar to is a row of its own.
    These rows, many more than the vectors if there are many copies, are made
    last, from pairs of lists of copies with their names: none of them is sent.
    """
    members, base = _classes(vectors)
    pairs, members = stage(_pairs(base, threshold)), members.distinct()
    named = members.withColumn("name", F.lit(None).cast("string")) if names is None else members.join(names.select("id", "name"), "id", "left")
    lists = _lists(named)
    of_a = lists.select("store", F.col("rep").alias("i"), F.col("part").alias("p"), F.col("of").alias("x"))
    of_b = lists.select("store", F.col("rep").alias("j"), F.col("part").alias("q"), F.col("of").alias("y"))
    across = pairs.select("store", F.col("a").alias("i"), F.col("b").alias("j"), "score").join(of_a, ["store", "i"]).join(of_b, ["store", "j"])
    # copies of a zero vector have cosine 0, those of one with NaN none
    own = base.where(F.col("own") >= threshold).select("store", F.col("id").alias("i"), F.col("own").alias("score")).distinct()
    inside = of_a.join(own, ["store", "i"])
    itself = inside.where(F.size("x") > 1).withColumns({"j": F.col("i"), "q": F.col("p"), "y": F.col("x")})
    # a large class also meets itself part by part, so that it is many tasks
    apart = inside.join(of_b.withColumnRenamed("j", "i"), ["store", "i"]).where("p < q").withColumn("j", F.col("i"))
    met = across.unionByName(itself).unionByName(apart).repartition(parallelism(vectors.sparkSession), "store", "i", "j", "p", "q")
    same = (F.col("i") == F.col("j")) & (F.col("p") == F.col("q"))
    each = met.select("store", "score", same.alias("same"), "y", F.explode("x").alias("x")).select("store", "score", "same", "x", F.explode("y").alias("y"))
    each = each.where((F.col("x.id") < F.col("y.id")) | ~F.col("same") & (F.col("x.id") > F.col("y.id")))
    first = F.col("x.id") < F.col("y.id")
    a, b = F.when(first, F.col("x")).otherwise(F.col("y")), F.when(first, F.col("y")).otherwise(F.col("x"))
    found = each.select("store", a["id"].alias("a"), a["name"].alias("name_a"), b["id"].alias("b"), b["name"].alias("name_b"), "score")
    return found.drop("name_a", "name_b") if names is None else found
