"""The most similar vectors of every vector, by an inverted file with product quantisation.

Method: a coarse quantiser (k-means on unit vectors, about a root of their number
of centroids) files every vector under its nearest centroid; what the centroid
leaves over is coded by a product quantiser, one byte for each few dimensions.
The queries of a list search the codes of the lists nearest to it: each adds up
its asymmetric distance tables over the codes and keeps a shortlist, which is
ranked again by the exact cosine. Every vector is a query, and each is searched
only among the vectors of its own store.

How many lists are searched, how long the shortlist is and by how much codes may
be wrong are not fixed: they are measured on the sample, as what it takes to find
`recall` of the true neighbours (of at least min_cosine) there.

The quantisers are fitted on a bounded sample: at most `sample` vectors and
`sample_floats` numbers of each dimension, those with the least hash of store and
id, so the index is the same each time. Every vector is filed.

Scale: vectors travel to their list once, only codes (a byte for `group` dimensions,
and the id) travel to every list that searches them, and the vectors of the
shortlists are fetched once for all queries of a list. Vectors that are exact
copies in one store are filed once and put back at the end, so a large group of
copies costs nothing. Lists of many queries or codes are cut into blocks of
`query_block` and `code_block`, so that no task holds a whole list. Only the
quantisers are sent to all tasks, whose size the sample bounds.

Usable vectors have the dimension of their store, finite elements and are not
all zeros; others are left out, as are rows with a null id, store or vector and
rows of a store without a row in stores. Ties in similarity go to the lesser
id. Repeated rows count once; of several vectors of one id in one store the
last embedded counts, equal times by the greater bytes. An empty table gives
an empty result. Extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.session import stage

#: Parts into which the members of a copy group are cut where they get their group's neighbours.
SALTS = 16


@dataclass(frozen=True)
class IvfPqConfig:
    """k neighbours; neighbours under min_cosine are left out. list_root: lists for each root of the number of vectors."""

    k: int = 5
    min_cosine: float = -1.0
    recall: float = 0.96
    sample: int = 65_536
    sample_floats: int = 8_000_000
    list_root: float = 2.0
    least_probes: int = 8
    group: int = 4
    code_block: int = 65_536
    query_block: int = 4_096
    measured: int = 1_024


@dataclass
class Quantiser:
    """Fitted on unit vectors of one dimension."""

    centroids: np.ndarray  # lists x dim
    codebooks: list[np.ndarray]  # for each group of dimensions: codes x width
    cuts: list[tuple[int, int]]
    searched: np.ndarray = field(default=None)  # for each list: the lists its queries search
    homes: list = field(default=None)  # for each list: the lists whose queries search it
    shortlist: int = 16
    margin: float = 2.0  # by how much a code may say less than the cosine is

    def nearest(self, unit: np.ndarray) -> np.ndarray:
        """The nearest list of each vector, ties to the lesser list."""
        out = np.empty(len(unit), dtype=np.int32)
        half = (self.centroids**2).sum(1) / 2
        for a in range(0, len(unit), 2048):
            out[a : a + 2048] = np.argmin(half - unit[a : a + 2048] @ self.centroids.T, axis=1)
        return out

    def codes(self, unit: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = unit - self.centroids[lists]
        out = np.empty((len(unit), len(self.cuts)), dtype=np.uint8)
        for m, ((a, b), book) in enumerate(zip(self.cuts, self.codebooks)):
            out[:, m] = np.argmin((book**2).sum(1) / 2 - rest[:, a:b] @ book.T, axis=1)
        return out

    def scores(self, queries: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What the codes say of each query's cosine with each entry: by its distance table of each group."""
        every, which = np.unique(lists, return_inverse=True)
        score = (queries @ self.centroids[every].T)[:, which]
        for (a, b), book, column in zip(self.cuts, self.codebooks, codes.T):
            score += (queries[:, a:b] @ book.T)[:, column]
        return score


def kmeans(points: np.ndarray, n: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Plain Lloyd rounds from distinct seeded points; empty cells keep their centre."""
    unique = np.unique(points, axis=0)
    if len(unique) <= n:
        return unique
    centres = unique[np.sort(np.random.default_rng(seed).choice(len(unique), n, replace=False))].copy()
    for _ in range(rounds):
        near = np.empty(len(points), dtype=np.int64)
        half = (centres**2).sum(1) / 2
        for a in range(0, len(points), 4096):
            near[a : a + 4096] = np.argmin(half - points[a : a + 4096] @ centres.T, axis=1)
        order = np.argsort(near, kind="stable")
        filled, begins = np.unique(near[order], return_index=True)
        centres[filled] = np.add.reduceat(points[order], begins, axis=0) / np.diff([*begins, len(points)])[:, None]
    return centres


def fit(unit: np.ndarray, stores: np.ndarray, lists: int, config: IvfPqConfig = IvfPqConfig()) -> Quantiser:
    """A quantiser from a sample of unit vectors and their stores, with the search it takes for the wanted recall."""
    centroids = kmeans(unit, lists).astype(np.float32)
    dim = unit.shape[1]
    cuts = [(a, min(a + config.group, dim)) for a in range(0, dim, config.group)]
    found = Quantiser(centroids, [], cuts)
    filed = found.nearest(unit)
    rest = (unit - centroids[filed])[:8192]
    found.codebooks = [kmeans(rest[:, a:b], 256, rounds=5).astype(np.float32) for a, b in cuts]
    return measure(found, unit, stores, filed, config)


def measure(found: Quantiser, unit: np.ndarray, stores: np.ndarray, filed: np.ndarray, config: IvfPqConfig) -> Quantiser:
    """found with the lists to search, the shortlist and the margin that the sample asks for."""
    n_lists = len(found.centroids)
    order = np.empty((n_lists, n_lists), dtype=np.int32)
    for a in range(0, n_lists, 1024):
        c = found.centroids[a : a + 1024]
        order[a : a + 1024] = np.argsort((found.centroids**2).sum(1) / 2 - c @ found.centroids.T, axis=1, kind="stable")
    codes = found.codes(unit, filed)
    places, ranks, errors = [0], [0], [0.0]
    for q in range(0, len(unit), max(1, len(unit) // config.measured)):
        own = np.flatnonzero(stores == stores[q])
        exact = unit[own] @ unit[q]
        exact[own == q] = -np.inf
        top = np.argsort(-exact, kind="stable")[: config.k]
        top = top[exact[top] >= max(config.min_cosine, -1.0)]
        if not len(top):
            continue
        said = found.scores(unit[q : q + 1], filed[own], codes[own])[0]
        said_rank = np.empty(len(own), dtype=np.int64)
        said_rank[np.argsort(-said, kind="stable")] = np.arange(len(own))
        where = np.empty(n_lists, dtype=np.int64)
        where[order[filed[q]]] = np.arange(n_lists)
        places += where[filed[own[top]]].tolist()
        ranks += said_rank[top].tolist()
        errors += (exact[top] - said[top]).tolist()
    # each of the three may lose a share of what may be lost
    share = 1 - (1 - config.recall) / 3
    probes = min(n_lists, max(config.least_probes, int(np.quantile(places, share, method="higher")) + 1))
    found.shortlist = max(4 * config.k, 2 * int(np.quantile(ranks, share, method="higher")) + 2)
    found.margin = float(np.quantile(errors, share, method="higher")) + 1e-3
    found.searched = np.sort(order[:, :probes], axis=1)
    found.homes = [[] for _ in range(n_lists)]
    for home, lists in enumerate(found.searched.tolist()):
        for at in lists:
            found.homes[at].append(home)
    return found


def _matrix(column, dim: int) -> np.ndarray:
    """Vectors of one dimension from their bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f4").reshape(-1, dim)


def _unit(rows: np.ndarray) -> np.ndarray:
    wide = rows.astype(np.float64)
    return wide / np.sqrt((wide**2).sum(1, keepdims=True))


def usable_vectors(embeddings: DataFrame, stores: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(store, id, vector): one usable vector of each id in each store, as the bytes of its numbers."""
    dims = stores.select(F.col("name").alias("store"), "dim").where("store is not null and dim > 0").groupBy("store").agg(F.min("dim").alias("dim"))
    rows = embeddings.select("store", F.col(key).cast("bigint").alias("id"), F.col("embedding").cast("array<float>").alias("vector"), F.col("embedded_at").cast("timestamp").alias("embedded_at"))

    def usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            numbers = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), dtype="<f4") + np.float32(0)
            last = np.cumsum(sizes)
            count = lambda hit: np.concatenate([[0], np.cumsum(hit)])
            faults, filled = count(~np.isfinite(numbers)), count(numbers != 0)
            good = (sizes == batch.column("dim").to_numpy()) & (faults[last] == faults[last - sizes]) & (filled[last] > filled[last - sizes])
            data, keep = numbers.tobytes(), np.flatnonzero(good)
            packed = pa.array([data[4 * (last[i] - sizes[i]) : 4 * last[i]] for i in keep], pa.binary())
            kept = batch.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([kept.column("store"), kept.column("id"), kept.column("embedded_at"), packed], ["store", "id", "embedded_at", "vector"])

    good = rows.where("id is not null and vector is not null").join(dims, "store").mapInArrow(usable, "store string, id bigint, embedded_at timestamp, vector binary")
    return good.groupBy("store", "id").agg(F.max(F.struct("embedded_at", "vector")).alias("last")).select("store", "id", F.col("last.vector").alias("vector"))


def quantisers_of(distinct: DataFrame, config: IvfPqConfig) -> dict[int, Quantiser]:
    """Dimension -> quantiser of different vectors (store, id, vector, dim); dimensions are those of stores, so they are few."""
    counts = {r["dim"]: r["n"] for r in distinct.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    fitted = {}
    for dim, n in sorted(counts.items()):
        most = max(1, min(config.sample, config.sample_floats // dim))
        share = min(1.0, 1.25 * most / n)
        place = F.pmod(F.xxhash64("id", "store"), F.lit(1_000_000))
        picked = distinct.where((F.col("dim") == dim) & (place <= int(share * 1_000_000))).orderBy(place, "store", "id").limit(most)
        table = picked.select("store", "vector").toArrow()
        if table.num_rows:
            unit = _unit(_matrix(table.column("vector"), dim)).astype(np.float32)
            stores = np.unique(np.array(table.column("store").to_pylist(), dtype=object).astype(str), return_inverse=True)[1]
            fitted[dim] = fit(unit, stores, int(max(1, min(config.list_root * n**0.5, len(unit) // 8))), config)
    return fitted


def neighbours(vectors: DataFrame, config: IvfPqConfig = IvfPqConfig()) -> DataFrame:
    """(store, id, neighbour, cosine, place) for usable vectors (store, id, vector)."""
    spark = vectors.sparkSession
    keep = config.k + 1
    # one row for each different vector of a store; its least members are all that a neighbour list can use
    members = stage(vectors.select("store", "id", "vector", (F.octet_length("vector") / 4).cast("int").alias("dim"), F.xxhash64("vector").alias("h1"), F.hash("vector").alias("h2")))
    copies = ["store", "h1", "h2"]
    several = members.groupBy(*copies).agg(F.count("*").alias("n"), F.min("id").alias("rep")).where("n > 1").select(*copies, "rep")
    salted = members.select("store", "id", "h1", "h2").join(several, copies).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    salted = stage(salted)
    least = Window.partitionBy(*copies, "salt").orderBy("id")
    some = salted.withColumn("n", F.row_number().over(least)).where(F.col("n") <= keep)
    groups = stage(some.groupBy(*copies, "rep").agg(F.slice(F.array_sort(F.collect_list("id")), 1, keep).alias("ids")))
    distinct = members.select("store", "id", "vector", "dim").join(salted.where("id <> rep").select("store", "id"), ["store", "id"], "left_anti")
    quantisers = spark.sparkContext.broadcast(quantisers_of(distinct, config))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                rows = batch.filter(pa.array(dims == dim))
                q = quantisers.value[int(dim)]
                unit = _unit(_matrix(rows.column("vector"), int(dim))).astype(np.float32)
                lists = q.nearest(unit)
                codes = q.codes(unit, lists)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("store"), rows.column("id"), rows.column("vector"), rows.column("dim"), pa.array(lists, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())],
                    ["store", "id", "vector", "dim", "list", "code"],
                )

    def heard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            homes = [quantisers.value[d].homes[i] for d, i in zip(batch.column("dim").to_pylist(), batch.column("list").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("store", "dim", "list", "n")), pa.array(homes, pa.list_(pa.int32()))], ["store", "dim", "list", "n", "homes"])

    placed = stage(distinct.mapInArrow(place, "store string, id bigint, vector binary, dim int, list int, code binary"))
    sizes = placed.groupBy("store", "dim", "list").agg(F.count("*").alias("n"))
    cells = stage(sizes.mapInArrow(heard, "store string, dim int, list int, n bigint, homes array<int>"))
    searched = cells.select("store", F.explode("homes").alias("home"), "n").groupBy("store", "home").agg(F.ceil(F.sum("n") / config.code_block).cast("int").alias("blocks"))
    grid = cells.select("store", F.col("list").alias("home"), F.ceil(F.col("n") / config.query_block).cast("int").alias("parts")).join(searched, ["store", "home"])
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    some_of = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    queries = placed.select("store", F.col("list").alias("home"), "id", "vector", "dim").join(grid, ["store", "home"])
    queries = queries.select("store", "home", some_of("parts").alias("p"), upto("blocks").alias("b"), "id", "vector", "dim")
    spread = cells.select("store", "list", F.explode("homes").alias("home")).join(grid, ["store", "home"])
    codes = placed.select("store", "list", "id", "code").join(spread, ["store", "list"])
    codes = codes.select("store", "home", "list", "id", "code", some_of("blocks").alias("b"), upto("parts").alias("p"))
    key = ["store", "home", "p", "b"]
    codes = codes.select(F.col("store").alias("e_store"), F.col("home").alias("e_home"), F.col("p").alias("e_p"), F.col("b").alias("e_b"), "list", F.col("id").alias("near"), "code")
    short_schema = pa.schema([("store", pa.string()), ("home", pa.int32()), ("p", pa.int32()), ("id", pa.int64()), ("nears", pa.list_(pa.int64()))])

    def search(asked: pa.Table, entries: pa.Table) -> pa.Table:
        if not asked.num_rows or not entries.num_rows:
            return short_schema.empty_table()
        dim = asked.column("dim")[0].as_py()
        q = quantisers.value[dim]
        y = _unit(_matrix(asked.column("vector"), dim)).astype(np.float32)
        lists, ids = entries.column("list").to_numpy(), entries.column("near").to_numpy()
        code = np.frombuffer(b"".join(entries.column("code").to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
        own = asked.column("id").to_numpy()
        n = min(q.shortlist + 1, len(ids))
        found_ids, found = [], []
        step = max(16, 4_000_000 // len(ids))
        for a in range(0, len(y), step):
            score = q.scores(y[a : a + step], lists, code)
            score[score < config.min_cosine - q.margin] = -np.inf
            short = np.argpartition(-score, n - 1, axis=1)[:, :n] if n < len(ids) else np.tile(np.arange(len(ids)), (len(score), 1))
            near = ids[short]
            good = np.isfinite(np.take_along_axis(score, short, 1)) & (near != own[a : a + step, None])
            for i in np.flatnonzero(good.any(1)):
                found_ids.append(own[a + i])
                found.append(near[i][good[i]])
        first = {c: asked.column(c)[0].as_py() for c in ("store", "home", "p")}
        return pa.table({**{c: [v] * len(found) for c, v in first.items()}, "id": found_ids, "nears": found}, schema=short_schema)

    shorts = stage(queries.groupBy(*key).cogroup(codes.groupBy("e_store", "e_home", "e_p", "e_b")).applyInArrow(search, "store string, home int, p int, id bigint, nears array<bigint>"))

    # the exact cosine: the vectors that a part of a list needs, each once
    wanted = shorts.select("store", "home", "p", F.explode(F.concat("nears", F.array("id"))).alias("id")).distinct()
    fetched = wanted.join(placed.select("store", "id", "vector", "dim"), ["store", "id"])
    fetched = fetched.select(F.col("store").alias("v_store"), F.col("home").alias("v_home"), F.col("p").alias("v_p"), "id", "vector", "dim")
    hit_schema = pa.schema([("store", pa.string()), ("rep", pa.int64()), ("near", pa.int64()), ("cosine", pa.float64())])

    def rank(shorts: pa.Table, fetched: pa.Table) -> pa.Table:
        if not shorts.num_rows or not fetched.num_rows:
            return hit_schema.empty_table()
        ids = fetched.column("id").to_numpy()
        order = np.argsort(ids)
        x = _unit(_matrix(fetched.column("vector"), fetched.column("dim")[0].as_py()))[order]
        ids = ids[order]
        lists: dict[int, list] = {}
        for i, nears in zip(shorts.column("id").to_pylist(), shorts.column("nears").to_pylist()):
            lists.setdefault(i, []).extend(nears)
        rows = []
        for i, nears in lists.items():
            near = np.array(nears)
            cosine = x[np.searchsorted(ids, near)] @ x[np.searchsorted(ids, i)]
            best = [j for j in np.lexsort((near, -cosine))[: config.k] if cosine[j] >= config.min_cosine]
            rows += [(i, int(near[j]), float(cosine[j])) for j in best]
        found = list(zip(*rows)) or [(), (), ()]
        return pa.table({"store": [shorts.column("store")[0].as_py()] * len(rows), "rep": found[0], "near": found[1], "cosine": found[2]}, schema=hit_schema)

    hits = shorts.groupBy("store", "home", "p").cogroup(fetched.groupBy("v_store", "v_home", "v_p")).applyInArrow(rank, "store string, rep bigint, near bigint, cosine double")

    # put the copies back: a vector's own group comes first, then the groups of its neighbours
    near = hits.join(groups.select("store", F.col("rep").alias("near"), "ids"), ["store", "near"], "left")
    near = near.select("store", "rep", F.explode(F.coalesce("ids", F.array("near"))).alias("neighbour"), "cosine")
    own = groups.where(F.lit(config.min_cosine) <= 1.0).select("store", "rep", F.explode("ids").alias("neighbour"), F.lit(1.0).alias("cosine"))
    first = Window.partitionBy("store", "rep").orderBy(F.desc("cosine"), "neighbour")
    listed = near.unionByName(own).withColumn("n", F.row_number().over(first)).where(F.col("n") <= keep)
    lists = listed.groupBy("store", "rep").agg(F.array_sort(F.collect_list(F.struct("n", "neighbour", "cosine"))).alias("list"))
    # the members of a copy group read their group's list in parts
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    theirs = lists.join(groups.select("store", "rep"), ["store", "rep"], "left_semi").select("store", "rep", "list", salts)
    alone = lists.join(groups.select("store", "rep"), ["store", "rep"], "left_anti").select("store", F.col("rep").alias("id"), "list")
    each = alone.unionByName(salted.select("store", "id", "rep", F.col("salt").cast("long").alias("salt")).join(theirs, ["store", "rep", "salt"]).select("store", "id", "list"))
    each = each.select("store", "id", F.slice(F.filter("list", lambda x: x["neighbour"] != F.col("id")), 1, config.k).alias("list"))
    return each.select("store", "id", F.posexplode("list").alias("place", "x")).select("store", "id", F.col("x.neighbour").alias("neighbour"), F.col("x.cosine").alias("cosine"), (F.col("place") + 1).alias("place"))


def similar_pairs(near: DataFrame, min_cosine: float = 0.9) -> DataFrame:
    """(chunk_a, chunk_b), chunk_a < chunk_b: pairs of which one is among the neighbours of the other."""
    pairs = near.where((F.col("cosine") >= min_cosine) & (F.col("id") != F.col("neighbour")))
    return pairs.select(F.least("id", "neighbour").alias("chunk_a"), F.greatest("id", "neighbour").alias("chunk_b")).distinct()
