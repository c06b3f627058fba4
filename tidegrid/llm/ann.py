"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing and exact reranking.

Vectors are indexed apart by ranges of their length, each twice as long as the next. In a range they get one more
component, so that all have the range's largest norm and the largest inner product is the smallest Euclidean distance; so
a few long vectors don't crowd all others into a few buckets. In each table a vector's bucket is made of
floor((a . x + b) / width) for Gaussian a. A query visits its own bucket and then perturbed ones in the order of their
estimated success: the sum of squared distances to the boundaries crossed, by the expected order of those distances. The
candidates of all tables are merged and ranked by their exact inner products.

How many hashes, how wide and how many probes is measured: a bounded sample of queries gets its true neighbours from all
vectors, and of a grid of settings that one is taken which finds enough of them while it visits the least. So clustered
vectors, whose neighbours are close, and larger tables, where they are closer, cost a smaller share of all pairs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm.common import partitions, stored

#: Rows of one task's group; larger buckets are dealt into tiles of both sides, and all pairs of tiles are visited.
TILE_VECTORS, TILE_QUERIES = 8192, 2048
#: Queries and vectors that the settings are fitted on, and bytes of them at most; the share of true neighbours to find.
FIT_QUERIES, FIT_VECTORS, FIT_BYTES, FIT_RECALL = 128, 8192, 16 << 20, 0.95
#: Tables, hashes in each, bucket width (over the norm) and probes in each table, to be chosen from.
GRID = (
    (4, 16, 1.0, 60), (4, 12, 1.0, 60), (3, 10, 1.2, 100), (4, 8, 1.0, 60), (3, 8, 1.5, 100), (2, 8, 1.5, 250), (2, 8, 2.0, 400), (2, 6, 2.0, 100),
    (2, 6, 2.0, 150), (1, 4, 2.5, 30), (1, 4, 2.5, 45), (1, 4, 3.0, 40), (1, 6, 2.5, 140), (1, 6, 2.5, 220), (1, 6, 2.5, 320), (2, 6, 2.0, 250), (2, 4, 2.0, 30), (3, 6, 1.8, 250), (8, 4, 1.5, 14),
)
#: Ranges of length, each half as long as the one before; the last has all shorter ones.
RANGES = 24


def usable(vector: Column) -> Column:
    """Neither null nor zero, and without null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def probe_sets(hashes: int, probes: int) -> list[list[int]]:
    """Sets of boundaries to cross, by their expected cost; boundary k is the query's k-th nearest of 2 hashes."""
    m, n = hashes, 2 * hashes
    cost = [0.0] + [j * (j + 1) / (4 * (m + 1) * (m + 2)) if j <= m else 1 - (n + 1 - j) / (m + 1) + (n + 1 - j) * (n + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(1, n + 1)]
    queue, out = [(cost[1], (1,))], []
    while queue and len(out) < probes:
        total, chosen = heapq.heappop(queue)
        if not any(n + 1 - j in chosen for j in chosen):
            out.append([j - 1 for j in chosen])
        last = chosen[-1]
        if last < n:
            heapq.heappush(queue, (total - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(queue, (total + cost[last + 1], (*chosen, last + 1)))
    return out


class Tables:
    """The hash functions; the same for the same arguments, wherever they are made."""

    def __init__(self, dim: int, tables: int, hashes: int, width: float, norm: float, probes: int, seed: int) -> None:
        rng = np.random.default_rng([seed, dim])
        self.norm, self.width = norm, width * norm
        self.a, self.b = rng.normal(size=(tables, dim + 1, hashes)), rng.uniform(0, self.width, (tables, 1, hashes))
        self.mix = rng.integers(1, 1 << 62, (tables, hashes)) * 2 + 1
        self.salt, self.sets = rng.integers(0, 1 << 62, tables), probe_sets(hashes, probes)

    def _places(self, x: np.ndarray, fill: np.ndarray) -> np.ndarray:
        return (np.column_stack([x, fill]) @ self.a + self.b) / self.width

    def _key(self, table: int, cells: np.ndarray) -> np.ndarray:
        return (cells.astype(np.int64) * self.mix[table]).sum(axis=-1) ^ self.salt[table]

    def index(self, x: np.ndarray) -> np.ndarray:
        """[rows, tables]: the bucket of each vector in each table."""
        rest = np.sqrt(np.maximum(self.norm**2 - (x**2).sum(axis=1), 0))
        cells = np.floor(self._places(x, rest))
        return np.column_stack([self._key(t, c) for t, c in enumerate(cells)])

    def probe(self, x: np.ndarray) -> np.ndarray:
        """[rows, tables * (1 + probes)]: the buckets that each query visits."""
        out = []
        x = x * (self.norm / np.sqrt((x**2).sum(axis=1)))[:, None]  # a query's length changes no ranking
        for t, place in enumerate(self._places(x, np.zeros(len(x)))):
            cell = np.floor(place)
            down = place - cell
            order = np.argsort(np.column_stack([down, 1 - down]), axis=1)
            m = cell.shape[1]
            out.append(self._key(t, cell))
            for chosen in self.sets:
                moved = cell.copy()
                for k in chosen:
                    at = order[:, k]
                    moved[np.arange(len(x)), at % m] += np.where(at < m, -1, 1)
                out.append(self._key(t, moved))
        return np.column_stack(out)


def _matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as one matrix) for each length of vector."""
    sizes = column.value_lengths().to_numpy()
    out = []
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        out.append((rows, np.asarray(column.take(pa.array(rows)).flatten(), dtype=float).reshape(len(rows), size)))
    return out


def _dealt(norms: dict[int, float], settings: dict, asking: bool):
    """(rep, e, range) or, asking, (rep, e) -> (bucket, rep): where each vector lies, or which buckets each query asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[tuple[int, int], Tables] = {}

        def tables(dim: int, part: int) -> Tables:
            if (dim, part) not in made:
                made[dim, part] = Tables(dim, norm=norms[part], **settings | {"seed": settings["seed"] + 1000 * part})
            return made[dim, part]

        for batch in batches:
            for rows, x in _matrix(batch.column(1)):
                own = np.zeros(len(rows), int) if asking else batch.column(2).to_numpy()[rows]
                for part in norms if asking else np.unique(own).tolist():
                    at = np.arange(len(rows)) if asking else np.flatnonzero(own == part)
                    for low in range(0, len(at), 1024):
                        some = at[low : low + 1024]
                        keys = tables(x.shape[1], part).probe(x[some]) if asking else tables(x.shape[1], part).index(x[some])
                        reps = batch.column(0).take(pa.array(np.repeat(rows[some], keys.shape[1])))
                        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), reps], names=["bucket", "rep"])

    return run


def _best(scores: np.ndarray, reps: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The columns of each row with the highest scores, ties to the smaller rep: [rows, keep] scores and reps."""
    if scores.shape[1] > 4 * keep:  # all that tie with the last kept stay in
        floor = np.partition(scores, -keep, axis=1)[:, -keep]
        width = int((scores >= floor[:, None]).sum(axis=1).max())
        some = np.argpartition(-scores, min(width, scores.shape[1]) - 1, axis=1)[:, :width]
        scores, reps = np.take_along_axis(scores, some, 1), np.take_along_axis(reps, some, 1)
    order = np.lexsort((reps, -scores), axis=-1)[:, :keep]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(reps, order, 1)


class _Asked:
    """Queries of one length, and the best of the vectors seen so far for each."""

    def __init__(self, reps: np.ndarray, x: np.ndarray, keep: int) -> None:
        self.reps, self.x, self.keep = reps, x, keep
        self.scores, self.found = np.full((len(x), 1), -np.inf), np.full((len(x), 1), -1)

    def show(self, reps: np.ndarray, x: np.ndarray) -> None:
        for low in range(0, len(x), 1024):
            part, ids = x[low : low + 1024].astype(float), reps[low : low + 1024]
            rough = self.x @ part.T
            top = min(self.keep, len(part))
            # the product's rounding may differ from that of the score, so what is near the last kept is scored exactly
            floor = np.partition(rough, -top, axis=1)[:, -top] - 1e-9 * np.maximum(1.0, np.abs(rough).max(axis=1))
            width = int((rough >= floor[:, None]).sum(axis=1).max())
            some = np.argpartition(-rough, width - 1, axis=1)[:, :width]
            exact = np.stack([(part[some[:, k]] * self.x).sum(axis=1) for k in range(width)], axis=1)
            self.scores, self.found = _best(np.hstack([self.scores, exact]), np.hstack([self.found, ids[some]]), self.keep)

    def rows(self) -> pa.RecordBatch:
        row, at = np.nonzero(self.found >= 0)
        return pa.RecordBatch.from_arrays([pa.array(self.reps[row]), pa.array(self.found[row, at]), pa.array(self.scores[row, at])], names=["asker", "rep", "score"])


def _search(keep: int):
    """Rows (g, kind, rep, e) sorted by g and kind, queries (0) before vectors (1), of one length in a g -> (asker, rep, score)."""

    def run(batches):
        asked, held, at, kind_of = None, [], None, None

        def queries() -> _Asked:
            return _Asked(np.concatenate([r for r, _ in held]), np.concatenate([x for _, x in held]).astype(float), keep)

        for batch in batches:
            g, kind, rep = (batch.column(k).to_numpy() for k in range(3))
            cuts = np.flatnonzero((np.diff(g) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(g)], strict=True):
                if b == a:
                    continue
                if g[a] != at:
                    if asked is not None:
                        yield asked.rows()
                    asked, held, at = None, [], g[a]
                part = batch.column(3).slice(a, b - a)
                x = np.asarray(part.flatten()).reshape(b - a, -1)
                if kind[a] == 0:
                    held.append((rep[a:b], x))
                elif held:
                    asked = asked or queries()
                    asked.show(rep[a:b], x)
        if asked is not None:
            yield asked.rows()

    return run


def _exact_neighbours(groups: DataFrame, reps: np.ndarray, x: np.ndarray, keep: int) -> DataFrame:
    """(asker, rep, score): the true neighbours of a few queries of one length among all of groups, their own rows aside."""

    def run(batches):
        asked = _Asked(reps, x, keep + 1)
        for batch in batches:
            for rows, y in _matrix(batch.column(1)):
                if y.shape[1] == x.shape[1]:
                    asked.show(batch.column(0).to_numpy()[rows], y)
        yield asked.rows()

    found = groups.select("rep", "e").mapInArrow(run, "asker long, rep long, score double").filter("asker <> rep")
    return found.withColumn("r", F.row_number().over(Window.partitionBy("asker").orderBy(F.desc("score"), "rep"))).filter(F.col("r") <= keep)


def fitted(groups: DataFrame, asking: DataFrame, k: int, grid=GRID, recall: float = FIT_RECALL, seed: int = 11) -> dict:
    """Of the grid the setting that visits the least among those that find enough; measured on bounded samples.

    The samples are the first by hash: FIT_QUERIES of the rows that ask, whose k true neighbours are found among all
    vectors, and FIT_VECTORS of the vectors, for the share of them that a query visits and the inner products it takes.
    All are of the commonest length. Where no setting finds enough, the one that finds the most is taken.
    """
    size = asking.groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if size is None:
        return {"tables": grid[-1][0], "hashes": grid[-1][1], "width": grid[-1][2], "probes": grid[-1][3], "recall": None, "share": None}
    d = size.d
    matrix = lambda rows: np.array([r.e for r in rows], float).reshape(len(rows), d)
    first = lambda df, n: df.filter(F.size("e") == d).orderBy(F.xxhash64(F.lit(seed), "rep"), "rep").limit(max(2, min(n, FIT_BYTES // (8 * d))))
    asked = first(asking, FIT_QUERIES).select("rep", "e").collect()
    some = matrix(first(groups, FIT_VECTORS).select("e").collect())
    q = matrix(asked)
    near = stored(_exact_neighbours(groups, np.array([r.rep for r in asked]), q, k))
    rows = near.join(groups.select("rep", "e"), "rep").select("asker", "e").collect()  # k for each sampled query
    x, owner = matrix(rows), np.searchsorted(sorted(r.rep for r in asked), [r.asker for r in rows])
    q = q[np.argsort([r.rep for r in asked])]
    norm = max(float(np.sqrt((v**2).sum(axis=1)).max(initial=0)) for v in (some, x)) or 1.0
    best = None
    for tables, hashes, width, probes in grid:
        made = Tables(d, tables, hashes, width, norm, probes, seed)
        visits, there, others = made.probe(q).reshape(len(q), tables, -1), made.index(x), made.index(some)
        hit = np.array([any(there[k, t] in visits[o, t] for t in range(tables)) for k, o in enumerate(owner)])
        met = np.stack([np.isin(others[:, t], visits[o, t]) for o in range(len(q)) for t in range(tables)]).reshape(len(q), tables, -1)
        one = {"tables": tables, "hashes": hashes, "width": width, "probes": probes, "recall": float(hit.mean()) if len(hit) else 1.0, "share": float(met.any(axis=1).mean()), "products": float(met.sum(axis=1).mean())}
        rank = (one["recall"] < recall, one["products"] if one["recall"] >= recall else -one["recall"])
        if best is None or rank < best[0]:
            best = (rank, one)
    return best[1]


def nearest(
    vectors: DataFrame, asks: Column, k: int = 20, settings: dict | None = None, seed: int = 11, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank from 1, id, score): the k nearest found of each row that asks, among all other rows.

    Nearness is the inner product in double precision of the vectors as they are (components of other types than float
    as doubles); ties go to the smaller id. Vectors that are null, zero, or hold null or non-finite components take no
    part; vectors of different lengths are no candidates for each other. Equal vectors are searched once: of each such
    group only the k + 1 smallest ids can be among anyone's k nearest. Null ids take no part; rows that repeat an id and
    its vector are one. Other columns take no part; an empty table gives no rows. settings (tables, hashes, width,
    probes) are those of fitted() if not given. A query whose buckets hold fewer than k others is compared with all.
    """
    element = vectors.schema[vector_col].dataType.elementType
    whole = "array<float>" if isinstance(element, T.FloatType) else "array<double>"
    rows = vectors.filter(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(whole).alias("e"), F.coalesce(asks, F.lit(False)).alias("asks")).distinct()
    firsts = rows.withColumn("r", F.row_number().over(Window.partitionBy("e").orderBy("id"))).filter(F.col("r") <= k + 1)
    length = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    groups = stored(firsts.groupBy("e").agg(F.min("id").alias("rep"), F.sort_array(F.collect_list("id")).alias("ids")).withColumn("norm", length))
    askers = stored(rows.filter("asks").join(groups.select(F.col("e").alias("e1"), "rep"), F.col("e") == F.col("e1")).select(F.col("id").alias("query_id"), "rep"))
    asking = askers.select(F.col("rep").alias("rep1")).distinct()
    asking = stored(groups.join(asking, F.col("rep") == F.col("rep1"), "left_semi").select("rep", "e"))
    largest = groups.agg(F.max("norm")).first()[0] or 1.0
    ranged = groups.withColumn("range", F.least(F.floor(F.log2(F.lit(largest) / F.col("norm")) + F.lit(1e-12)), F.lit(RANGES - 1)).cast("int"))
    norms = {r.range: r.norm for r in ranged.groupBy("range").agg(F.max("norm").alias("norm")).collect()}  # RANGES rows at most
    chosen = {c: v for c, v in (settings or fitted(groups, asking, k, seed=seed)).items() if c in ("tables", "hashes", "width", "probes")}
    found = stored(_candidates(ranged, asking, norms, chosen | {"seed": seed}, k + 1).distinct())
    sizes = groups.groupBy(F.size("e").alias("d")).agg(F.count(F.lit(1)).alias("all"))
    have = found.groupBy("asker").agg(F.count(F.lit(1)).alias("have"))
    short = asking.withColumn("d", F.size("e")).join(sizes, "d").join(have, F.col("rep") == F.col("asker"), "left")
    short = stored(short.filter(F.coalesce("have", F.lit(0)) < F.least(F.col("all"), F.lit(k + 1))).select("rep", "e"))
    if short.count():
        found = found.union(_visited(short.withColumn("bucket", F.lit(0).cast("long")), groups.withColumn("bucket", F.lit(0).cast("long")).select("rep", "e", "bucket"), k + 1)).distinct()
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("asker").orderBy(F.desc("score"), "rep"))).filter(F.col("r") <= k + 1)
    ids = best.join(groups.select("rep", "ids"), "rep").select("asker", "score", F.explode("ids").alias("id"))
    wide = ids.withColumn("r", F.row_number().over(Window.partitionBy("asker").orderBy(F.desc("score"), "id"))).filter(F.col("r") <= k + 1)
    each = askers.join(wide, askers["rep"] == wide["asker"]).filter("id <> query_id")
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def _candidates(ranged: DataFrame, asking: DataFrame, norms: dict[int, float], settings: dict, keep: int) -> DataFrame:
    """(asker, rep, score): the best of each visited bucket (or tile of it) for each asker."""
    lie = ranged.select("rep", "e", "range").mapInArrow(_dealt(norms, settings, False), "bucket long, rep long")
    visit = asking.select("rep", "e").mapInArrow(_dealt(norms, settings, True), "bucket long, rep long").distinct()
    e = ranged.select("rep", "e")
    return _visited(visit, lie, keep, e)


def _visited(visit: DataFrame, lie: DataFrame, keep: int, e: DataFrame | None = None) -> DataFrame:
    """(asker, rep, score) of the queries and the vectors that share a bucket; both have bucket and rep, and e unless given."""
    sizes = lie.select("bucket").withColumn("v", F.lit(1)).withColumn("q", F.lit(0)).union(visit.select("bucket").withColumn("v", F.lit(0)).withColumn("q", F.lit(1)))
    tiles = sizes.groupBy("bucket").agg(F.sum("v").alias("v"), F.sum("q").alias("q")).filter("v > 0 and q > 0")
    tiles = tiles.select("bucket", F.ceil(F.col("v") / TILE_VECTORS).alias("tv"), F.ceil(F.col("q") / TILE_QUERIES).alias("tq"))
    own_e = [] if e is not None else ["e"]

    def dealt(side: DataFrame, kind: int) -> DataFrame:
        own, other = ("tq", "tv") if kind == 0 else ("tv", "tq")
        mine = F.pmod(F.xxhash64(F.lit(3), "rep"), F.col(own))
        placed = side.join(tiles, "bucket").select("bucket", "rep", *own_e, mine.alias("mine"), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias("theirs"))
        pair = ("mine", "theirs") if kind == 0 else ("theirs", "mine")
        return placed.select("bucket", F.col(pair[0]).alias("a"), F.col(pair[1]).alias("b"), F.lit(kind).alias("kind"), "rep", *own_e)

    both = dealt(visit, 0).union(dealt(lie, 1))
    both = both.join(e, "rep") if e is not None else both
    grouped = both.select(F.xxhash64("bucket", "a", "b", F.size("e")).alias("g"), "kind", "rep", "e")
    return grouped.repartition(partitions(lie), "g").sortWithinPartitions("g", "kind").mapInArrow(_search(keep), "asker long, rep long, score double")


def op4_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
