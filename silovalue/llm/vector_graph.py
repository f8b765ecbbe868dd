"""Near-duplicate vectors by a robust-pruned flat graph.

Vectors go to their nearest few cluster shards, so shards overlap. In each shard every vector gets a robust-pruned list of
neighbours: near ones, none of which is reached better through another. The lists of a vector are united over its shards.
The search starts from a shard's medoid and from the vector's own node, walks greedily, and widens over every node within
the wanted range. What it finds is verified by cosine in double precision; an audit measures recall against brute force.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from silovalue.functions.lineage import cut_lineage
from silovalue.llm import common

LEAST = 0.95
SAMPLE = 20_000  # rows, at most, on which cluster centres are fitted
SHARD = 1_000  # wished vectors per shard before overlap
OVERLAP = 2
LARGEST = 6_000  # vectors of one search task; larger shards are cut into pairs of blocks
POOL, DEGREE, ALPHA = 40, 16, 1.2
BEAM, SLACK = 12, 0.06
UNSEEN = -2.0


def matrix(vectors: pa.Array | list[bytes]) -> np.ndarray:
    """Rows of doubles from binary vectors of one length."""
    parts = vectors.to_pylist() if isinstance(vectors, pa.Array) else list(vectors)
    return np.frombuffer(b"".join(parts), dtype=np.float64).reshape(len(parts), -1) if parts else np.zeros((0, 1))


def unit(values: list | np.ndarray | None) -> np.ndarray | None:
    """The unit vector in double; None if null, empty, zero or with null or non-finite components."""
    if values is None or not len(values):
        return None
    x = np.array(values, dtype=np.float64)  # a null component becomes nan
    top = np.abs(x).max()
    if not np.isfinite(x).all() or top == 0:
        return None
    x = x / top  # scaled first, so that squares stay in range
    return x / np.sqrt(x @ x)


def unit_rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, size, h1, h2, v) of the rows that can link: length, 128-bit hash and bytes of the unit vector in double."""

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a in range(0, batch.num_rows, 2048):
            part = batch.slice(a, 2048)
            rows = [(i, unit(x)) for i, x in zip(part.column("vec_id").to_pylist(), part.column("embedding").to_numpy(zero_copy_only=False))]
            rows = [(i, len(x), x.tobytes()) for i, x in rows if i is not None and x is not None]
            halves = [divmod(xxhash.xxh3_128_intdigest(v), 1 << 64) for _, _, v in rows]
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([h - (1 << 63) for h, _ in halves], pa.int64()),
                pa.array([h - (1 << 63) for _, h in halves], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["vec_id", "size", "h1", "h2", "v"])

    rows = vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>"))
    return common.map_batches(rows, one, "vec_id bigint, size bigint, h1 bigint, h2 bigint, v binary")


def centres(units: DataFrame, rows: int, shard: int = SHARD, sample: int = SAMPLE, seed: int = 5) -> np.ndarray:
    """Spherical k-means on at most about ``sample`` rows chosen by a hash of their id."""
    k = int(max(1, min(-(-rows // shard), sample // 8)))
    share = min(1.0, sample / max(1, rows))
    chosen = units.where(F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").limit(2 * sample)
    x = matrix([r.v for r in chosen.collect()] or [r.v for r in units.select("v").limit(1).collect()])
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]]
    for _ in range(8):
        near = np.concatenate([np.argmax(x[a : a + 4096] @ c.T, axis=1) for a in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norms > 0, sums / np.maximum(norms, 1e-12), c)
    return c


def assigned(units: DataFrame, c: np.ndarray, overlap: int = OVERLAP) -> DataFrame:
    """(shard, vec_id, v, home): each vector in its nearest shards; the first is its home."""
    shared = units.sparkSession.sparkContext.broadcast(c)

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a in range(0, batch.num_rows, 4096):
            part = batch.slice(a, 4096)
            order = np.argsort(-(matrix(part.column("v")) @ shared.value.T), axis=1)[:, :overlap]
            n, m = order.shape
            rows = pa.array(np.repeat(np.arange(n), m))
            yield pa.RecordBatch.from_arrays([
                pa.array(order.ravel().astype(np.int64)), part.column("vec_id").take(rows), part.column("v").take(rows),
                pa.array(np.tile(np.arange(m) == 0, n))], ["shard", "vec_id", "v", "home"])

    return common.map_batches(units.select("vec_id", "v"), one, "shard bigint, vec_id bigint, v binary, home boolean")


def spread(members: DataFrame, largest: int = LARGEST) -> DataFrame:
    """Shards above ``largest`` become one task for each two of their blocks, so no task holds more and all still meet."""
    sizes = cut_lineage(members.groupBy("shard").agg(F.count(F.lit(1)).alias("rows")))
    blocks = F.when(F.col("rows") <= largest, 1).otherwise(F.ceil(2 * F.col("rows") / largest)).cast("bigint")
    cut = members.join(sizes, "shard").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
    wide = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    wide = wide.where((F.col("blocks") == 1) | (F.col("own") != F.col("other")))
    return wide.withColumn("task", F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other"))).drop("blocks", "own", "other", "rows")


def robust_prune(x: np.ndarray, pool: int = POOL, degree: int = DEGREE, alpha: float = ALPHA) -> list[np.ndarray]:
    """For each row its neighbours: the nearest first, leaving out those alpha times nearer to one taken already."""
    n = len(x)
    lists = []
    take = min(pool, n - 1)
    if take <= 0:
        return [np.zeros(0, dtype=np.int64) for _ in range(n)]
    for a in range(0, n, 1024):
        near = x[a : a + 1024] @ x.T
        near[np.arange(len(near)), np.arange(a, a + len(near))] = -np.inf
        best = np.argpartition(-near, take - 1, axis=1)[:, :take]
        for i in range(len(near)):
            candidates = best[i][np.argsort(-near[i, best[i]], kind="stable")]
            away = 1.0 - near[i, candidates]
            between = 1.0 - x[candidates] @ x[candidates].T
            left, kept = np.ones(take, dtype=bool), []
            for j in range(take):
                if left[j]:
                    kept.append(candidates[j])
                    if len(kept) == degree:
                        break
                    left &= alpha * between[j] > away
            lists.append(np.array(kept, dtype=np.int64))
    return lists


def edges(members: DataFrame) -> DataFrame:
    """(u, v) of every shard's pruned lists, and back, so that both ends know them."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id", kind="stable")
        ids, x = frame.vec_id.to_numpy(), matrix(frame.v)
        lists = robust_prune(x)
        u = np.repeat(ids, [len(p) for p in lists])
        v = ids[np.concatenate(lists)] if len(u) else u
        return pd.DataFrame({"u": np.concatenate([u, v]), "v": np.concatenate([v, u])})

    return members.select("task", "vec_id", "v").groupBy("task").applyInPandas(build, "u bigint, v bigint").where("u <> v")


def search(members: DataFrame, united: DataFrame, least: float = LEAST) -> DataFrame:
    """(a, b) with cosine >= least, a < b, found from each vector in its home shard on the united lists."""
    joined = members.join(united, members["vec_id"] == united["u"], "left").drop("u")

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id", kind="stable")
        ids, x = frame.vec_id.to_numpy(), matrix(frame.v)
        lists = []
        for out in frame["out"]:
            known = np.array(out if out is not None else (), dtype=np.int64)
            at = np.minimum(np.searchsorted(ids, known), len(ids) - 1)
            lists.append(at[ids[at] == known])
        medoid = int(np.argmax(x @ x.mean(axis=0)))
        score, opened = np.full(len(ids), UNSEEN), np.zeros(len(ids), dtype=bool)
        left, right = [], []
        for i in np.flatnonzero(frame.home.to_numpy()):
            todo = np.unique([medoid, i])
            seen = np.zeros(0, dtype=np.int64)
            while True:
                score[todo] = x[todo] @ x[i]
                seen = np.concatenate([seen, todo])
                now = score[seen]
                best = seen if len(seen) <= BEAM else seen[np.argpartition(-now, BEAM - 1)[:BEAM]]
                # The beam's best and every node within the widened range are opened in turn.
                wide = best[~opened[best]]
                if not len(wide):
                    wide = seen[(now >= least - SLACK) & ~opened[seen]]
                    if not len(wide):
                        break
                opened[wide] = True
                found = np.unique(np.concatenate([lists[n] for n in wide]))
                todo = found[score[found] == UNSEEN]
            hits = seen[(now >= least) & (seen != i)]
            left.append(np.full(len(hits), ids[i]))
            right.append(ids[hits])
            score[seen], opened[seen] = UNSEEN, False
        a, b = (np.concatenate(p) if p else np.zeros(0, dtype=np.int64) for p in (left, right))
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    return joined.select("task", "vec_id", "v", "home", "out").groupBy("task").applyInPandas(walk, "a bigint, b bigint")


def near_links(vectors: DataFrame, least: float = LEAST, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(links between representatives, classes): links (a, b), classes (vec_id, rep, copies) of equal unit vectors."""
    units = common.stored(unit_rows(vectors), "graph-units")
    if units.groupBy("vec_id").count().where("count > 1").take(1):
        first = Window.partitionBy("vec_id").orderBy("size", "h1", "h2")
        units = common.stored(units.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n"), "graph-distinct")
    sizes = units.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    sizes = common.stored(sizes, "graph-classes")  # a plain side, so that a vector with very many copies can be split
    classes = common.stored(units.select("vec_id", "h1", "h2").join(sizes, ["h1", "h2"]).select("vec_id", "rep", "copies"), "graph-copies")
    reps = common.stored(units.join(sizes.select(F.col("rep").alias("vec_id")), "vec_id", "left_semi").select("vec_id", "size", "v"), "graph-reps")
    links = vectors.sparkSession.createDataFrame([], "a bigint, b bigint")
    for r in reps.groupBy("size").count().orderBy("size").collect():  # vectors of each length have their own graph; mostly there is one
        own = reps.where(F.col("size") == r["size"])
        members = common.stored(spread(common.stored(assigned(own, centres(own, r["count"], shard)), "graph-shards")), "graph-tasks")
        united = edges(members).groupBy("u").agg(F.collect_set("v").alias("out"))  # DEGREE and the lists that name u
        links = links.unionByName(common.stored(search(members, united, least).distinct(), "graph-links"))
    return links, classes


def near_duplicates(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors that are null, zero, empty or have null or non-finite components link with nothing, nor do vectors of different
    lengths; so do rows without an id, whose component is null. Equal vectors are linked by class and take part in the graph
    once. Rows that share an id are one vector, the one of the smallest length and hash, and all get its result. An empty
    table gives no rows; other columns are not read.
    """
    links, classes = near_links(vectors, least)
    copies = classes.groupBy("rep").agg(F.max("copies").alias("copies"))
    both = links.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y")))
    others = both.join(copies, both["y"] == copies["rep"]).groupBy("x").agg(F.sum("copies").alias("far"))
    groups = common.components(links)
    found = classes.join(others, F.col("rep") == F.col("x"), "left").join(groups, F.col("rep") == F.col("node"), "left").select(
        F.col("vec_id").alias("_id"), (F.coalesce("far", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("g"))
    found = found.groupBy("_id").agg(F.max("n").alias("n"), F.min("g").alias("g"))
    rows = vectors.select(F.col("vec_id").cast("bigint"))
    return rows.join(found, F.col("vec_id") == F.col("_id"), "left").select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("g", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("g", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"))


def audit_recall(vectors: DataFrame, links: DataFrame, classes: DataFrame, every: int = 50, least: float = LEAST, block: int = 2048) -> tuple[int, int]:
    """(found, true) links of the queries, the rows whose id is divisible by ``every``, against all rows in blocks.

    One block of at most about ``block`` queries of one length at a time is sent to all tasks; only counts come back.
    """
    units = cut_lineage(unit_rows(vectors).select("vec_id", "size", "v"))
    asked = units.where(F.pmod("vec_id", F.lit(every)) == 0)
    known = found = 0
    for r in asked.groupBy("size").count().collect():
        parts = max(1, -(-r["count"] // block))
        for part in range(parts):
            queries = asked.where((F.col("size") == r["size"]) & (F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == part)).collect()
            if not queries:
                continue
            shared = vectors.sparkSession.sparkContext.broadcast((np.array([q.vec_id for q in queries]), matrix([q.v for q in queries])))

            def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
                ids, q = shared.value
                for a in range(0, batch.num_rows, 2048):
                    some = batch.slice(a, 2048)
                    i, j = np.nonzero(matrix(some.column("v")) @ q.T >= least)
                    yield pa.RecordBatch.from_arrays([some.column("vec_id").take(pa.array(i)), pa.array(ids[j])], ["x", "q"])

            true = common.map_batches(units.where(F.col("size") == r["size"]).select("vec_id", "v"), one, "x bigint, q bigint").where("x <> q")
            reps = classes.select("vec_id", "rep")
            named = true.join(reps.toDF("x", "rx"), "x").join(reps.toDF("q", "rq"), "q")
            got = links.select("a", "b", F.lit(1).alias("hit"))
            pair = named.withColumn("a", F.least("rx", "rq")).withColumn("b", F.greatest("rx", "rq")).join(got, ["a", "b"], "left")
            row = pair.agg(F.count(F.lit(1)), F.count(F.when((F.col("hit") == 1) | (F.col("rx") == F.col("rq")), 1))).first()
            known, found = known + row[0], found + row[1]
    return found, known
