"""The most similar vectors of every vector, by multi-index hashing.

Unit vectors are rotated by a rotation that is learned on a bounded sample so
that the signs lose little (iterative quantisation, without centring, as angles
count); the signs are a binary code, all of it cut into ``TABLES`` substrings, each with an index. Two
codes within a Hamming radius of ``TABLES * (PROBE + 1) - 1`` agree in at least
one substring but for ``PROBE`` bits, so probing all substrings at that
distance finds every such pair: 47 of 256 bits. Pairs up to ``RADIUS`` are
kept where a probe meets them, which for independent bits fails once in 10,000
at cosine 0.85. Probing is local: an index is partitioned by the leading bits
of its substring, and a point is sent to its own partition and to those up to
``PROBE`` leading bits away; partitions beyond a bound are compared block by
block. Candidates within the radius are scored on the floats. A search without
a score limit takes the index first; the points whose k-th neighbour lies
beyond its reach are widened to exact search, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarto.operators.retrieval import dense_search
from quarto.session import ensure_checkpoint_dir, spread
from quarto.sources.tables import read_table

TABLES, BITS, PROBE = 16, 16, 2  # 16 substrings of 16 bits, probed up to 2 bits away
WORDS = TABLES * BITS // 64  # 64-bit words of a code
RADIUS = 66  # of 256 bits; cosine 0.85 differs in 45 bits on average, with a deviation of 6.1
#: Score from which the index finds neighbours with a recall of 0.999 and more.
REACH = 0.85
#: Rows that the rotation is learned on.
SAMPLE_ROWS, ROUNDS = 4096, 25
#: Points of one partition of an index, or of two of its blocks, and pairs that are compared in one step.
PART_POINTS, STEP_PAIRS = 400_000, 2_000_000
#: Points of one block of the exact search, and rows of one product of blocks.
BLOCK_POINTS, BLOCK_ROWS = 25_000, 1024


def usable(df: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """(id, v): vectors of ``size`` finite numbers that are not all zero."""
    ok = (F.size("v") == size) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    return df.select(F.col(key).alias("id"), F.col(vector).alias("v")).where(F.col("id").isNotNull() & ok)


def _units(column: pa.Array, size: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), size)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


_SPREAD = [np.array([pow(m, i + 1, 1 << 64) for i in range(4096)], np.uint64) for m in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)]


def _class_key(x: np.ndarray) -> list[np.ndarray]:
    """Fingerprint of a unit vector to four digits, within which the cosine is 1 but for 1e-6; vectors of one direction, such as scaled copies, form a class."""
    digits = np.round(x * 1e4).astype(np.int64).view(np.uint64)
    out = []
    for w in _SPREAD:
        h = digits * w[np.arange(x.shape[1]) % len(w)]
        h ^= h >> np.uint64(31)
        h = (h * np.uint64(0xBF58476D1CE4E5B9)).sum(1)
        out.append((h ^ (h >> np.uint64(29))).view(np.int64))
    return out


def keyed(points: DataFrame, size: int) -> DataFrame:
    """(id, pid, v, vh, vg): the points with their class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, _class_key(_units(b.column(2), size)))], names=["id", "pid", "v", "vh", "vg"])

    return points.select("id", F.xxhash64("id").alias("pid"), "v").mapInArrow(run, f"id {points.schema['id'].dataType.simpleString()}, pid long, v {points.schema['v'].dataType.simpleString()}, vh long, vg long")


def learn_rotation(table: DataFrame, points: DataFrame, size: int, rows: int = SAMPLE_ROWS) -> np.ndarray:
    """The matrix of which ``sign(unit @ matrix)`` is the code. Learned on about ``rows`` points, taken by the hash of their id."""
    n = table.count()
    part = points.where(F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(max(1, n // rows))) == 0).select("v").limit(2 * rows).toArrow()
    x = part["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    rng = np.random.default_rng(5)
    width = TABLES * BITS

    def more(first: np.ndarray) -> np.ndarray:
        """The further words' bits are signs behind a random rotation of the learned one."""
        turns = [np.linalg.qr(rng.standard_normal((width, width)))[0] for _ in range(WORDS * 64 // width - 1)]
        return np.concatenate([first, *(first @ q for q in turns)], 1)

    if len(x) < width:
        return more(np.linalg.qr(rng.standard_normal((max(size, width), max(size, width))))[0][:size, :width])
    _, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, ::-1][:, :width]
    if axes.shape[1] < width:
        axes = np.concatenate([axes, np.linalg.qr(rng.standard_normal((width, width)))[0][:size, : width - axes.shape[1]]], 1)
    p = x @ axes
    r = np.linalg.qr(rng.standard_normal((width, width)))[0]
    for _ in range(ROUNDS):  # alternate the best signs for the rotation and the best rotation for the signs
        b = np.where(p @ r >= 0, 1.0, -1.0)
        u, _, vt = np.linalg.svd(b.T @ p)
        r = vt.T @ u.T
    return more(axes @ r)


def encode(points: DataFrame, matrix: np.ndarray) -> DataFrame:
    """(pid, vh, vg, c0, c1, ...): the code as 64-bit words, beside the vector's class."""
    shared = points.sparkSession.sparkContext.broadcast(matrix.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            x = _units(b.column(1), len(r))
            bits = np.packbits(x.astype(np.float32) @ r >= 0, axis=1).view(">u8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, _class_key(x)), *(pa.array(bits[:, i].copy()) for i in range(WORDS))], names=["pid", "vh", "vg", *CODE])

    return spread(points.select(F.xxhash64("id").alias("pid"), "v")).mapInArrow(run, "pid long, vh long, vg long, " + ", ".join(f"{c} long" for c in CODE))


CODE = [f"c{i}" for i in range(WORDS)]


def _masks(bits: int, most: int) -> list[int]:
    """Numbers of ``bits`` bits of which ``most`` at most are set, by how many."""
    return [sum(1 << i for i in c) for n in range(min(bits, most) + 1) for c in combinations(range(bits), n)]


def _probe(lead: int, radius: int):
    """Pairs of one partition of one index, or of two of its blocks: own points against points of own and neighbouring partitions."""
    low = np.array(_masks(BITS - lead, PROBE), np.int64)  # flips of the bits behind the leading ones
    weight = np.bitwise_count(low)

    def run(t: pa.Table) -> pa.Table:
        pid, sub, away, block = (t[n].to_numpy() for n in ("pid", "sub", "away", "block"))
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        codes = np.stack([t[c].to_numpy().view(np.uint64) for c in CODE], 1)
        found: list[np.ndarray] = []
        for one, other in {(i, j), (j, i)}:  # points of one block ask, own points of the other answer
            own = np.flatnonzero((away == 0) & (block == other))
            order = own[np.argsort(sub[own], kind="stable")]
            starts = np.zeros((1 << BITS) + 2, np.int64)  # of each bucket; the one past the last is empty
            starts[1 : (1 << BITS) + 1] = np.cumsum(np.bincount(sub[own], minlength=1 << BITS))
            starts[-1] = starts[-2]
            asks = np.flatnonzero(block == one)
            for at in range(0, len(asks), 16_384):
                q = asks[at : at + 16_384]
                # a point from a neighbouring partition was sent with leading bits flipped, which count
                wanted = np.where(weight[None, :] + away[q, None] <= PROBE, sub[q, None] ^ low[None, :], 1 << BITS)
                first, last = starts[wanted], starts[wanted + 1]
                found += _compare(q, first.ravel(), (last - first).ravel(), len(low), order, codes, pid, radius)
        pairs = np.unique(np.concatenate(found)) if found else np.empty(0, PAIR)
        return pa.table({"a": pa.array(np.ascontiguousarray(pairs["a"])), "b": pa.array(np.ascontiguousarray(pairs["b"]))})

    return run


PAIR = [("a", "i8"), ("b", "i8")]


def _compare(q: np.ndarray, first: np.ndarray, n: np.ndarray, width: int, order: np.ndarray, codes: np.ndarray, pid: np.ndarray, radius: int) -> Iterator[np.ndarray]:
    """Pairs within the radius of the asking points and the buckets their probes meet, STEP_PAIRS compared at a time."""
    full = np.flatnonzero(n)
    first, n, asks = first[full], n[full], q[full // width]
    ends = np.cumsum(n)
    start = 0
    sorted_codes, sorted_pid = codes[order], pid[order]
    while start < len(n):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + STEP_PAIRS, "right")))
        m, lag = n[start:stop], first[start:stop] - (ends[start:stop] - n[start:stop] - base)
        total = int(ends[stop - 1] - base)
        for lo in range(0, total, STEP_PAIRS):  # more than one step only for a full bucket
            hi = min(lo + STEP_PAIRS, total)
            if hi - lo == total:
                a, b = np.repeat(asks[start:stop], m), np.repeat(lag, m) + np.arange(total)
            else:
                a, b = np.full(hi - lo, asks[start]), np.arange(lo, hi) + lag[0]
            once = pid[a] < sorted_pid[b]  # the pair turned round is met from the other side
            a, b = a[once], b[once]
            near = np.bitwise_count(np.take(codes, a, 0) ^ np.take(sorted_codes, b, 0)).sum(1, dtype=np.uint16) <= radius
            pair = np.empty(int(near.sum()), PAIR)
            pair["a"], pair["b"] = pid[a[near]], sorted_pid[b[near]]
            yield np.unique(pair)
        start = stop


def candidate_pairs(codes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) of different points, a < b, that some index brings together within the radius.

    A partition of more than PART_POINTS points, such as one that a full bucket
    keeps together, is cut into blocks that are compared two by two.
    """
    n = codes.count()
    lead = 0
    while n >> lead > PART_POINTS and lead < BITS - 4:
        lead += 1
    per_word = 64 // BITS
    subs = F.array(*[F.shiftrightunsigned(F.col(f"c{t // per_word}"), 64 - BITS * (t % per_word + 1)).bitwiseAND((1 << BITS) - 1) for t in range(TABLES)])
    rows = codes.select("pid", *CODE, F.posexplode(subs).alias("tbl", "sub0"))
    flips = F.array(*[F.lit(m << (BITS - lead)).cast("long") for m in _masks(lead, PROBE)])
    rows = rows.withColumn("flip", F.explode(flips)).withColumn("sub", F.col("sub0").bitwiseXOR(F.col("flip")))
    rows = rows.select("pid", *CODE, "tbl", "sub", F.bit_count("flip").cast("int").alias("away"), F.shiftright("sub", BITS - lead).cast("int").alias("part"))
    if lead:
        full = rows.groupBy("tbl", "part").agg(F.count("*").alias("n")).where(F.col("n") > 2 * PART_POINTS)  # TABLES * 2^lead rows at most
        rows = rows.join(F.broadcast(full.select("tbl", "part", F.ceil(F.col("n") / PART_POINTS).cast("int").alias("blocks"))), ["tbl", "part"], "left")
        rows = rows.withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    else:
        rows = rows.withColumn("blocks", F.lit(1))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(5), "pid"), "blocks").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("pid", *CODE, "tbl", "sub", "away", "part", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
    rows = rows.repartition(max(TABLES << lead, 1), "tbl", "part", "i", "j")
    return rows.groupBy("tbl", "part", "i", "j").applyInArrow(_probe(lead, radius), "a long, b long").distinct()


def _nearest(k: int):
    """The k best of each point of one block among those of another; points of a block among its own."""

    def best(q: np.ndarray, other: np.ndarray, x: np.ndarray, pid: np.ndarray) -> tuple[np.ndarray, ...]:
        score = np.concatenate([np.einsum("ij,ij->i", x[q[i : i + 100_000]], x[other[i : i + 100_000]]) for i in range(0, len(q), 100_000)] or [np.empty(0)])
        order = np.lexsort((pid[other], -score, q))
        q, other, score = q[order], other[order], score[order]
        first = np.searchsorted(q, q, "left")
        keep = np.arange(len(q)) - first < k
        return pid[q[keep]], pid[other[keep]], score[keep]

    def run(t: pa.Table) -> pa.Table:
        pid, block, ask, i, j = t["pid"].to_numpy(), t["block"].to_numpy(), t["ask"].to_numpy(zero_copy_only=False), t["i"][0].as_py(), t["j"][0].as_py()
        x = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(pid), -1)
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y = x.astype(np.float32)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        turned = np.ascontiguousarray(y[right].T)
        found, back = [], []
        m = len(right)
        top = np.full((k, m), -2, np.float32)
        for at in range(0, len(left) if m else 0, BLOCK_ROWS):
            own = left[at : at + BLOCK_ROWS]
            s = y[own] @ turned
            if i == j:
                s[np.arange(len(own)), at + np.arange(len(own))] = -3
            # the k-th of the maxima of disjoint parts is a bound that the k best reach; 1e-5 is more than single precision errs by
            w = max(1, m // 256)
            parts = s[:, : m // w * w].reshape(len(own), m // w, w).max(2)
            bound = np.partition(parts, -k, axis=1)[:, -k] if parts.shape[1] >= k else np.full(len(own), -2, np.float32)
            a, b = np.nonzero((s >= np.maximum(bound, -2)[:, None] - 1e-5) & ask[own, None])
            found.append(best(own[a], right[b], x, pid))
            if i != j:
                w = max(1, len(own) // 64)
                parts = s[: len(own) // w * w].reshape(len(own) // w, w, m).max(1)
                top = np.partition(np.concatenate([top, parts]), -k, axis=0)[-k:]
                a, b = np.nonzero((s >= top.min(0)[None, :] - 1e-5) & ask[None, right])
                back.append((right[b], own[a]))
        if back:
            found.append(best(np.concatenate([q for q, _ in back]), np.concatenate([o for _, o in back]), x, pid))
        cols = [np.concatenate(c) for c in zip(*found)] if found else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table(dict(zip(("a", "b", "score"), map(pa.array, cols))))

    return run


def nearest(vectors: DataFrame, k: int) -> DataFrame:
    """(a, b, score): of every (pid, v, ask) that asks the k others of highest cosine, by exact search. Its work grows by the points that ask times all."""
    blocks = max(1, -(-vectors.count() // BLOCK_POINTS))
    rows = vectors.withColumn("block", F.pmod(F.xxhash64(F.lit(3), "pid"), F.lit(blocks)).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.select("pid", "v", "ask", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
    rows = rows.repartition(max(1, blocks * (blocks + 1) // 2), "i", "j")
    return rows.groupBy("i", "j").applyInArrow(_nearest(k), "a long, b long, score double")


def similar_vectors(df: DataFrame, key: str, vector: str, k: int = 10, min_score: float | None = 0.85, size: int = 128, radius: int = RADIUS) -> DataFrame:
    """(id, neighbour, score, rank): of every usable vector the k others of highest cosine, of ``min_score`` at least.

    With ``min_score=None`` all k come out however far away: a point with k
    neighbours within REACH has them by the index, the others by exact search.
    Null, all-zero, shorter or longer vectors and such with a number that is
    null or not finite have no neighbours. An id counts once, however often it
    occurs. Equal scores are ordered by id. Vectors of one direction form a
    class; one of them is searched, and only the k + 1 smallest ids of a class
    can be neighbours, so a class of any size costs in proportion to its rows.
    """
    ensure_checkpoint_dir(df.sparkSession)
    points = usable(df, key, vector, size)
    codes = encode(points, learn_rotation(df, points, size)).distinct()
    # codes of one class may differ in bits whose sign rounding decides
    classes = codes.groupBy("vh", "vg").agg(F.min(F.struct("pid", *CODE)).alias("head"), F.countDistinct("pid").alias("n")).select("vh", "vg", F.col("head.pid").alias("head"), *(F.col(f"head.{c}").alias(c) for c in CODE), "n").checkpoint()
    pairs = candidate_pairs(classes.select(F.col("head").alias("pid"), *CODE), radius).checkpoint()
    if min_score is None:
        wanted = classes.select("vh", "vg", "head", "n")
    else:
        wanted = pairs.select(F.col("a").alias("head")).unionAll(pairs.select(F.col("b").alias("head"))).distinct()
        wanted = classes.join(wanted, "head", "left_semi").unionByName(classes.where("n > 1")).select("vh", "vg", "head", "n").distinct()
    # rows of the classes that take part; of an id with different vectors the largest
    rows = keyed(points, size).join(wanted, ["vh", "vg"])
    rows = rows.groupBy("id").agg(F.max(F.struct("v", "head", "pid", "n")).alias("r")).select("id", "r.*").checkpoint()
    vectors = rows.where("pid = head").select("head", "v")
    left, right = vectors.select(F.col("head").alias("a"), F.col("v").alias("va")), vectors.select(F.col("head").alias("b"), F.col("v").alias("vb"))
    scored = pairs.join(left, "a").join(right, "b").select("a", "b", _cosine("va", "vb").alias("score")).where(F.col("score") >= (REACH if min_score is None else min_score))
    both = scored.unionAll(scored.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    if min_score is None:
        both = both.checkpoint()
        sure = both.groupBy("a").count().where(F.col("count") >= k + 1).select(F.col("a").alias("pid"), F.lit(False).alias("ask"))
        asks = vectors.withColumnRenamed("head", "pid").join(sure, "pid", "left").withColumn("ask", F.coalesce("ask", F.lit(True)))
        both = both.join(sure, F.col("a") == F.col("pid"), "left_semi").unionAll(nearest(asks, k + 1))
    both = both.unionAll(rows.where("n > 1").select(F.col("head").alias("a"), F.col("head").alias("b"), F.lit(1.0).alias("score")).distinct())
    best = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    both = both.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    # the smallest ids of each class, first per salted part of it
    few = rows.withColumn("salt", F.pmod("pid", F.lit(64)))
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("head", "salt").orderBy("id"))).where(F.col("r") <= k + 1)
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("head").orderBy("id"))).where(F.col("r") <= k + 1)
    lists = both.join(few.select(F.col("head").alias("b"), F.col("id").alias("neighbour")), "b")
    lists = lists.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "neighbour"))).where(F.col("r") <= k + 1)
    lists = lists.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("r", "neighbour", "score"))).alias("list"))  # k + 1 entries at most
    own = rows.join(lists.withColumnRenamed("a", "head"), "head").select("id", F.slice(F.filter("list", lambda x: x["neighbour"] != F.col("id")), 1, k).alias("list"))
    return own.select("id", F.posexplode("list").alias("at", "x")).select("id", "x.neighbour", "x.score", (F.col("at") + 1).alias("rank"))


def _cosine(a: str, b: str):
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    return F.round(dot(a, b) / F.sqrt(dot(a, a) * dot(b, b)), 9)


def p1_neighbours(spark: SparkSession, root: str) -> DataFrame:
    return similar_vectors(read_table(spark, root, "vector_points"), "id", "vector", min_score=None)


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    found = similar_vectors(read_table(spark, root, "vector_points"), "id", "vector")
    return found.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def p1_recall(spark: SparkSession, root: str) -> DataFrame:
    """(queries, expected, found, recall): the operator against exact search for every hundredth id by its hash, against all points."""
    v = read_table(spark, root, "vector_points").dropDuplicates(["id"])
    q = usable(v, "id", "vector", 128).where(F.pmod(F.xxhash64("id"), F.lit(100)) == 0).select(F.col("id").alias("query_id"), F.col("v").alias("vector"))
    exact = dense_search(q, usable(v, "id", "vector", 128).withColumnRenamed("v", "vector"), 10, -1.0)
    mine = p1_neighbours(spark, root).select(F.col("id").alias("query_id"), F.col("neighbour").alias("id"), F.lit(1).alias("hit"))
    g = exact.join(mine, ["query_id", "id"], "left").agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("expected"), F.count("hit").alias("found"))
    return g.withColumn("recall", F.when(F.col("expected") > 0, F.round(F.col("found") / F.col("expected"), 4)).otherwise(1.0))


QUERIES = {"p1_recall": p1_recall, "p1_found": p1_found, "p1_neighbours": p1_neighbours}
