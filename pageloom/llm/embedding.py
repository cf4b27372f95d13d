"""Near duplicates among embeddings: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

A hash function rotates a unit vector (three rounds of random signs and a Walsh-Hadamard transform) and names the axis that
the result lies nearest to, with its sign. ``k`` functions make a table's bucket. Every vector is stored in one bucket per table, and as a
query looks into that bucket and into those where one function takes its second nearest axis. ``k`` follows from the number of vectors, so
that buckets stay small however many there are; the number of tables follows from the measured chance that a pair at the threshold meets in one.

Equal vectors are one, and vectors that are read together and lie within ``RADIUS`` of a pivot are its family; pivots that share a bucket are brought together
and form families again, which take their members along. All vectors are hashed, but buckets hold families: a large group of near copies is a few
entries of each. Angles between pivots settle most pairs of members, the rest are computed one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.families import links, members, two
from pageloom.llm.shared import Tables
from pageloom.llm.tokens import mix

THRESHOLD = 0.9
#: Chance that a pair at the threshold is missed by all tables.
MISS = 0.002
#: A member's angle from its pivot, and a pivot's from the one that takes its members, as a share of the threshold's: together less than a half,
#: so that all members of a family are linked.
RADIUS = 0.24
#: Vectors among which a task forms families at a time.
ROUND = 2048
#: Angles are counted in these parts of a radian, rounded up where they are members'.
_PART = 1000
SEED = 7919
ROUNDS = 3


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row, scaled to keep lengths; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(np.float32(d))


@lru_cache(maxsize=16)
def _signs(functions: int, width: int) -> np.ndarray:
    return (np.random.default_rng(SEED).integers(0, 2, (functions, ROUNDS, width)) * 2 - 1).astype(np.float32)


def axes(x: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest and second nearest signed axis of each rotated row."""
    for s in signs:
        x = hadamard(x * s)
    rows = np.arange(len(x))
    size = np.abs(x)
    one = size.argmax(axis=1)
    first = 2 * one + (x[rows, one] < 0)
    size[rows, one] = -1
    two = size.argmax(axis=1)
    return first, 2 * two + (x[rows, two] < 0)


def buckets(x: np.ndarray, k: int, tables: int, kind: int = 0) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Per table each row's own bucket and those that it probes besides; ``kind`` keeps vectors of other lengths apart."""
    signs = _signs(k * tables, x.shape[1])
    for t in range(tables):
        found = [axes(x, signs[t * k + i]) for i in range(k)]

        def key(other: int, found: list = found, t: int = t) -> np.ndarray:
            out = np.full(len(x), t * 1_000_003 + kind, np.uint64)
            for i, (first, second) in enumerate(found):
                out = mix(out * np.uint64(0x9E3779B97F4A7C15) + (second if i == other else first).astype(np.uint64))
            return out.view(np.int64)

        yield key(-1), [key(i) for i in range(k)]


@lru_cache(maxsize=16)
def tables_for(width: int, k: int, threshold: float, miss: float) -> int:
    """Tables after which a pair at the threshold is missed with chance ``miss``: the chance in one is measured on random pairs."""
    rng = np.random.default_rng(SEED + 1)
    n = 1000
    p = rng.standard_normal((n, width)).astype(np.float32)
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    q = rng.standard_normal((n, width)).astype(np.float32)
    q -= (q * p).sum(axis=1, keepdims=True) * p
    q = threshold * p + np.sqrt(max(0.0, 1 - threshold**2)) * q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-9)
    met = np.zeros(n)
    for (a, more), (b, other) in zip(buckets(p, k, 4), buckets(q.astype(np.float32), k, 4)):
        hit = a == b
        for m in more:
            hit |= m == b
        for m in other:
            hit |= m == a
        met += hit
    chance = min(0.999, max(0.01, met.mean() / 4))
    return int(np.ceil(np.log(miss) / np.log(1 - chance)))


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) by length; null, empty, zero and non-finite vectors and those with null elements are left out."""
    ptr = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False)  # a null element is nan
    count = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(ptr), 0)
    for d in np.unique(count[count > 0]).tolist():
        rows = np.flatnonzero(count == d)
        x = flat[ptr[rows][:, None] + np.arange(d)].astype(np.float64)
        x /= np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)  # no overflow in the squares
        size = np.linalg.norm(x, axis=1)
        ok = np.isfinite(size) & (size > 0)
        if ok.any():
            yield rows[ok], x[ok] / size[ok, None]


def _width(d: int) -> int:
    return 1 << max(1, int(d - 1).bit_length())


_OWN = "id long, whole long, family long, distance int, unit array<double>"


def _greedy(x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Each unit vector's pivot (the first one not taken that lies within the radius), and its angle from it in parts of a radian, rounded up."""
    cosine = x @ x.T
    pivot, taken = np.arange(len(x)), np.zeros(len(x), bool)
    for i in range(len(x)):
        if not taken[i]:
            near = np.flatnonzero((cosine[i, i + 1 :] >= np.cos(radius)) & ~taken[i + 1 :]) + i + 1
            taken[near] = True
            pivot[near] = i
    angle = np.arccos(np.clip(cosine[np.arange(len(x)), pivot], -1, 1))
    return pivot, np.where(pivot == np.arange(len(x)), 0, np.ceil(angle * _PART + 1e-3)).astype(np.int32)


def _families(batches: Iterator[pa.RecordBatch], radius: float) -> Iterator[pa.RecordBatch]:
    """Each vector with its identity, its pivot's, and its angle from it; vectors that can't be compared without."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROUND):
            part = batch.slice(at, ROUND)
            n = part.num_rows
            whole, family, distance = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int32)
            known, units = np.zeros(n, bool), [None] * n
            for rows, x in _vectors(part.column("v")):
                known[rows] = True
                own = np.array([xxhash.xxh64_intdigest(v.tobytes()) for v in x], np.uint64).view(np.int64)
                pivot, distance[rows] = _greedy(x, radius)
                whole[rows], family[rows] = own, own[pivot]
                for r, v in zip(rows.tolist(), x):
                    units[r] = v
            arrays = [pa.array(v, mask=~known) for v in (whole, family, distance)]
            yield pa.RecordBatch.from_arrays([part.column("id"), *arrays, pa.array(units, pa.list_(pa.float64()))], ["id", "whole", "family", "distance", "unit"])


def _coarse(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Pivots with the bucket of one table."""
    for batch in batches:
        key = np.zeros(batch.num_rows, np.int64)
        for rows, x in _vectors(batch.column("unit")):
            wide = np.zeros((len(x), _width(x.shape[1])), np.float32)
            wide[:, : x.shape[1]] = x
            key[rows] = next(buckets(wide, k, 1, x.shape[1]))[0]
        yield pa.RecordBatch.from_arrays([pa.array(key), batch.column("whole"), batch.column("unit")], ["bucket", "whole", "unit"])


def _tops(batches: Iterator[pa.RecordBatch], radius: float) -> Iterator[pa.RecordBatch]:
    """Pivots, in order of bucket, and those that take their members."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROUND):
            part = batch.slice(at, ROUND)
            ids = part.column("whole").to_numpy()
            for rows, x in _vectors(part.column("unit")):
                pivot, distance = _greedy(x, radius)
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(ids[rows][pivot]), pa.array(distance)], ["family", "top", "more"])


def _hash(batches: Iterator[pa.RecordBatch], k: int, threshold: float, miss: float) -> Iterator[pa.RecordBatch]:
    """Buckets of each batch's families, without repetition: those that a member is stored in, and those that one looks into."""
    for batch in batches:
        family = batch.column("family").to_numpy()
        for rows, x in _vectors(batch.column("unit")):
            wide = np.zeros((len(x), _width(x.shape[1])), np.float32)
            wide[:, : x.shape[1]] = x
            for own, probes in buckets(wide, k, tables_for(wide.shape[1], k, threshold, miss), x.shape[1]):
                key, who = np.concatenate([own, *probes]), np.tile(family[rows], 1 + len(probes))
                stored = np.arange(len(key)) < len(own)
                by = np.lexsort((~stored, who, key))
                key, who, stored = key[by], who[by], stored[by]
                new = np.r_[True, (key[1:] != key[:-1]) | (who[1:] != who[:-1])]
                yield pa.RecordBatch.from_arrays([pa.array(key[new]), pa.array(who[new]), pa.array(stored[new])], ["bucket", "id", "stored"])


def _angles(batches: Iterator[pa.RecordBatch], most: float) -> Iterator[pa.RecordBatch]:
    """Pairs of one length whose angle is at most ``most``; angles in parts of a radian, and cosines."""
    for batch in batches:
        cosine = np.full(batch.num_rows, -2.0)
        x, y = batch.column("pa"), batch.column("pb")
        p, q = x.offsets.to_numpy().astype(np.int64), y.offsets.to_numpy().astype(np.int64)
        size, other = np.diff(p), np.diff(q)
        fx, fy = x.values.to_numpy(zero_copy_only=False), y.values.to_numpy(zero_copy_only=False)
        for d in np.unique(size[size == other]).tolist():
            for rows in np.array_split(at := np.flatnonzero((size == d) & (other == d)), max(1, len(at) * d // 2_000_000)):
                cosine[rows] = np.einsum("ij,ij->i", fx[p[rows][:, None] + np.arange(d)], fy[q[rows][:, None] + np.arange(d)])
        angle = np.arccos(np.clip(cosine, -1, 1)) * _PART
        ok = pa.array((cosine > -1.5) & (angle <= most))
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok), pa.array(angle).filter(ok), pa.array(cosine).filter(ok)], ["a", "b", "apart", "cosine"])


def near(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """One row per key: key, class_id and links. ``links`` is the number of other vectors found whose cosine with this one is ``threshold`` or more,
    ``class_id`` the least key of all that links connect.

    Every vector is a query. Each link is verified; a pair at the threshold is missed with chance ``miss``, a nearer one less often. Cosines
    equal to the threshold are links. Null, empty, zero and non-finite vectors and vectors with null elements have no links and are a class of their own;
    vectors of different lengths are never linked. Rows with a null key have no row; of repeated rows of one key one counts, the one with the least
    vector. Other columns are not read. An empty table gives no rows. Vectors may be of any length.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v")).where("id is not null")
    rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    tables = Tables(spark)
    limit = float(np.arccos(threshold))
    radius = RADIUS * limit
    every = tables.write("vectors", rows.mapInArrow(lambda b: _families(b, radius), _OWN))
    facts = every.agg(F.count("whole").alias("n"), F.max(F.size("unit")).alias("d")).first()
    own = every.select(F.col("id").alias(key), "whole")
    if not facts["n"]:
        return own.select(key, F.col(key).alias("class_id"), F.lit(0).cast("long").alias("links"))
    k = max(1, int(np.ceil(np.log(max(2, facts["n"])) / np.log(2 * _width(facts["d"])))))
    pivots = every.where("whole = family").groupBy(F.col("whole")).agg(F.first("unit").alias("unit")).mapInArrow(lambda b: _coarse(b, k), "bucket long, whole long, unit array<double>")
    tops = tables.write("tops", pivots.repartition("bucket").sortWithinPartitions("bucket", "whole").mapInArrow(lambda b: _tops(b, radius), "family long, top long, more int"))
    # 1 at least: what lies on the threshold is left open
    taken = every.where("whole is not null").join(tops, "family").select("id", "whole", "unit", F.col("top").alias("family"), F.greatest(F.col("distance") + F.col("more"), F.lit(1)).alias("distance"))
    one = taken.groupBy("whole").agg(F.min(F.struct("distance", "family")).alias("m"), F.count("*").alias("docs"), F.min("id").alias("least"), F.first("unit").alias("unit"))
    sets_ = tables.write("sets", one.select("whole", F.lit(0).alias("size"), "m.family", "m.distance", "docs", "least", "unit"))
    units = sets_.select("whole", F.col("unit").alias("value"))
    # one exchange: the families stored in a bucket against those that look into it
    probing = tables.write("buckets", sets_.select("family", "unit").mapInArrow(lambda b: _hash(b, k, threshold, miss), "bucket long, id long, stored boolean").groupBy("bucket", "id").agg(F.max("stored").alias("stored")))
    met = probing.where("stored").select("bucket", F.col("id").alias("p")).join(probing.select("bucket", F.col("id").alias("q")), "bucket").where("p != q")
    met = met.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
    found = "a long, b long, apart double, cosine double"
    apart = tables.write("apart", two(met, units).mapInArrow(lambda b: _angles(b, (limit + 2 * radius) * _PART + 3), found).select("a", "b", "apart"))
    tables.drop("buckets")
    derived, single = members(sets_, apart, tables, 0.0, limit * _PART - 1e-6)
    pairs = two(single.select("a", "b"), units).mapInArrow(lambda b: _angles(b, 4 * _PART), found).where(F.col("cosine") >= threshold).select("a", "b")
    return links(own, sets_.drop("unit"), derived, pairs, tables, key)
