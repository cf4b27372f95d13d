"""Links and classes of things that lie in families around a pivot, as two joins need them.

A family's members are known by their distance from the pivot. The distance of two members lies within their own distances of that of the
pivots, which settles most pairs for all members of the same size and distance at once; only the others are looked at one by one.
Radii are so small that all members of one family are linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.shared import Tables


DERIVED = "a long, size int, distance int, b long, other_size int, other_distance int, n long"


def derive(batches: Iterator[pa.RecordBatch], c: float, most: float = 0.0) -> Iterator[pa.RecordBatch]:
    """From two pivots' distance, for the members of either by size and distance: how many of the other family are surely linked
    (n), and which pairs of sizes and distances leave it open (n is null). Members x and y are linked if they are at most c * (sizes of both) + most apart."""
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
    names = [f.split()[0] for f in DERIVED.split(", ")]
    for batch in batches:
        sides = [batch.column(k) for k in ("pa", "pb")]
        count = [pc.list_value_length(x).to_numpy() for x in sides]
        one = (count[0] == 1) & (count[1] == 1)
        if one.any():  # two families of one size and distance each: all at once
            a, b, apart = (batch.column(k).to_numpy()[one] for k in ("a", "b", "apart"))
            flat = [pc.list_flatten(x.filter(pa.array(one))) for x in sides]
            (sx, dx, nx), (sy, dy, ny) = ([x.field(k).to_numpy() for k in range(3)] for x in flat)
            limit = c * (sx.astype(float) + sy) + most + 1e-9
            spread = dx + dy
            sure = apart + spread <= limit
            left = ~sure & (np.maximum(apart - spread, np.abs(sx - sy)) <= limit) & (spread > 0)
            none = np.zeros(2 * int(sure.sum()), np.int32)
            empty = pa.array(none, mask=np.ones(len(none), bool))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a[sure], b[sure]])), pa.array(np.concatenate([sx[sure], sy[sure]])), pa.array(np.concatenate([dx[sure], dy[sure]])), pa.array(np.concatenate([b[sure], a[sure]])), empty, empty, pa.array(np.concatenate([ny[sure], nx[sure]]))], names)
            yield pa.RecordBatch.from_arrays([pa.array(x[left]) for x in (a, sx, dx, b, sy, dy)] + [pa.nulls(int(left.sum()), pa.int64())], names)
            batch = batch.filter(pa.array(~one))
        out: list[tuple] = []
        for a, b, apart, p, q in zip(*(batch.column(k).to_pylist() for k in ("a", "b", "apart", "pa", "pb"))):
            x, y = (np.array([(r["size"], r["distance"], r["docs"]) for r in side], np.int64) for side in (p, q))
            limit = c * (x[:, None, 0] + y[None, :, 0]) + most + 1e-9
            spread = x[:, None, 1] + y[None, :, 1]
            sure = apart + spread <= limit
            for i in np.flatnonzero(sure.any(axis=1)).tolist():
                out.append((a, x[i, 0], x[i, 1], b, None, None, int(y[sure[i], 2].sum())))
            for j in np.flatnonzero(sure.any(axis=0)).tolist():
                out.append((b, y[j, 0], y[j, 1], a, None, None, int(x[sure[:, j], 2].sum())))
            least = np.maximum(apart - spread, np.abs(x[:, None, 0] - y[None, :, 0]))
            for i, j in np.argwhere(~sure & (least <= limit) & (spread > 0)).tolist():
                out.append((a, x[i, 0], x[i, 1], b, y[j, 0], y[j, 1], None))
        columns = list(zip(*out)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(columns, kinds)], names)


def two(pairs: DataFrame, facts: DataFrame, *names: str) -> DataFrame:
    """Pairs with facts of either side (whole, value) as pa and pb."""
    left, right = facts.select(F.col("whole").alias("a"), F.col("value").alias("pa"), *[F.col(x).alias(f"{x}_a") for x in names]), facts.select(F.col("whole").alias("b"), F.col("value").alias("pb"), *[F.col(x).alias(f"{x}_b") for x in names])
    return pairs.join(left, "a").join(right, "b")


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """(v, g): the least family that each one is connected to. Labels spread over edges and jump along labels until none changes."""
    pairs = tables.write("edges", edges.distinct())
    both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = tables.write("label0", both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("g")).select(F.col("a").alias("v"), "g"))
    done = 0
    while True:
        near = both.join(label.select(F.col("v").alias("b"), "g"), "b").groupBy(F.col("a").alias("v")).agg(F.min("g").alias("o"))
        spread = label.join(near, "v", "left").select("v", F.col("g").alias("was"), F.least("g", "o").alias("g"))
        jump = label.select(F.col("v").alias("g"), F.col("g").alias("h"))
        done += 1
        new = tables.write(f"label{done}", spread.join(jump, "g", "left").select("v", "was", F.least("g", "h").alias("g")))
        moved = new.where("g < was").limit(1).count()
        label = new.select("v", "g")
        tables.drop(f"label{done - 1}")
        if not moved:
            tables.drop("edges")
            return label


def members(members: DataFrame, apart: DataFrame, tables: Tables, c: float, most: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(answers by class of members: a, size, distance, b, n; pairs that are open: a, b, size, other_size) from members (whole, size,
    family, distance, docs) and the distances of pivots (a, b, apart)."""
    kinds = members.groupBy("family", "size", "distance").agg(F.sum("docs").alias("docs"))
    profile = kinds.groupBy(F.col("family").alias("whole")).agg(F.collect_list(F.struct("size", "distance", "docs")).alias("value"))
    derived = tables.write("derived", two(apart, profile).mapInArrow(lambda b: derive(b, c, most), DERIVED))
    side = members.select(F.col("family").alias("a"), "size", "distance", F.col("whole").alias("x"))
    other = members.select(F.col("family").alias("b"), F.col("size").alias("other_size"), F.col("distance").alias("other_distance"), F.col("whole").alias("y"))
    single = derived.where("n is null").join(side, ["a", "size", "distance"]).join(other, ["b", "other_size", "other_distance"])
    return derived.where("n is not null").select("a", "size", "distance", "b", "n"), single.select(F.col("x").alias("a"), F.col("y").alias("b"), "size", "other_size")


def links(own: DataFrame, members: DataFrame, derived: DataFrame, pairs: DataFrame, tables: Tables, key: str) -> DataFrame:
    """(key, class_id, links) for each of ``own`` (key, whole; null is linked to nothing), from the answers by class and single pairs (a, b)."""
    answers = tables.write("answers", two(pairs, members.select("whole", F.col("family").alias("value"), "docs"), "docs"))
    edges = derived.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionAll(answers.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))).where("a != b")
    label = components(edges, tables)
    family = members.groupBy("family").agg(F.sum("docs").alias("all_docs"), F.min("least").alias("least")).join(label, F.col("family") == F.col("v"), "left").withColumn("g", F.coalesce("g", "family"))
    family = family.join(family.groupBy("g").agg(F.min("least").alias("class_id")), "g").select("family", "all_docs", "class_id")
    sure = derived.groupBy(F.col("a").alias("family"), "size", "distance").agg(F.sum("n").alias("sure"))
    each = answers.select(F.col("a").alias("whole"), F.col("docs_b").alias("n")).unionAll(answers.select(F.col("b").alias("whole"), F.col("docs_a").alias("n"))).groupBy("whole").agg(F.sum("n").alias("single"))
    found = members.join(family, "family").join(sure, ["family", "size", "distance"], "left").join(each, "whole", "left")
    found = tables.write("found", found.select("whole", "class_id", (F.col("all_docs") - 1 + F.coalesce("sure", F.lit(0)) + F.coalesce("single", F.lit(0))).alias("links")))
    tables.drop("answers", "derived")
    return own.join(found, "whole", "left").select(key, F.coalesce("class_id", key).alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
