"""Exact Jaccard self-join of documents' n-gram sets, with set relations deciding what can be skipped.

1. Equal sets are one set with several documents.
2. Families: sets that are read together and lie within ``RADIUS`` of one of them (the pivot) are its family, known by their distance from it. The
   lists hold families: of all members' postings of an n-gram one is kept, with the widest bounds, so a large family is skipped as one block.
3. Pairs of families come from lists of prefix n-grams. A list is ordered by the overlap that its sets need at least; each posting's position in its
   set says up to which need a partner can still reach the threshold, so all of the list behind that is skipped as one block. Prefixes are so
   long that a pair shares ``SHARED`` n-grams of them, or all that it needs; pairs that share fewer are dropped before anything else is fetched. A
   bitmap of each set's parities bounds the difference of the pairs left; those that pass are verified on the whole sets. Pairs whose sets lie
   together are verified together, so that a set travels once for all of them.
4. Members' answers are derived from their pivots': the distance of two members lies within their distances from their pivots of the pivots'
   distance. Most answers are settled by this, for all members of the same size and distance at once; the others are verified on the whole sets.
   Members of one family are so near to their pivot that all of them are answers of each other.

Which families there are affects the work alone. N-grams are ordered by how often they occur in the whole corpus, rare ones first: by their own
counts, where these are known, or by those of their words; any order is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm.families import links, members, two
from pageloom.llm.shared import Tables, text_id
from pageloom.llm.tokens import mix, pieces, steps, strings, window_hash, words

N = 3
THRESHOLD = 0.55
#: A member's distance from its pivot (n-grams that only one of them has), as a share of its size.
RADIUS = 0.28
#: Words and n-grams whose counts are known: bounds on what is broadcast, not on answers.
MOST_WORDS, MOST_SHARED = 200_000, 500_000
#: N-grams that are counted together; those met three times or more among them are made known.
COUNTED = 4_000_000
#: N-grams that the prefixes of a pair must share.
SHARED = 6
#: N-grams of the sets among which a task forms families at a time.
ROUND = 1_000_000
#: Postings of one n-gram in one block; a longer list is split into blocks that meet pairwise.
HOT = 20_000
#: Bits of the filter that says which sets are fetched; what passes it by chance is dropped by the join.
FILTER_BITS = 26
#: Postings in one bucket, about.
BUCKET = 3_000_000
#: Bytes of sets, and pairs, that are verified together; a home with more is split into blocks.
TOGETHER, PAIRS = 16 << 20, 20_000
#: Needs are counted in eighths of an n-gram, rounded down.
_PART = 8


def sets(column: pa.Array, n: int = N, order: "_Order | None" = None) -> Iterator:
    """Each text's n-grams of words as sorted distinct hashes; a shorter text is one n-gram, one without words has none. With an order, also
    each n-gram's place in it."""
    for a, z in steps(column):
        w = words(column.slice(a, z - a))
        grams = window_hash(w.hash, n)
        weight = order.weights(w.hash) if order else None
        for i in range(z - a):
            p, q = int(w.ptr[i]), int(w.ptr[i + 1])
            size = min(n, q - p)
            s = grams[p : q - n + 1] if size == n else window_hash(w.hash[p:q], size) if size else w.hash[:0]
            by = np.argsort(s, kind="stable")
            by = by[np.r_[True, s[by][1:] != s[by][:-1]][: len(by)]]
            s = s[by]
            if order is None:
                yield s
            else:
                total = np.concatenate([[0], np.cumsum(weight[p:q])])
                yield s, order.ranks(s, (total[size:] - total[: len(total) - size])[by] if size else by)


def _bitmap(s: np.ndarray) -> bytes:
    """Parities of how many elements fall on each bit; about two to four bits an element."""
    m = 1 << max(6, int(2 * len(s) - 1).bit_length())
    return np.packbits((np.bincount((s >> np.uint64(20)).astype(np.int64) & (m - 1), minlength=m) & 1).astype(np.uint8), bitorder="little").tobytes()


def _apart(p: bytes, q: bytes) -> int:
    """A lower bound of the number of elements in one set alone, from bitmaps; the larger bitmap is folded to the smaller."""
    x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _reach(threshold: float) -> tuple[float, float]:
    """(c, radius): sets of sizes x and y are answers if their distance is at most c (x + y); members within c times their size are answers of each other."""
    c = (1 - threshold) / (1 + threshold)
    return c, min(RADIUS, c)


def whole_of(s: np.ndarray) -> int:
    """A set's identity."""
    return int(mix(s * np.uint64(3)).sum(dtype=np.uint64).view(np.int64))


def _outline(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Per document its set's identity, size (0 without words) and bitmap; now and then also (with doc_id null) the words met three times or more,
    and (with bits empty) such n-grams."""
    held: list[np.ndarray] = []
    met: list[tuple[np.ndarray, np.ndarray]] = []  # words of each batch with their counts
    count = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for mark in (None, b""):
            if mark is None:
                h, at = np.unique(np.concatenate([np.zeros(0, np.int64), *(h for h, _ in met)]), return_inverse=True)
                n_ = np.bincount(at, np.concatenate([np.zeros(0), *(n_ for _, n_ in met)]), len(h)).astype(np.int64)
                h, n_ = h[n_ >= 3], n_[n_ >= 3]
                met.clear()
            else:
                h, n_ = _counted(np.concatenate([np.zeros(0, np.uint64), *held]), 3)
                held.clear()
            for a in range(0, len(h), 100_000):
                k = len(h[a : a + 100_000])
                yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.array(h[a : a + k]), pa.array(n_[a : a + k].astype(np.int32)), pa.array([mark] * k, pa.binary())], ["doc_id", "whole", "size", "bits"])

    for batch in pieces(batches):
        column = strings(batch.column("text"))
        whole, size, bits = [], [], []
        for s in sets(column, n):
            whole.append(whole_of(s) if len(s) else 0)
            size.append(len(s))
            bits.append(_bitmap(s) if len(s) else None)
            held.append(s)
            count += len(s)
        met.extend(_counted(words(column.slice(a, z - a)).hash, 1) for a, z in steps(column))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(whole, np.int64)), pa.array(np.array(size, np.int32)), pa.array(bits, pa.binary())], ["doc_id", "whole", "size", "bits"])
        if count >= COUNTED:
            yield from flush()
            count = 0
    yield from flush()


def _counted(values: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The values that occur so many times or more, and their counts; an array of its own is sorted in place."""
    every = values if values.flags.writeable and values.base is None else values.copy()
    every.sort()
    first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]][: len(every)])
    count = np.diff(np.append(first, len(every)))
    return every[first[count >= least]].view(np.int64), count[count >= least]


class _Order:
    """How often n-grams occur, as far as their own counts are known, or by their words' counts (of ``total`` words in groups of ``n``)."""

    def __init__(self, words_: pa.Table, shared: pa.Table, total: int, n: int) -> None:
        self.words, count = self._by_hash(words_)
        self.weight = np.floor(4 * np.log2(np.maximum(count, 1))).astype(np.int64)
        self.shared, self.count = self._by_hash(shared)
        self.less = int(4 * (n - 1) * np.log2(max(2, total)))

    @staticmethod
    def _by_hash(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        h = table.column("whole").to_numpy().astype(np.int64).view(np.uint64)
        by = np.argsort(h)
        return h[by], table.column("n").to_numpy().astype(np.int64)[by]

    @staticmethod
    def _look(known: np.ndarray, values: np.ndarray, h: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        return np.where(known[at] == h, values[at], 0)

    def weights(self, h: np.ndarray) -> np.ndarray:
        """Four times the logarithm of each word's count (0 where it isn't known)."""
        return self._look(self.words, self.weight, h)

    def often(self, s: np.ndarray) -> np.ndarray:
        return self._look(self.shared, self.count, s)

    def ranks(self, s: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Four times the logarithm of how often each n-gram is known or expected to occur. Ties go by hash."""
        return np.maximum(weight - self.less, 4 * np.log2(np.maximum(self.often(s), 1))).astype(np.int32)


#: N-grams by which a set's pivot is looked for, and pivots that are tried for each: more of them find more members, answers don't depend on it.
KEYS, TRIED = 6, 8


def _families(held: list[np.ndarray], radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Per set its pivot's number and its distance. Sets most of whose n-grams others have too are pivots first: they lie in the middle."""
    size = np.array([len(s) for s in held])
    every = np.concatenate(held)
    order = np.argsort(every, kind="stable")
    new = np.r_[True, every[order][1:] != every[order][:-1]]
    count = np.diff(np.append(np.flatnonzero(new), len(every)))[np.cumsum(new) - 1]
    common = np.empty(len(every))
    common[order] = count > 1
    share = np.add.reduceat(common, np.cumsum(size) - size) / size
    pivot, distance = np.arange(len(held)), np.zeros(len(held), np.int64)
    known: dict[int, list[int]] = {}
    for i in np.argsort(-share, kind="stable").tolist():
        if not share[i]:
            break  # no other set has anything of this one and of those to come
        s = held[i]
        keys = s[:KEYS].tolist()
        tried = set()
        for p in (p for key in keys for p in known.get(key, ())):
            if p in tried:
                continue
            tried.add(p)
            other = held[p]
            if abs(len(other) - len(s)) > radius * len(s):
                continue
            both = int((other[np.minimum(np.searchsorted(other, s), len(other) - 1)] == s).sum())
            d = len(s) + len(other) - 2 * both
            if d <= radius * len(s):
                pivot[i], distance[i] = p, d
                break
        else:
            for key in keys:
                if len(have := known.setdefault(key, [])) < TRIED:
                    have.append(i)
    return pivot, distance


_POSTINGS = "bucket int, keys binary, cans binary, sides binary, counts binary, ids binary, needs binary"


def _short(key: np.ndarray) -> bytes:
    """48 bits of each n-gram tell it apart within its bucket."""
    return key.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _upward(can: np.ndarray) -> np.ndarray:
    """Bounds in 16 bits, rounded up on a scale of thousandths."""
    return np.ceil(np.log(np.maximum(can, 1)) * 1000).astype(np.uint16)


def _postings(batches: Iterator[pa.RecordBatch], n: int, threshold: float, order: _Order, buckets: int, hot: int) -> Iterator[pa.RecordBatch]:
    """Postings of families by bucket: n-gram, most that a partner may need (in eighths), side of a split list; per family of the bucket the number
    of its postings and the least need. In buckets beyond ``buckets`` the members (ids), their pivots (keys), and distances (cans)."""
    _, radius = _reach(threshold)
    seen: set[int] = set()
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    total = 0

    def flush() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        size = np.array([len(s) for _, s, _ in held], np.int64)
        begin = np.cumsum(size) - size
        row = np.repeat(np.arange(len(held)), size)
        pivot, distance = _families([s for _, s, _ in held], radius)
        ids = np.array([w for w, _, _ in held], np.int64)
        need = np.floor(threshold / (1 + threshold) * size * _PART - 1e-6).astype(np.int64)
        length = np.minimum(size, size - np.ceil(threshold * size - 1e-9).astype(np.int64) + SHARED)
        by = np.lexsort((np.concatenate([r for _, _, r in held]), row))  # stable: ties stay in order of hash
        key = np.concatenate([s for _, s, _ in held])[by]
        place = np.arange(len(key)) - begin[row]
        used = place < length[row]
        key, row, place = key[used], row[used], place[used]
        often = order.often(key)
        can = _PART * (SHARED + size[row] - place - 1) - need[row]
        least = need.copy()
        np.minimum.at(least, pivot, need)
        row = pivot[row]
        if (pivot != np.arange(len(pivot))).any():  # of a family's postings of one n-gram the one with the widest bound
            by = np.lexsort((-can, key, row))
            by = by[np.r_[True, (key[by][1:] != key[by][:-1]) | (row[by][1:] != row[by][:-1])]]
            key, row, can, often = key[by], row[by], can[by], often[by]
        side = np.full(len(key), 2, np.uint8)
        if (often > hot).any():  # blocks x <= y of a long list: each posting goes to all pairs of blocks with its own
            long = np.flatnonzero(often > hot)
            blocks = -(-often[long] // hot)
            other = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            who = np.repeat(long, blocks)
            mine = (mix(ids[row[who]].view(np.uint64)) % np.repeat(blocks, blocks).astype(np.uint64)).astype(np.int64)
            x, y = np.minimum(mine, other), np.maximum(mine, other)
            split = mix(key[who] ^ mix((x * (1 << 31) + y + 1).astype(np.uint64)))
            rest = np.flatnonzero(often <= hot)
            side = np.concatenate([side[rest], np.where(x == y, 2, mine == y).astype(np.uint8)])
            key, row, can = np.concatenate([key[rest], split]), np.concatenate([row[rest], row[who]]), np.concatenate([can[rest], can[who]])
        bucket = (mix(key) % np.uint64(buckets)).astype(np.int32)
        by = np.lexsort((row, bucket))
        key, row, can, side, bucket = key[by], row[by], can[by].astype(np.int32), side[by], bucket[by]
        edges = np.append(np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket))
        out = []
        for x, y in zip(edges[:-1].tolist(), edges[1:].tolist()):
            new = np.flatnonzero(np.r_[True, row[x + 1 : y] != row[x : y - 1]])  # each family's facts are sent once
            r = row[x:y][new]
            out.append((int(bucket[x]), _short(key[x:y]), _upward(can[x:y]).tobytes(), side[x:y].tobytes(), np.diff(np.append(new, y - x)).astype(np.int32).tobytes(), ids[r].tobytes(), least[r].tobytes()))
        m = np.flatnonzero(pivot != np.arange(len(pivot)))
        if len(m):
            out.append((buckets + int(ids[m[0]] % buckets), ids[pivot[m]].tobytes(), distance[m].astype(np.int32).tobytes(), b"", b"", ids[m].tobytes(), b""))
        columns = list(zip(*out))
        for z in range(0, len(out), 256):
            yield pa.RecordBatch.from_arrays([pa.array(columns[0][z : z + 256], pa.int32()), *(pa.array(col[z : z + 256], pa.binary()) for col in columns[1:])], [f.split()[0] for f in _POSTINGS.split(", ")])

    for batch in pieces(batches):
        for s, ranks in sets(strings(batch.column("text")), n, order):
            if len(s) and (w := whole_of(s)) not in seen:
                seen.add(w)
                held.append((w, s, ranks))
                total += len(s)
                if total >= ROUND:
                    yield from flush()
                    held, total = [], 0
    yield from flush()


_MET = "a long, b long, shared int, must int"


def _candidates(table: pa.Table, buckets: int) -> pa.Table:
    """Pairs of families, with how many n-grams they share from which the overlap needed can still be reached, and how many they must.
    Members pass: (set, pivot, distance, -1)."""
    def col(name: str, kind: type) -> np.ndarray:
        return np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()])

    if table.column("bucket")[0].as_py() >= buckets:
        ids = col("ids", np.int64)
        return pa.table({"a": ids, "b": col("keys", np.int64), "shared": col("cans", np.int32), "must": np.full(len(ids), -1, np.int32)})
    six = col("keys", np.uint8).reshape(-1, 6)
    key = np.zeros((len(six), 8), np.uint8)
    key[:, :6] = six
    key = key.view(np.uint64)[:, 0]
    can, side, count = np.ceil(np.exp(col("cans", np.uint16) / 1000)).astype(np.int64), col("sides", np.uint8), col("counts", np.int32)
    names, row = np.unique(col("ids", np.int64), return_inverse=True)
    need = np.full(len(names), 2**62)
    np.minimum.at(need, row, col("needs", np.int64))  # a set may be a pivot in several tasks
    row = np.repeat(row.astype(np.int32), count)
    by = np.argsort(key, kind="stable")
    new = np.r_[True, key[by][1:] != key[by][:-1]]
    by = by[~(new & np.r_[new[1:], True])]  # a list of one posting pairs with nothing
    key, can, side, row = key[by], can[by], side[by], row[by]
    by = np.lexsort((-can, row, need[row], key))
    key, can, side, row = key[by], can[by], side[by], row[by]
    once = np.r_[True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])][: len(key)]
    key, can, side, row = key[once], can[once], side[once], row[once]
    n = len(key)
    codes, counts, waiting = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        some, where = np.unique(np.concatenate(codes), return_inverse=True)
        return some, np.bincount(where, np.concatenate(counts), len(some)).astype(np.int64)

    if n:
        own = need[row]
        group = np.cumsum(np.r_[True, key[1:] != key[:-1]])
        at_need = group * (1 << 40) + own + (1 << 20)
        # the list from here to where needs are out of reach; the block behind it is skipped
        last = np.searchsorted(at_need, group * (1 << 40) + np.maximum(can, own - 1) + (1 << 20), "right")
        todo = np.maximum(last - np.arange(n) - 1, 0)
        done = np.concatenate([[0], np.cumsum(todo)])
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(done, done[at] + 400_000, "right")) - 1)
            k = todo[at:to]
            left = np.repeat(np.arange(at, to), k)
            right = np.arange(len(left)) - np.repeat(done[at:to] - done[at], k) + left + 1
            ok = (can[right] >= own[left]) & ((side[left] == 2) | (side[left] != side[right]))
            x, y = row[left[ok]], row[right[ok]]
            some, times = np.unique(np.minimum(x, y).astype(np.int64) * len(names) + np.maximum(x, y), return_counts=True)
            codes.append(some)
            counts.append(times)
            waiting += len(some)
            if waiting > 4_000_000:
                code, times = merged()
                codes, counts, waiting = [code], [times], 0
            at = to
    code, times = merged()
    i, j = code // max(1, len(names)), code % max(1, len(names))
    must = np.minimum(SHARED, -(-(need[i] + need[j]) // _PART))
    return pa.table({"a": names[i], "b": names[j], "shared": times.astype(np.int32), "must": must.astype(np.int32)})


_NEAR = "a long, b long, most double, bytes_a long, bytes_b long"
_NEAR_NAMES = [f.split()[0] for f in _NEAR.split(", ")]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose bitmaps leave the distance ``most`` within reach, with upper bounds of the bytes of either set."""
    for batch in batches:
        left, right = batch.column("pa").to_pylist(), batch.column("pb").to_pylist()
        ok = [_apart(p, q) <= m for p, q, m in zip(left, right, batch.column("most").to_pylist())]
        size = [pa.array([32 * len(x) for x in side], pa.int64()) for side in (left, right)]  # a byte of the bitmap stands for four n-grams at most
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("a", "b", "most")), *size], _NEAR_NAMES).filter(pa.array(ok, pa.bool_()))


def _chosen(batches: Iterator[pa.RecordBatch], n: int, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sets that the filter lets pass, each once a task."""
    seen: set[int] = set()
    mask = (1 << FILTER_BITS) - 1
    for batch in pieces(batches):
        ids, grams = [], []
        for s in sets(strings(batch.column("text")), n):
            if len(s) and bits[(w := whole_of(s)) >> 6 & mask >> 6] >> np.uint64(w & 63) & np.uint64(1) and w not in seen:
                seen.add(w)
                ids.append(w)
                grams.append(s.tobytes())
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(grams, pa.binary())], ["whole", "grams"])


def _verify(table: pa.Table) -> pa.Table:
    """Distances (n-grams that only one of two sets has) of the pairs of one bucket, where they are at most ``most``; its sets have no ``b``."""
    own = pc.is_null(table.column("b"))
    have, pairs = table.filter(own), table.filter(pc.invert(own))
    grams = {w: np.frombuffer(g.as_buffer(), np.uint64) for w, g in zip(have.column("a").to_pylist(), have.column("grams"))}
    values = np.zeros(len(pairs), np.int32)
    for i, (a, b) in enumerate(zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist())):
        both = np.sort(np.concatenate([grams[a], grams[b]]))
        values[i] = len(both) - 2 * int((both[1:] == both[:-1]).sum())
    return pa.table({"a": pairs.column("a"), "b": pairs.column("b"), "apart": values}).filter(pa.array(values <= pairs.column("most").to_numpy()))


def _placed(near: DataFrame, tables: Tables, name: str) -> DataFrame:
    """The pairs with the bucket that each is verified in. A pair's home is the least set that either of its two is paired with, so the pairs of sets
    that lie together share one, and a set is sent once to each home and not with each pair; large homes are split into blocks as long lists are."""
    ends = near.select("a", "b").unionAll(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    home = ends.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("whole"), F.least("a", "b").alias("value"))
    placed = tables.write(f"{name}_homes", two(near, home).select(*_NEAR_NAMES, F.least("pa", "pb").alias("home")))
    sides = [placed.select("home", F.col(x).alias("whole"), F.col(f"bytes_{x}").alias("bytes")) for x in "ab"]
    each = sides[0].unionAll(sides[1]).groupBy("home", "whole").agg(F.first("bytes").alias("bytes"), F.count("*").alias("n"))
    load = tables.write(f"{name}_load", each.groupBy("home").agg(F.sum("bytes").alias("bytes"), (F.sum("n") / 2).alias("n")))
    parts = F.greatest(F.ceil(F.lit(2.0) * F.col("bytes") / TOGETHER), F.ceil(F.sqrt(2 * F.col("n") / PAIRS)))
    large = load.where((F.col("bytes") > TOGETHER) | (F.col("n") > PAIRS)).select("home", parts.alias("parts"))
    partitions = int(near.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(4 * partitions, -(-int(load.agg(F.sum("bytes")).first()[0] or 0) // TOGETHER))
    block = [F.pmod(F.xxhash64(x), F.coalesce("parts", F.lit(1))) for x in "ab"]
    at = F.pmod(F.xxhash64("home", F.least(*block), F.greatest(*block)), F.lit(buckets)).cast("int")
    return placed.join(large, "home", "left").select("a", "b", "most", at.alias("bucket"))


def _fetch(corpus: DataFrame, n: int, wanted: DataFrame) -> DataFrame:
    """(whole, grams) of the sets wanted, found by a filter of fixed size; a few others too."""
    spark = corpus.sparkSession
    word = F.col("whole").bitwiseAND((1 << FILTER_BITS) - 1)
    bit = F.expr("shiftleft(1L, cast(whole & 63 as int))")
    found = wanted.select(F.shiftright(word, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << FILTER_BITS - 6, np.uint64)
    bits[found.column("word").to_numpy().astype(np.int64)] = found.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    sent = spark.sparkContext.broadcast(bits)
    return corpus.mapInArrow(lambda b: _chosen(b, n, sent.value), "whole long, grams binary").groupBy("whole").agg(F.first("grams").alias("grams"))


def _apart_of(pairs: DataFrame, facts: DataFrame, corpus: DataFrame, n: int, tables: Tables, name: str, *source: str) -> DataFrame:
    """(a, b, apart) of the pairs of sets (a, b, most) whose distance is at most ``most``: bitmaps first, then the sets. The tables ``source`` that the
    pairs come from are dropped as soon as they are read."""
    near = tables.write(f"{name}_near", two(pairs, facts.select("whole", F.col("bits").alias("value"))).mapInArrow(_near, _NEAR))
    tables.drop(*source)
    tables.tidy()
    placed = tables.write(f"{name}_placed", _placed(near, tables, name))
    tables.drop(f"{name}_near", f"{name}_homes", f"{name}_load")
    tables.tidy()
    needed = placed.select("bucket", F.col("a").alias("whole")).unionAll(placed.select("bucket", F.col("b").alias("whole"))).distinct()
    have = needed.join(_fetch(corpus, n, needed.select("whole")), "whole").select(F.col("whole").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("double").alias("most"), "bucket", "grams")
    every = have.unionByName(placed.withColumn("grams", F.lit(None).cast("binary")))
    out = tables.write(name, every.groupBy("bucket").applyInArrow(_verify, "a long, b long, apart int"))
    tables.drop(f"{name}_placed")
    tables.tidy()
    return out


def _base(docs: DataFrame, n: int, threshold: float, tables: Tables, hot: int = HOT) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents: doc_id, whole, null without words; sets: whole, size, family, distance, docs, least; answers by class of members;
    answers of single sets)."""
    spark: SparkSession = docs.sparkSession
    c, _ = _reach(threshold)
    corpus = text_id(docs).where("doc_id is not null")
    outline = tables.write("outline", corpus.mapInArrow(lambda b: _outline(b, n), "doc_id long, whole long, size int, bits binary"))
    total = outline.where("doc_id is not null").agg(F.sum(F.col("size").cast("long"))).first()[0] or 0
    known = outline.where("doc_id is null").groupBy("whole", F.col("bits").isNull().alias("word")).agg(F.sum(F.col("size").cast("long")).alias("n"))
    known = tables.write("known", known.where("n >= 16"))
    most = [known.where(kind).orderBy(F.desc("n"), "whole").limit(limit).select("whole", "n").toArrow() for kind, limit in (("word", MOST_WORDS), ("not word", MOST_SHARED))]
    tables.drop("known")
    order = spark.sparkContext.broadcast(_Order(*most, int(total), n))
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), int(total // (2 * BUCKET)))
    postings = corpus.mapInArrow(lambda b: _postings(b, n, threshold, order.value, buckets, hot), _POSTINGS)
    tables.tidy()
    met = tables.write("met", postings.groupBy("bucket").applyInArrow(lambda t: _candidates(t, buckets), _MET))
    tables.tidy()
    # a document's set is that of its first row by identity; equal sets are one
    member = F.when(F.col("size") > 0, F.struct("whole", "size"))
    own = tables.write("own", outline.where("doc_id is not null").groupBy("doc_id").agg(F.min(member).alias("s")).select("doc_id", "s.whole", "s.size"))
    nearest = met.where("must < 0").groupBy("a").agg(F.min(F.struct(F.col("shared").alias("distance"), F.col("b").alias("family"))).alias("m")).select(F.col("a").alias("whole"), "m.family", "m.distance")
    sets_ = own.where("whole is not null").groupBy("whole", "size").agg(F.count("*").alias("docs"), F.min("doc_id").alias("least")).join(nearest, "whole", "left")
    sets_ = tables.write("sets", sets_.select("whole", "size", F.coalesce("family", "whole").alias("family"), F.coalesce("distance", F.lit(0)).alias("distance"), "docs", "least"))
    bits = outline.where("doc_id is not null and size > 0").groupBy("whole").agg(F.first("bits").alias("bits"))
    reach = sets_.groupBy("family").agg(F.max(F.lit(c) * F.col("size") + F.col("distance")).alias("reach"))
    pairs = met.where("must >= 0").groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("must").alias("must")).where("shared >= must").select("a", "b")
    far = two(pairs, reach.select(F.col("family").alias("whole"), F.col("reach").alias("value"))).select("a", "b", (F.col("pa") + F.col("pb") + 1e-6).alias("most"))
    apart = _apart_of(far, bits, corpus, n, tables, "apart", "met")
    derived, single = members(sets_, apart, tables, c)
    single = single.select("a", "b", (F.lit(c) * (F.col("size") + F.col("other_size")) + 1e-9).alias("most"))
    verified = _apart_of(single, bits, corpus, n, tables, "verified")
    tables.drop("outline", "apart")
    return own, sets_, derived, verified.select("a", "b")


def join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, class_id and links. ``links`` is the number of other documents whose sets of n-grams of words have a
    Jaccard similarity of ``threshold`` or more with its own, equal ones too; ``class_id`` the least doc_id of all that links connect.

    A text of fewer than ``n`` words is one n-gram; null and empty texts and texts without words have no links and are a class of their own.
    Rows with a null doc_id have no row. Repeated rows of one doc_id count once; if their texts differ, one of them counts. Other columns are
    not read. An empty table gives no rows. Sets are known by 64-bit sums of hashes.
    """
    tables = Tables(docs.sparkSession)
    return links(*_base(docs, n, threshold, tables, hot), tables, "doc_id")


def dedup(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns kept, with one document of each class of ``join``: the one with the least doc_id.

    Repeated rows of one doc_id that stays all stay; rows with a null doc_id or text, and texts without words, stay too. An empty table
    gives no rows.
    """
    gone = join(docs, n, threshold).where("doc_id != class_id").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, docs["doc_id"].cast("long") == gone["__gone"], "left_anti")
