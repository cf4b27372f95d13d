"""Deduplication of long repeated passages with a distributed suffix array (difference cover modulo 3).

1. Screen (loses nothing): of every ``WORDS`` words on end one winnowed fingerprint is kept; a passage of so many words that occurs twice has
   the same fingerprint twice. Only the words around repeated fingerprints go on, and of equal documents one.
2. Down: triples at places 1 and 2 modulo 3 are sorted across the cluster and named by rank; the names make two new strings
   for each string, and so on, until a name stands for as many words as are compared in the end: there the order is known.
3. Up: with the sampled suffixes' order, the others are sorted by first word and next rank, and merged.
4. Neighbours in the array are compared by their first ``WORDS`` words.

Strings stay where they are, in packs. What travels are a pack's distinct triples (suffixes, passages), once each, and what comes back is their names (ranks,
documents). So a passage that a third of all documents hold costs an entry in each pack, not in each document. Entries are partitioned by ranges of
their first three letters, whose limits are sampled at each level and whose number follows from the letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.shared import Tables, text_id
from pageloom.llm.tokens import mix, raw, steps, strings, whole, window_hash, word_spans, words

#: A passage counts if at least so many words repeat.
WORDS = 50
#: Words in a fingerprint.
PRINT = 32
#: Letters in a pack, about; and entries in a range.
PACK, RANGE = 200_000, 2_000_000

U, LAST = np.uint64, np.uint64(2**64 - 1)
_SPANS = "doc_id long, first_word int, words int, cut_words int"


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The minimum of ``width`` values from each place."""
    m, have = h, 1
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    n = len(h) - width + 1
    return np.minimum(m[:n], m[width - have : width - have + n])


def _prints(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Per document with ``size`` words or more: identity of its words, fingerprints and their places."""
    short = min(PRINT, size)
    width = size - short + 1
    for batch in batches:
        column, ids = strings(batch.column("text")), batch.column("doc_id").to_pylist()
        out = []
        for a, z in steps(column):
            w = words(column.slice(a, z - a))
            h = mix(window_hash(w.hash, short))
            windows = np.flatnonzero(whole(w.ptr, size))
            if not len(windows):
                continue
            least = _least(h, width)[windows]
            chosen = np.zeros(len(h), bool)
            for k in range(width):
                at = windows + k
                chosen[at[h[at] == least]] = True
            for i in range(z - a):
                p, q = int(w.ptr[i]), int(w.ptr[i + 1])
                if q - p >= size:
                    at = np.flatnonzero(chosen[p : q - short + 1])
                    letters = w.hash[p:q]
                    same = int((mix(letters + np.arange(q - p, dtype=U) * U(0x9E3779B97F4A7C15))).sum(dtype=U).view(np.int64))
                    out.append((ids[a + i], same, q - p, h[p + at].view(np.int64), at.astype(np.int32)))
        if out:
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(list(columns[3]), pa.list_(pa.int64())), pa.array(list(columns[4]), pa.list_(pa.int32()))],
                ["doc_id", "same", "n_words", "prints", "places"],
            )


def _regions(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The words around repeated fingerprints, as strings of letters (0 is no letter)."""
    short = min(PRINT, size)
    for batch in batches:
        column = strings(batch.column("text"))
        ids, places = batch.column("doc_id").to_pylist(), batch.column("places")
        out = []
        for a, z in steps(column):
            w = words(column.slice(a, z - a))
            for i in range(z - a):
                p, q = int(w.ptr[i]), int(w.ptr[i + 1])
                at = np.sort(places[a + i].values.to_numpy().astype(np.int64))
                begin, end = np.maximum(0, at - (size - short)), np.minimum(q - p, at + size)
                new = np.flatnonzero(np.r_[True, begin[1:] > np.maximum.accumulate(end)[:-1]])
                for x, y in zip(begin[new].tolist(), np.maximum.reduceat(end, new).tolist()):
                    out.append((ids[a + i], x, (w.hash[p + x : p + y] | U(1)).tobytes()))
        if out:
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], ["doc_id", "first", "letters"])


class _Ranges:
    """Ranges of the order by the first three letters."""

    def __init__(self, rows: list, count: int) -> None:
        keys = np.array([(r["x"], r["y"], r["z"]) for r in rows], np.int64).reshape(-1, 3).view(U)
        keys = keys[np.lexsort(keys.T[::-1])]
        self.cut = np.unique(keys[(np.arange(1, count) * len(keys)) // count], axis=0) if len(keys) else keys
        self.count = len(self.cut) + 1

    def of(self, *letters: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros(len(letters[0]), np.int64), np.full(len(letters[0]), len(self.cut), np.int64)
        for _ in range(len(self.cut).bit_length()):
            mid = np.minimum((lo + hi) // 2, max(0, len(self.cut) - 1))
            before, tie = np.zeros(len(lo), bool), np.ones(len(lo), bool)
            for k, x in enumerate(letters):
                c = self.cut[mid, k]
                before |= tie & (c < x)
                tie &= c == x
            before = (lo < hi) & (before | tie)
            hi = np.where((lo < hi) & ~before, mid, hi)
            lo = np.where(before, mid + 1, lo)
        return lo


def _packs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Regions put together to packs; a pack's number tells the task and its place in it."""
    from pyspark import TaskContext

    task, number = TaskContext.get().partitionId(), 0
    held: list[tuple[int, int, bytes]] = []
    total = 0

    def flush() -> pa.RecordBatch:
        docs, firsts, letters = zip(*held)
        row = [task << 32 | number, b"".join(letters), np.array([len(x) // 8 for x in letters], np.int32).tobytes(), np.array(docs, np.int64).tobytes(), np.array(firsts, np.int32).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in row], ["pack", "letters", "lengths", "docs", "firsts"])

    for batch in _regions(batches, size):
        for doc, first, letters in zip(*(c.to_pylist() for c in batch.columns)):
            held.append((doc, first, letters))
            total += len(letters) // 8
            if total >= PACK:
                yield flush()
                held, total, number = [], 0, number + 1
    if held:
        yield flush()


def _pack(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all strings of a pack on end, and the strings' lengths."""
    return np.frombuffer(batch.column("letters")[i].as_py(), U), np.frombuffer(batch.column("lengths")[i].as_py(), np.int32).astype(np.int64)


def _ahead(letters: np.ndarray, length: np.ndarray, by: int) -> np.ndarray:
    """The letter ``by`` places on in the same string; 0 beyond its end."""
    out = np.zeros(len(letters), U)
    out[:-by or None] = letters[by:]
    ends = np.cumsum(length)
    for k in range(1, by + 1):
        out[(ends - k)[length >= k]] = 0
    return out


def _places(n: np.ndarray) -> np.ndarray:
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def _distinct(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(first place of each distinct row, the distinct row's number of each row)."""
    n = len(columns[0])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    by = np.lexsort(columns)
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[by][1:] != c[by][:-1]
    inverse = np.empty(n, np.int64)
    inverse[by] = np.cumsum(new) - 1
    return by[new], inverse


def _sample(batches: Iterator[pa.RecordBatch], every: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            c, n = _pack(batch, i)
            if len(c):
                x = [c, _ahead(c, n, 1), _ahead(c, n, 2)]
                at = _distinct(x)[0][::every]
                yield pa.RecordBatch.from_arrays([pa.array(v[at].view(np.int64)) for v in x], ["x", "y", "z"])


def _sent(pack: int, bucket: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A pack's entries by bucket, with the numbers that they have in the pack."""
    by = np.argsort(bucket, kind="stable")
    bucket = bucket[by]
    edge = np.append(np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)]), len(bucket))
    arrays = {k: c[by] for k, c in {**columns, "number": np.arange(len(bucket), dtype=np.int32)}.items()}
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[edge[:-1]].astype(np.int32)), pa.array(np.full(len(edge) - 1, pack, np.int64)), *(pa.array([c[a:z].tobytes() for a, z in zip(edge[:-1], edge[1:])], pa.binary()) for c in arrays.values())],
        ["bucket", "pack", *arrays],
    )


def _kind(*names: str) -> str:
    return ", ".join(["bucket int", "pack long", *(f"{n} binary" for n in (*names, "number"))])


def _unpack(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()])


_BACK = "pack long, number binary, value binary, other binary"


def _back(table: pa.Table, values: np.ndarray, other: np.ndarray | None = None) -> pa.Table:
    """Values of a bucket's entries, in their order, as they go back to their packs."""
    count = np.cumsum([0] + [len(x) // 4 for x in table.column("number").to_pylist()])
    cut = lambda v: pa.array([v[a:z].tobytes() for a, z in zip(count[:-1], count[1:])], pa.binary())
    return pa.table({"pack": table.column("pack"), "number": table.column("number"), "value": cut(values), "other": cut(other) if other is not None else pa.nulls(table.num_rows, pa.binary())})


def _returned(table: pa.Table) -> pa.Table:
    """All values of one pack, by number."""
    number = _unpack(table, "number", np.int32)
    out = []
    for name in ("value", "other"):
        if table.column(name)[0].as_py() is None:
            out.append(None)
            continue
        v = _unpack(table, name, np.int64)
        full = np.empty(len(v), np.int64)
        full[number] = v
        out.append(full.tobytes())
    return pa.table({"pack": pa.array([table.column("pack")[0].as_py()], pa.int64()), "value": pa.array([out[0]], pa.binary()), "other": pa.array([out[1]], pa.binary())})


def _home(back: DataFrame) -> DataFrame:
    return back.groupBy("pack").applyInArrow(_returned, "pack long, value binary, other binary")


def _sampled(c: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places 1 and 2 modulo 3, and their triples."""
    at = np.flatnonzero(_places(n) % 3)
    return at, [c[at], _ahead(c, n, 1)[at], _ahead(c, n, 2)[at]]


def _triples(batches: Iterator[pa.RecordBatch], ranges: _Ranges) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, pack in enumerate(batch.column("pack").to_pylist()):
            _, x = _sampled(*_pack(batch, i))
            first, _ = _distinct(x)
            x = [v[first] for v in x]
            yield _sent(pack, ranges.of(*x), dict(zip("xyz", x)))


def _names(table: pa.Table) -> pa.Table:
    """Names of sorted triples: the range's number, then the rank in it."""
    columns = [_unpack(table, k, U) for k in "zyx"]
    _, rank = _distinct(columns)
    return _back(table, (U(table.column("bucket")[0].as_py() + 1) << U(40)) | (rank + 1).astype(U))


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each string two: the names at places 1 and those at places 2 modulo 3."""
    for batch in batches:
        for i, pack in enumerate(batch.column("pack").to_pylist()):
            c, n = _pack(batch, i)
            at, x = _sampled(c, n)
            value = batch.column("value")[i].as_py()
            name = np.frombuffer(value, U)[_distinct(x)[1]] if value is not None else c[:0]
            place, string = _places(n), np.repeat(np.arange(len(n)), n)
            by = np.lexsort((place[at], place[at] % 3, string[at]))
            lengths = np.column_stack([(n + 1) // 3, n // 3]).reshape(-1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([pack], pa.int64()), pa.array([name[by].tobytes()]), pa.array([lengths.tobytes()])], ["pack", "letters", "lengths"])


def _tuples(c: np.ndarray, n: np.ndarray, below: np.ndarray) -> list[np.ndarray]:
    """What decides each suffix's place: its first letters, the ranks of sampled suffixes in it, and which these are."""
    place = _places(n)
    rank = np.zeros(len(c), U)
    string = np.repeat(np.arange(len(n)), n)
    start = np.concatenate([[0], np.cumsum(np.column_stack([(n + 1) // 3, n // 3]).reshape(-1))])
    at = np.flatnonzero(place % 3)
    rank[at] = below[start[2 * string[at] + place[at] % 3 - 1] + place[at] // 3]
    y, one, two = _ahead(c, n, 1), _ahead(rank, n, 1), _ahead(rank, n, 2)
    kind = place % 3
    own = np.where(kind == 0, one, rank)  # rank of the next suffix, or of the suffix itself
    other = np.where(kind == 1, one, two)
    return [c, y, own, other, kind.astype(U)]


def _suffixes(batches: Iterator[pa.RecordBatch], ranges: _Ranges) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, pack in enumerate(batch.column("pack").to_pylist()):
            c, n = _pack(batch, i)
            columns = _tuples(c, n, np.frombuffer(batch.column("ranks")[i].as_py(), U))
            first, _ = _distinct(columns)
            yield _sent(pack, ranges.of(c[first], columns[1][first], _ahead(c, n, 2)[first]), {k: v[first] for k, v in zip(("x", "y", "own", "rest", "kind"), columns)})


def _merged(x: np.ndarray, y: np.ndarray, own: np.ndarray, other: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """The order of all suffixes of one range: the sampled ones by rank, the others by first letter and next rank, merged."""
    sampled, rest = np.flatnonzero(kind), np.flatnonzero(kind == 0)
    sampled = sampled[np.argsort(own[sampled], kind="stable")]
    rest = rest[np.lexsort((own[rest], x[rest]))]
    lo, hi = np.zeros(len(rest), np.int64), np.full(len(rest), len(sampled), np.int64)
    ax, ay, a1, a2 = x[rest], y[rest], own[rest], other[rest]
    for _ in range(int(len(sampled)).bit_length()):
        mid = np.minimum((lo + hi) // 2, max(0, len(sampled) - 1))
        s = sampled[mid]
        first = kind[s] == 1
        # place 1: its next suffix is sampled; place 2: the one after that
        less = (x[s] < ax) | ((x[s] == ax) & np.where(first, other[s] < a1, (y[s] < ay) | ((y[s] == ay) & (other[s] < a2))))
        open_ = lo < hi
        lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
    order = np.empty(len(x), np.int64)
    lo = np.maximum.accumulate(lo) if len(lo) else lo
    at = lo + np.arange(len(rest))
    taken = np.zeros(len(x), bool)
    taken[at] = True
    order[at] = rest
    order[~taken] = sampled
    return order


def _order_of(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    columns = [_unpack(table, k, U) for k in ("x", "y", "own", "rest", "kind")]
    return _merged(*columns), columns


def _ranks(table: pa.Table) -> pa.Table:
    """Ranks in the merged order; entries of several packs that are equal in all that decides share one."""
    order, columns = _order_of(table)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k, c in enumerate(columns):
        if k != 3:  # ``rest`` follows from the others
            new[1:] |= c[order][1:] != c[order][:-1]
    rank = np.empty(len(order), U)
    rank[order] = (U(table.column("bucket")[0].as_py() + 1) << U(40)) | np.cumsum(new).astype(U)
    return _back(table, rank)


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranks of all suffixes of a pack, letter by letter."""
    for batch in batches:
        for i, pack in enumerate(batch.column("pack").to_pylist()):
            c, n = _pack(batch, i)
            _, inverse = _distinct(_tuples(c, n, np.frombuffer(batch.column("ranks")[i].as_py(), U)))
            value = batch.column("value")[i].as_py()
            yield pa.RecordBatch.from_arrays([pa.array([pack], pa.int64()), pa.array([np.frombuffer(value, U)[inverse].tobytes() if value is not None else b""])], ["pack", "ranks"])


def _starts(batch: pa.RecordBatch, i: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places from which ``size`` words lie in one string: the words' hash, document and word number."""
    c, n = _pack(batch, i)
    h = window_hash(c, size)
    at = np.flatnonzero(whole(np.concatenate([[0], np.cumsum(n)]), size))
    doc = np.repeat(np.frombuffer(batch.column("docs")[i].as_py(), np.int64), n)[at]
    word = (_places(n) + np.repeat(np.frombuffer(batch.column("firsts")[i].as_py(), np.int32), n))[at]
    return at, h[at], doc, word


def _passages(batches: Iterator[pa.RecordBatch], ranges: _Ranges, size: int) -> Iterator[pa.RecordBatch]:
    """A pack's passages of ``size`` words, each once, with one of its suffixes and the least and greatest document that has it."""
    for batch in batches:
        for i, pack in enumerate(batch.column("pack").to_pylist()):
            c, n = _pack(batch, i)
            at, h, doc, _ = _starts(batch, i, size)
            first, inverse = _distinct([h])
            least, most = np.full(len(first), 2**63 - 1), np.full(len(first), -(2**63))
            np.minimum.at(least, inverse, doc)
            np.maximum.at(most, inverse, doc)
            chosen = at[first]
            columns = [v[chosen] for v in _tuples(c, n, np.frombuffer(batch.column("ranks")[i].as_py(), U))]
            yield _sent(pack, ranges.of(columns[0], columns[1], _ahead(c, n, 2)[chosen]), {**dict(zip(("x", "y", "own", "rest", "kind"), columns)), "start": h[first], "least": least, "most": most})


def _neighbours(table: pa.Table) -> pa.Table:
    """Passages that equal their neighbours in the array: the least and greatest document of all that are equal."""
    order, _ = _order_of(table)
    start, least, most = _unpack(table, "start", U)[order], _unpack(table, "least", np.int64)[order], _unpack(table, "most", np.int64)[order]
    first = np.flatnonzero(np.r_[True, start[1:] != start[:-1]][: len(start)])
    size = np.diff(np.append(first, len(start)))
    low, high = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    low[order] = np.repeat(np.minimum.reduceat(least, first), size)
    high[order] = np.repeat(np.maximum.reduceat(most, first), size)
    return _back(table, low, high)


def _found(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Runs of places whose passages more than one document has; ``cut``: not in the least of these documents."""
    for batch in batches:
        for i in range(batch.num_rows):
            if batch.column("value")[i].as_py() is None:
                continue
            _, h, doc, word = _starts(batch, i, size)
            _, inverse = _distinct([h])
            least, most = (np.frombuffer(batch.column(k)[i].as_py(), np.int64)[inverse] for k in ("value", "other"))
            found = least != most
            doc, word, cut = doc[found], word[found], doc[found] != least[found]
            by = np.lexsort((word, doc))
            doc, word, cut = doc[by], word[by], cut[by]
            # runs of places in a row travel as one
            new = np.r_[True, (doc[1:] != doc[:-1]) | (word[1:] > word[:-1] + 1) | (cut[1:] != cut[:-1])][: len(doc)]
            at = np.append(np.flatnonzero(new), len(doc))
            yield pa.RecordBatch.from_arrays([pa.array(doc[at[:-1]]), pa.array(word[at[:-1]].astype(np.int32)), pa.array(word[at[1:] - 1].astype(np.int32)), pa.array(cut[at[:-1]])], ["doc_id", "first", "last", "cut"])


def _array(text: DataFrame, tables: Tables, size: int, partitions: int) -> DataFrame:
    """Runs of places (doc_id, first, last, cut) at which passages begin that other documents hold too."""
    spark = text.sparkSession
    levels, ranges = [text], []
    k, stands = 0, 1  # words that a letter of this level stands for
    while stands < size:
        level = levels[k]
        total = (level.agg(F.sum(F.length("letters"))).first()[0] or 0) // 8
        buckets = int(max(partitions, total // RANGE))
        rows = level.mapInArrow(lambda b, every=max(61, total // (400 * buckets)): _sample(b, every), "x long, y long, z long").collect()
        r = spark.sparkContext.broadcast(_Ranges(rows, buckets))
        ranges.append(r)
        named = level.select("pack", "letters", "lengths").mapInArrow(lambda b, r=r: _triples(b, r.value), _kind("x", "y", "z")).groupBy("bucket").applyInArrow(_names, _BACK)
        both = level.select("pack", "letters", "lengths").join(_home(named), "pack", "left")
        levels.append(tables.write(f"level{k + 1}", both.mapInArrow(_children, "pack long, letters binary, lengths binary")))
        tables.tidy()
        k, stands = k + 1, 3 * stands
    ranks = levels[k].select("pack", F.col("letters").alias("ranks"))
    entry = ("x", "y", "own", "rest", "kind")
    for k in reversed(range(k)):
        level = levels[k].join(ranks, "pack")
        r = ranges[k]
        if k == 0:
            passages = level.mapInArrow(lambda b: _passages(b, r.value, size), _kind(*entry, "start", "least", "most"))
            home = _home(passages.groupBy("bucket").applyInArrow(_neighbours, _BACK))
            runs = tables.write("runs", text.join(home, "pack").mapInArrow(lambda b: _found(b, size), "doc_id long, first int, last int, cut boolean"))
            tables.drop("level1", "ranks1")
            return runs
        home = _home(level.mapInArrow(lambda b, r=r: _suffixes(b, r.value), _kind(*entry)).groupBy("bucket").applyInArrow(_ranks, _BACK))
        ranks = tables.write(f"ranks{k}", level.join(home, "pack", "left").mapInArrow(_ranked, "pack long, ranks binary"))
        tables.drop(f"level{k + 1}", f"ranks{k + 1}")
        tables.tidy()
    raise AssertionError


def _union(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Per document, from its runs: the passages that they cover, and the words of these that are to be cut."""
    for batch in batches:
        out = []
        for doc, runs in zip(batch.column("doc_id").to_pylist(), batch.column("runs").to_pylist()):
            runs.sort(key=lambda r: (r["first"], r["last"]))
            begin, end, cut, done = -1, -1, 0, 0
            for r in runs:
                a, z = r["first"], r["last"] + size
                if a > end:
                    if end >= 0:
                        out.append((doc, begin, end - begin, cut))
                    begin, end, cut = a, z, 0
                end = max(end, z)
                if r["cut"]:
                    cut += max(0, z - max(a, done))
                    done = max(done, z)
            if end >= 0:
                out.append((doc, begin, end - begin, cut))
        if out:
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.int32()) for c in columns[1:])], ["doc_id", "first_word", "words", "cut_words"])


def _runs(docs: DataFrame, size: int) -> DataFrame:
    """All documents' runs: doc_id, first, last (places of words from which ``size`` words repeat), cut."""
    spark = docs.sparkSession
    tables = Tables(spark)
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    corpus = text_id(docs).where("doc_id is not null and text is not null")
    prints = tables.write("prints", corpus.mapInArrow(lambda b: _prints(b, size), "doc_id long, same long, n_words int, prints array<long>, places array<int>"))
    equal = prints.groupBy("same", "n_words").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("most"))
    one = tables.write("equal", prints.select("doc_id", "same", "n_words").distinct().join(equal.where("rep != most"), ["same", "n_words"]).select("doc_id", "rep", "n_words"))
    copies = one.where("doc_id != rep").select("doc_id")
    left = prints.join(copies, "doc_id", "left_anti")
    each = left.select("doc_id", F.inline(F.arrays_zip(F.col("prints").alias("h"), F.col("places").alias("p")))).toDF("doc_id", "h", "p")
    often = each.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    places = tables.write("places", each.join(often, "h").groupBy("doc_id").agg(F.collect_list("p").alias("places")))
    region = corpus.dropDuplicates(["doc_id"]).join(places, "doc_id").select("text", "doc_id", "places")
    strings_ = tables.write("level0", region.mapInArrow(lambda b: _packs(b, size), "pack long, letters binary, lengths binary, docs binary, firsts binary"))
    tables.drop("prints", "places")
    tables.tidy()
    runs = _array(strings_, tables, size, buckets)
    tables.drop("level0")
    tables.tidy()
    # equal documents: each repeats from its first to its last place, and all but the least are cut
    same = one.select("doc_id", F.lit(0).alias("first"), (F.col("n_words") - size).alias("last"), (F.col("doc_id") != F.col("rep")).alias("cut"))
    return runs.unionByName(same)


def repeats(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """Passages of ``size`` words or more that more than one document holds: doc_id, first_word, words, cut_words.

    A row is a longest stretch of a document of which every word lies in such a passage (word numbers from 0). All occurrences are listed;
    ``cut_words`` counts the stretch's words that lie in a passage which a document with a lesser doc_id holds too, and that deduplication
    removes. Words are compared in lower case without punctuation.

    Null texts, texts of fewer than ``size`` words and rows with a null doc_id have none; a passage that repeats within one document alone isn't one.
    Of repeated rows of one doc_id one counts. Other columns are not read. An empty table gives no rows.
    """
    grouped = _runs(docs, size).groupBy("doc_id").agg(F.collect_list(F.struct("first", "last", "cut")).alias("runs"))
    return grouped.mapInArrow(lambda b: _union(b, size), _SPANS)


def _cut(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for i, runs in enumerate(batch.column("runs").to_pylist()):
            if not runs or texts[i] is None:
                continue
            data, offsets = raw(strings(pa.array([texts[i]])))
            start, end = word_spans(data, offsets)
            drop = np.zeros(len(data) + 1, np.int32)
            for r in runs:
                np.add.at(drop, [start[r["first"]], end[r["last"] + size - 1]], [1, -1])
            texts[i] = data[np.cumsum(drop[:-1]) == 0].tobytes().decode()
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *(batch.column(k) for k in range(1, batch.num_columns - 1))], names=batch.schema.names[:-1])


def dedup(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """The documents, all rows and columns kept, without the words that ``repeats`` counts as cut (and what stands between these)."""
    runs = _runs(docs, size).where("cut").groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    rest = [c for c in docs.columns if c != "text"]
    packed = docs.join(runs, docs["doc_id"].cast("long") == runs["__doc"], "left").select("text", F.struct(*[docs[c] for c in rest]).alias("rest"), "runs")
    out = packed.mapInArrow(lambda b: _cut(b, size), packed.select("text", "rest").schema)
    return out.select(*[F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns])
