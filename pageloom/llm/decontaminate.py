"""Benchmark decontamination with suffix arrays over the training texts.

Every partition of the corpus becomes shards, each with a suffix array over its words, sorted to the texts' ends by prefix doubling. All suffixes of all
benchmark items are searched in each by binary search; the matches are then extended to the longest verbatim runs. A document lies in one
shard, so neither finding nor removing documents needs an exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.shared import text_id
from pageloom.llm.tokens import steps, strings, words

#: A run of so many words counts as a leak.
MIN_WORDS = 13
#: An item with fewer words than that, but so many at least, is searched as a whole.
LEAST_WORDS = 8
#: Matches that are extended at a time.
PAIRS = 2_000_000
#: Words in one shard's suffix array.
SHARD_WORDS = 1_000_000
#: Characters of benchmark text that travel to the executors at once; a larger benchmark takes several passes.
CHUNK_CHARS = 32 << 20

SCHEMA = "doc_id long, item_id long, match_words int, doc_word int, item_word int"


class SuffixArray:
    """All suffixes of ``ids`` (0 ends a text; ``size`` ids at most), in order; a suffix ends with its text, equal ones are ordered by place."""

    def __init__(self, ids: np.ndarray, size: int) -> None:
        self.ids = ids
        self.bits = max(1, int(size).bit_length())
        self.per = max(1, 63 // self.bits)
        self.key = self._pack(ids)
        ends = np.flatnonzero(ids == 0)
        end = ends[np.searchsorted(ends, np.arange(len(ids)))] if len(ids) else ids
        at = np.argsort(self.key, kind="stable")
        key = self.key[at]
        new = np.r_[True, key[1:] != key[:-1]][: len(at)]
        rank = np.empty(len(ids), np.int64)
        rank[at] = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0)) if len(at) else at
        done = self.per
        tied = np.flatnonzero(~new | np.r_[~new[1:], False][: len(at)])
        while len(tied := tied[at[tied] + done <= end[at[tied]]]):  # the others are equal to their texts' ends
            who = at[tied]
            group, key = rank[who], rank[who + done]
            by = np.lexsort((who, key, group))
            at[tied], group, key = who[by], group[by], key[by]
            head = np.r_[True, (group[1:] != group[:-1]) | (key[1:] != key[:-1])]
            rank[at[tied]] = np.maximum.accumulate(np.where(head, tied, 0))
            tied = tied[~head | np.r_[~head[1:], False]]
            done *= 2
        self.at = at

    def _pack(self, ids: np.ndarray) -> np.ndarray:
        """The next words from each place as one number; nothing counts behind a text's end."""
        wide = np.concatenate([ids.astype(np.int64), np.zeros(self.per, np.int64)])
        key, open_ = np.zeros(len(ids), np.int64), np.ones(len(ids), bool)
        for k in range(self.per):
            word = np.where(open_, wide[k : k + len(ids)], 0)
            key = (key << self.bits) | word
            open_ &= word != 0
        return key

    def find(self, ids: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of the array that hold suffixes with the first ``depth`` words of ``ids`` from each of ``at``."""
        key = self._pack(ids)
        blocks = range(0, depth, self.per)
        over = [self.bits * max(0, d + self.per - depth) for d in blocks]  # words beyond the depth don't count
        wanted = [key[at + d] >> o for d, o in zip(blocks, over)]
        found = []
        for right in (False, True):
            lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(self.at), np.int64)
            while len(open_ := np.flatnonzero(lo < hi)):
                mid = (lo[open_] + hi[open_]) // 2
                place = self.at[mid]
                less = np.zeros(len(open_), bool)  # the array's suffix comes before the wanted place
                equal = np.arange(len(open_))
                for d, o, want in zip(blocks, over, wanted):
                    if not len(equal):
                        break
                    # a block that equals the wanted one holds no end, so the next one lies in the same text
                    have, want = self.key[place[equal] + d] >> o, want[open_[equal]]
                    less[equal] = have < want
                    equal = equal[have == want]
                if right:
                    less[equal] = True
                lo[open_] = np.where(less, mid + 1, lo[open_])
                hi[open_] = np.where(less, hi[open_], mid)
            found.append(lo)
        return found[0], found[1]


def _items(rows: list, min_words: int) -> tuple:
    """Word hashes of all items (0 after each), the item and word number of each place, and by number of words to look for the places that
    start a test suffix."""
    column = strings(pa.array([r["text"] for r in rows], pa.string()))
    h, item, number, size = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, z in steps(column):
        w = words(column.slice(a, z - a))
        count = np.diff(w.ptr)
        h.append(np.insert(w.hash, w.ptr[1:], 0))
        item.append(np.repeat(np.array([r["doc_id"] for r in rows[a:z]], np.int64), count + 1))
        number += [np.arange(c + 1) for c in count]
        size.append(np.repeat(count, count + 1))
    number, size = np.concatenate(number), np.concatenate(size)
    starts = {min_words: np.flatnonzero(size - number >= min_words)}
    for n in range(LEAST_WORDS, min_words):
        starts[n] = np.flatnonzero((size == n) & (number == 0))
    return np.concatenate(h), np.concatenate(item), number, {n: at for n, at in starts.items() if len(at)}


def _search(h: np.ndarray, items: tuple) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places of items, places of the shard, numbers of words) of all longest runs, some at a time."""
    th, _, _, starts = items
    vocabulary = pa.array(h).dictionary_encode()
    table = vocabulary.dictionary
    ids = vocabulary.indices.to_numpy().astype(np.int32) + 1
    ids[h == 0] = 0
    tids = pc.index_in(pa.array(th), value_set=table)
    tids = pc.fill_null(tids, -1).to_numpy().astype(np.int64) + 1
    unknown = tids == 0
    tids[th == 0] = 0
    missing = np.concatenate([[0], np.cumsum(unknown)])
    array = None
    for depth, start in starts.items():
        start = start[missing[start + depth] == missing[start]]  # a word that the shard lacks can't match
        if not len(start) or not len(ids):
            continue
        array = array or SuffixArray(ids, len(table) + 1)
        lo, hi = array.find(tids, start, depth)
        total = np.concatenate([[0], np.cumsum(hi - lo)])
        for begin in range(0, int(total[-1]), PAIRS):
            pair = np.arange(begin, min(begin + PAIRS, int(total[-1])))
            of = np.searchsorted(total, pair, "right") - 1
            left, right = start[of], array.at[lo[of] + pair - total[of]]
            # a match that could begin a word earlier is part of a longer one
            earlier = (left > 0) & (right > 0)
            earlier[earlier] = (tids[left[earlier] - 1] == ids[right[earlier] - 1]) & (tids[left[earlier] - 1] > 0)
            left, right = left[~earlier], right[~earlier]
            size = np.full(len(left), depth)
            open_ = np.arange(len(left))
            while len(open_):
                a, b = left[open_] + size[open_], right[open_] + size[open_]
                open_ = open_[(tids[a] == ids[b]) & (tids[a] > 0)]
                size[open_] += 1
            if len(left):
                yield left, right, size


def _shards(batches: Iterator[pa.RecordBatch], shard_words: int) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray, np.ndarray]]:
    """Rows in groups of about ``shard_words`` words: the rows, and of each word (and each text's end, 0) hash, row and number."""
    rows: list[pa.RecordBatch] = []
    held: list[tuple] = []
    count = docs = 0
    for batch in batches:
        column = strings(batch.column("text"))
        for a, z in steps(column):
            w = words(column.slice(a, z - a))
            sizes = np.diff(w.ptr)
            h = np.insert(w.hash, w.ptr[1:], 0)
            number = np.arange(len(h)) - np.repeat(w.ptr[:-1] + np.arange(z - a), sizes + 1)
            held.append((h, np.repeat(np.arange(docs, docs + z - a), sizes + 1), number))
            rows.append(batch.slice(a, z - a))
            count, docs = count + len(h), docs + z - a
            if count >= shard_words:
                yield rows, *(np.concatenate(x) for x in zip(*held))
                rows, held, count, docs = [], [], 0, 0
    if rows:
        yield rows, *(np.concatenate(x) for x in zip(*held))


def _scan(batches: Iterator[pa.RecordBatch], items: tuple, shard_words: int) -> Iterator[pa.RecordBatch]:
    for rows, h, doc, number in _shards(batches, shard_words):
        ids = np.concatenate([r.column("doc_id").to_numpy(zero_copy_only=False) for r in rows])
        for left, right, size in _search(h, items):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[doc[right]], pa.int64()), pa.array(items[1][left]), pa.array(size, pa.int32()), pa.array(number[right], pa.int32()), pa.array(items[2][left], pa.int32())],
                ["doc_id", "item_id", "match_words", "doc_word", "item_word"],
            )


def _keep(batches: Iterator[pa.RecordBatch], items: tuple, shard_words: int) -> Iterator[pa.RecordBatch]:
    """The rows without a match."""
    for rows, h, doc, _ in _shards(batches, shard_words):
        good = np.ones(sum(r.num_rows for r in rows), bool)
        for _, right, _ in _search(h, items):
            good[doc[right]] = False
        at = 0
        for r in rows:
            yield r.filter(pa.array(good[at : at + r.num_rows]))
            at += r.num_rows


def _pieces(benchmark: DataFrame, min_words: int, chunk_chars: int) -> Iterator:
    """The benchmark in pieces of about ``chunk_chars`` characters at most, each as a broadcast."""
    tests = text_id(benchmark, "item_id").where("doc_id is not null and text is not null")
    size = tests.agg(F.sum(F.length("text"))).first()[0] or 0
    pieces = max(1, -(-size // chunk_chars))
    for k in range(pieces):
        rows = tests.where(F.pmod(F.xxhash64("doc_id"), F.lit(pieces)) == k).collect() if pieces > 1 else tests.collect()
        if rows:
            yield benchmark.sparkSession.sparkContext.broadcast(_items(rows, min_words))


def leaks(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, chunk_chars: int = CHUNK_CHARS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per longest verbatim run of ``min_words`` or more words that a document and a benchmark item have in common: doc_id, item_id,
    match_words, and where it begins in either (word number from 0).

    A run is longest if it can't be extended on either side; all places are given. Of an item with fewer than ``min_words`` words, but ``LEAST_WORDS`` at
    least, the whole is searched. Words are compared in lower case without punctuation.

    Null or empty texts, and shorter items, match nothing; rows whose doc_id or item_id is null are not searched. Of repeated rows of one doc_id each is
    searched, and the same run counts once. Other columns are not read. Empty tables give no rows. The benchmark travels to the executors in
    pieces of about ``chunk_chars`` characters, each with its own pass over the corpus, so its size isn't limited.
    """
    corpus = text_id(docs).where("doc_id is not null and text is not null")
    out = docs.sparkSession.createDataFrame([], SCHEMA)
    for k, sent in enumerate(_pieces(benchmark, min_words, chunk_chars)):
        found = corpus.mapInArrow(lambda batches, sent=sent: _scan(batches, sent.value, shard_words), SCHEMA)
        out = out.unionAll(found) if k else found
    return out.distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, chunk_chars: int = CHUNK_CHARS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The documents, all columns kept, without those in which ``leaks`` finds a run; rows with a null doc_id are searched too.

    Each row is judged by its own text: repeated rows share their fate, null and empty texts stay. An empty benchmark removes nothing, an empty
    table gives no rows. No exchange.
    """
    out = docs
    rest = [c for c in docs.columns if c != "text"]
    for sent in _pieces(benchmark, min_words, chunk_chars):
        packed = out.select("text", F.struct(*rest).alias("rest")) if rest else out
        out = packed.mapInArrow(lambda batches, sent=sent: _keep(batches, sent.value, shard_words), packed.schema)
        out = out.select(*[F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns]) if rest else out
    return out
