"""Language identification of documents that may mix languages.

A byte n-gram model per language gives each word a likelihood under each language. Expectation-maximisation over a
document's words estimates the languages' proportions; of the nested sets of its most frequent languages, the one with the best penalised
likelihood is selected. A document that no set of languages explains better than random letters is rejected, and so is one of which runs of
signs, a component of the mixture that no language explains, take too large a share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.shared import text_id
from pageloom.llm.tokens import IS_WORD, raw, spans, steps, strings

#: Labelled documents per language that the models are fitted on (about; chosen by a hash of doc_id).
SAMPLE = 400
#: Bytes of an n-gram: the last one is predicted from those before it.
ORDER = 4
BITS = 18
ROUNDS = 20
#: A further language must add this many times half the logarithm of the number of words (1: the Bayesian information criterion).
PENALTY = 4.0
#: Log-likelihood per byte of a word under random letters.
RANDOM = float(np.log(1 / 40))
#: Share of a document's bytes (without blanks) that runs of two or more signs may take, and bytes of such runs that any document may have.
NOISE, FREE = 0.2, 8
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_SIGN = ~(IS_WORD | _BLANK)
LETTERS = IS_WORD & ~np.isin(np.arange(256), [*range(48, 58), 95])

SCHEMA = "doc_id long, languages array<string>, shares array<double>, gain double, accepted boolean"


@dataclass(frozen=True)
class Model:
    names: tuple[str, ...]
    scores: np.ndarray  # [language, n-gram slot]: log-probability of the last byte


def _slots(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of letters, lower-cased) of all texts: for each byte the slot of the n-gram that ends there and that of its
    context; each word's first byte, the byte after it (a blank, which counts), and offsets of words by text.

    What lies before a word reads as blank.
    """
    data, offsets = raw(pc.utf8_lower(column))
    start, end = spans(data, offsets, LETTERS)
    ptr = np.searchsorted(start, offsets).astype(np.int64)
    gap = np.repeat(np.arange(len(column)), np.diff(ptr))  # a blank is put in after every text
    d = np.zeros(len(data) + len(column), np.uint32)
    d[np.arange(len(data)) + np.repeat(np.arange(len(column)), np.diff(offsets))] = np.where(LETTERS[data], data, 0)
    context, before = np.zeros(len(d), np.uint32), d
    for k in range(1, ORDER):
        earlier = np.zeros(len(d), np.uint32)
        earlier[k:] = d[:-k]
        before = earlier if k == 1 else np.where(before == 0, np.uint32(0), earlier)
        context |= before << np.uint32(8 * k)
    shift = np.uint32(32 - BITS)
    slot = ((context | d) * np.uint32(0x9E3779B1) ^ (d << np.uint32(5)) * np.uint32(0x85EBCA6B)) >> shift
    return slot.astype(np.int32), ((context >> np.uint32(3)) * np.uint32(0xC2B2AE35) >> shift).astype(np.int32), start + gap, end + gap, ptr


def fit(rows: list[tuple[str, str]]) -> Model:
    """Models from (language, text); each log-probability is smoothed towards the languages' common one."""
    names = tuple(sorted({name for name, _ in rows}))
    grams, contexts = np.zeros((1 << BITS, len(names))), np.zeros((1 << BITS, len(names)))
    # a slot's context isn't known from the slot: keep the one that it was last seen with
    seen = np.zeros(1 << BITS, np.int64)
    for k, name in enumerate(names):
        column = strings(pa.array([t for n, t in rows if n == name]))
        for a, z in steps(column):
            slot, context, start, end, _ = _slots(column.slice(a, z - a))
            inside = np.zeros(len(slot) + 1, np.int32)
            np.add.at(inside, start, 1)
            np.add.at(inside, end + 1, -1)
            at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
            slot, context = slot[at], context[at]
            grams[:, k] += np.bincount(slot, minlength=1 << BITS)
            contexts[:, k] += np.bincount(context, minlength=1 << BITS)
            seen[slot] = context
    base = 1 / 40
    scores = np.log((grams + 1.0 * base) / (contexts[seen] + 1.0))
    scores[grams.sum(axis=1) == 0] = np.log(base / 4)
    return Model(names, np.ascontiguousarray(scores.T, np.float32))


def sample(docs: DataFrame, per_language: int = SAMPLE) -> list[tuple[str, str]]:
    """About ``per_language`` labelled documents of each language, chosen by a hash of doc_id."""
    known = docs.where("lang is not null and text is not null and doc_id is not null")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    point = F.xxhash64(F.col("doc_id").cast("long"), F.lit("language-model"))
    chosen = None
    for lang, n in counts.items():
        part = (F.col("lang") == lang) & (point <= min(2**63 - 1, int(-(2**63) + min(1.0, per_language / n) * 2**64)))
        chosen = part if chosen is None else chosen | part
    return [(r["lang"], r["text"]) for r in known.where(chosen).select("lang", "text", "doc_id").collect()]


def _mixture(x: np.ndarray, allowed: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions [doc, language] and log-likelihood by EM; ``x`` is [language, word] likelihoods scaled by each word's greatest.

    Every document has words. A document is done when no share moves by 0.001 any more.
    """
    result = allowed / allowed.sum(axis=1, keepdims=True)
    who, shares, part, at = np.arange(len(result)), result, x, ptr
    for r in range(ROUNDS):
        count = np.diff(at)
        weighted = part * np.repeat(shares.T.astype(np.float32), count, axis=1)
        weighted /= np.maximum(weighted.sum(axis=0), 1e-30)
        new = np.add.reduceat(weighted, at[:-1], axis=1).T.astype(np.float64) / count[:, None]
        moving = np.abs(new - shares).max(axis=1) >= 1e-3
        result[who] = new
        if not moving.any():
            break
        if moving.mean() < 0.7:
            kept = np.repeat(moving, count)
            who, new, part = who[moving], new[moving], part[:, kept]
            at = np.concatenate([[0], np.cumsum(count[moving])])
        shares = new
    value = (x * np.repeat(result.T.astype(np.float32), np.diff(ptr), axis=1)).sum(axis=0)
    return result, np.add.reduceat(np.log(np.maximum(value, 1e-30)), ptr[:-1], dtype=np.float64)


def infer(column: pa.Array, model: Model, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: shares [text, language] of the selected languages (0 elsewhere), gain in log-likelihood over random letters, accepted."""
    n, k = len(column), len(model.names)
    clear = noise(column) <= NOISE
    slot, _, start, end, ptr = _slots(column)
    shares, gain, accept = np.zeros((n, k)), np.zeros(n), np.zeros(n, bool)
    if not len(start) or not k:
        return shares, gain, accept
    edges = np.column_stack([start, end + 1]).reshape(-1)
    slot = np.append(slot, 0)
    likely = np.stack([np.add.reduceat(score[slot], edges)[::2] for score in model.scores])
    top = likely.max(axis=0)
    x = np.exp(likely - top)
    has = np.flatnonzero(np.diff(ptr))
    begin = np.append(ptr[has], ptr[-1])
    count = np.diff(begin)
    each = np.add.reduceat(likely, begin[:-1], axis=1, dtype=np.float64).T
    scale = np.add.reduceat(top, begin[:-1], dtype=np.float64)
    size = np.add.reduceat((end - start + 1).astype(np.float64), begin[:-1])
    cost = penalty * 0.5 * np.log(np.maximum(count, 2))
    every, all_likely = _mixture(x, np.ones((len(has), k)), begin)
    best = each.argmax(axis=1)
    some = np.zeros((len(has), k))
    some[np.arange(len(has)), best] = 1.0
    value = each[np.arange(len(has)), best] - cost
    order = np.argsort(-every, axis=1, kind="stable")
    for m in range(2, k + 1):  # of the nested sets of the most frequent languages
        could = np.flatnonzero(all_likely + scale - m * cost > value)
        if not len(could):
            break
        allowed = np.zeros((len(could), k))
        np.put_along_axis(allowed, order[could, :m], 1.0, axis=1)
        rows = np.repeat(begin[could], count[could])
        ends = np.concatenate([[0], np.cumsum(count[could])])
        rows += np.arange(ends[-1]) - np.repeat(ends[:-1], count[could])
        found, lik = _mixture(x[:, rows], allowed, ends)
        total = lik + scale[could] - m * cost[could]
        better = total > value[could]
        value[could[better]] = total[better]
        some[could[better]] = found[better]
    shares[has], gain[has] = some, value - size * RANDOM
    accept[has] = (gain[has] > 0) & clear[has]
    return shares, gain, accept


def noise(column: pa.Array) -> np.ndarray:
    """Per text the bytes in runs of two or more signs beyond ``FREE``, as a share of all bytes but blanks (0 for a text without any)."""
    data, offsets = raw(column)
    start, end = spans(data, offsets, _SIGN)
    long = end - start > 1
    upto = np.concatenate([[0], np.cumsum((end - start) * long)])
    runs = upto[np.searchsorted(start, offsets)]
    full = np.concatenate([[0], np.cumsum(~_BLANK[data])])[offsets]
    return np.maximum(np.diff(runs) - FREE, 0) / np.maximum(np.diff(full), 1)


def _scan(batches: Iterator[pa.RecordBatch], model: Model, penalty: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = strings(batch.column("text"))
        for a, z in steps(column):
            shares, gain, accepted = infer(column.slice(a, z - a), model, penalty)
            languages, parts = [], []
            for row, yes in zip(shares, accepted):
                chosen = [int(i) for i in np.argsort(-row, kind="stable") if row[i] > 0] if yes else []
                languages.append([model.names[i] for i in chosen])
                parts.append([round(float(row[i]), 6) for i in chosen])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, z - a), pa.array(languages, pa.list_(pa.string())), pa.array(parts, pa.list_(pa.float64())), pa.array(gain), pa.array(accepted)],
                ["doc_id", "languages", "shares", "gain", "accepted"],
            )


def identify(docs: DataFrame, model: Model | None = None, penalty: float = PENALTY) -> DataFrame:
    """One row per document: its languages, most frequent first, their shares of its words, and whether it is accepted.

    ``gain`` is the penalised log-likelihood less that of random letters. A document is rejected, with no languages, where it isn't above 0 (null and
    empty texts and those without a word of letters too), and where ``noise`` is above ``NOISE``. Ties between languages go to the first by name. Without a model,
    one is fitted on ``sample(docs)``; where no row has a language, every document is rejected. A null doc_id and repeated
    rows are treated like others; other columns are not read. No exchange but the count of labels.
    """
    model = model or fit(sample(docs))
    return text_id(docs).mapInArrow(lambda batches: _scan(batches, model, penalty), SCHEMA)


def _accept(batches: Iterator[pa.RecordBatch], model: Model, penalty: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = strings(batch.column("text"))
        keep = np.concatenate([np.zeros(0, bool), *(infer(column.slice(a, z - a), model, penalty)[2] for a, z in steps(column))])
        yield batch.filter(pa.array(keep))


def accepted(docs: DataFrame, model: Model | None = None, penalty: float = PENALTY) -> DataFrame:
    """The documents that ``identify`` accepts, all columns kept. Null and empty texts go; repeated rows, and rows with a null doc_id, are judged
    each for itself; an empty table gives no rows."""
    model = model or fit(sample(docs))
    rest = [c for c in docs.columns if c != "text"]
    packed = docs.select("text", F.struct(*rest).alias("rest")) if rest else docs
    out = packed.mapInArrow(lambda batches: _accept(batches, model, penalty), packed.schema)
    return out.select(*[F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns]) if rest else out
