"""Secret scanning: minimal automata of all whole rules, which advance together in one pass over the bytes of each text.

Where a rule occurs in a text, its own automata tell where matches begin and end. A private key goes on from the line that the rule matches
to its END line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.automaton import hits, last_end, scanner, walk
from pageloom.llm.shared import text_id
from pageloom.llm.tokens import raw, steps, strings

#: (name, pattern, ignore case), as SQL has them; ``EVERY`` is what is looked for.
RULES = (
    ("assigned_secret", r'(token|secret|password|passwd|api_key|apikey|access_key) *[=:] *"?[0-9A-Za-z_/+-]{16,}"?', True),
    ("aws_access_key", r"(AKIA|ASIA)[0-9A-Z]{16}", False),
    ("bearer_header", r"Bearer [0-9A-Za-z._~+/-]{20,}", False),
    ("github_token", r"gh[pousr]_[0-9A-Za-z]{36}", False),
    ("google_api_key", r"AIza[0-9A-Za-z_-]{16,}", False),
    ("json_web_token", r"eyJ[0-9A-Za-z_-]{10,}\.eyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}", False),
    ("private_key", r"-----BEGIN ([A-Z]+ )?PRIVATE KEY-----", False),
    ("slack_token", r"xox[baprs]-[0-9A-Za-z-]{10,}", False),
    ("url_password", r"[a-z]+://[^ \t\n:/@]+:[^ \t\n:/@]{3,}@", False),
)
_NAMES = "(token|secret|password|passwd|api_key|apikey|access_key)"
#: Patterns that also match what RULES' own pattern doesn't: quotes of either kind around name and value, other signs in a quoted value.
WIDER = {
    "assigned_secret": f"""("{_NAMES}"|'{_NAMES}'|{_NAMES}["']?) *[=:] *("[^"' \\t\\r\\n]{{16,}}"|'[^"' \\t\\r\\n]{{16,}}'|["']?[0-9A-Za-z_/+-]{{16,}}["']?)""",
}
EVERY = tuple((name, WIDER.get(name, pattern), fold) for name, pattern, fold in RULES)
_BREAK = rb"(?:\s|\\[rn])+"
#: What follows a match of the rule and belongs to it: a key as far as its END line; where that line is missing, the key's headers and lines.
TAILS = {
    "private_key": re.compile(
        rb"[^-]*(?:-{1,4}[^-]+)*-----END ([A-Z]+ )?PRIVATE KEY-----"
        rb"|(?:" + _BREAK + rb"(?:Proc-Type|DEK-Info):[^\r\n\\]*)*(?:" + _BREAK + rb"[0-9A-Za-z+/=]{40,})+(?:" + _BREAK + rb"[0-9A-Za-z+/=]+\s*\Z)?"
    ),
}
#: Bytes that advance through the automaton together.
STEP = 12 << 20
SCHEMA = "doc_id long, rule string, ordinal int, secret string"


def find(column: pa.Array, rules: tuple = EVERY, found_by: tuple | None = None) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """(row, rule, begin, end, bytes of all rows) of each match: per rule leftmost-longest, with its tail, not overlapping, in order."""
    machines, back, full = found_by or scanner(rules)
    for a, z in steps(column, STEP):
        data, offsets = raw(column.slice(a, z - a))
        for row, rule in sorted(set().union(*(hits(machine, data, offsets) for machine in machines))):
            least, limit = int(offsets[row]), int(offsets[row + 1])
            for begin in reversed(walk(back[rule], data, limit, least)):
                if begin >= least and (end := last_end(full[rule], data, begin, limit)) is not None:
                    least = end
                    if (tail := TAILS.get(rules[rule][0])) and (more := tail.match(data, least, limit)):
                        least = more.end()
                    yield a + row, rule, begin, least, data


def _scan(batches: Iterator[pa.RecordBatch], rules: tuple, found_by: tuple) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column("doc_id").to_pylist()
        out: list[tuple] = []
        before, n = None, 0
        for row, rule, begin, end, data in find(strings(batch.column("text")), rules, found_by):
            n = n + 1 if before == (row, rule) else 0
            before = (row, rule)
            out.append((keys[row], rules[rule][0], n, data[begin:end].tobytes().decode("utf-8", "replace")))
        if out:
            a, b, c, d = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b), pa.array(c, pa.int32()), pa.array(d)], ["doc_id", "rule", "ordinal", "secret"])


def scan(docs: DataFrame, rules: tuple = EVERY) -> DataFrame:
    """One row per match: doc_id, rule, its number among the rule's matches in the text (from 0), and the text matched.

    Matches of one rule don't overlap (leftmost, then longest); that of a private key is all of it, its END line too; different rules may match the same place. Null and empty texts match nothing; a null
    doc_id and repeated rows are scanned like others; other columns are not read; an empty table gives no rows. No exchange.
    """
    found_by = docs.sparkSession.sparkContext.broadcast(scanner(rules))  # compiled once, of a size that the rules alone decide
    return text_id(docs).mapInArrow(lambda batches: _scan(batches, rules, found_by.value), SCHEMA)


def _mask(batches: Iterator[pa.RecordBatch], rules: tuple, found_by: tuple) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(0)
        cuts: dict[int, list[tuple[int, int, int]]] = {}
        kept = strings(column)
        bounds = {}
        for a, z in steps(kept, STEP):
            _, offsets = raw(kept.slice(a, z - a))
            bounds.update((a + i, int(o)) for i, o in enumerate(offsets[:-1]))
        for row, rule, begin, end, _ in find(kept, rules, found_by):
            cuts.setdefault(row, []).append((begin - bounds[row], end - bounds[row], rule))
        texts = None
        if cuts:
            texts = column.to_pylist()
            for row, spans in cuts.items():
                text, out, at = texts[row].encode(), [], 0
                for begin, end, rule in sorted(spans, key=lambda x: (x[0], -x[1])):
                    if begin >= at:
                        out += [text[at:begin], f"[{rules[rule][0]}]".encode()]
                    at = max(at, end)
                texts[row] = b"".join([*out, text[at:]]).decode("utf-8", "replace")
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if texts is not None else column, *batch.columns[1:]], names=batch.schema.names)


def mask(docs: DataFrame, rules: tuple = EVERY) -> DataFrame:
    """The documents, all rows and columns kept, with each match in ``text`` replaced by its rule's name in brackets.

    Of overlapping matches the first counts, the rest of the others goes with it. A null text stays null, an empty one empty; repeated rows
    are masked each for itself; an empty table gives no rows. ``n_chars``, where present, is the new text's length.
    """
    rest = [c for c in docs.columns if c != "text"]
    packed = docs.select("text", F.struct(*rest).alias("rest")) if rest else docs
    fields = packed.schema
    found_by = docs.sparkSession.sparkContext.broadcast(scanner(rules))
    out = packed.mapInArrow(lambda batches: _mask(batches, rules, found_by.value), fields)
    if rest:
        out = out.select(*[F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns])
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return out
