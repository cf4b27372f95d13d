"""Each operator against brute force, SQL or held-out truth, and over awkward rows."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pageloom.llm import automaton, chat, decontaminate, embedding, jaccard, language, licenses, mixing, pii, secrets, suffix
from pageloom.llm.tokens import words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, copy int, rest string, bucket int, rule string, label string"
RNG = np.random.default_rng(3)
VOCABULARY = ["".join(RNG.choice(list("abcdefghijklmnop"), int(RNG.integers(2, 8)))) for _ in range(300)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY, n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), 7, "r", 1, "x", "y") for i, t, lang, s in rows], DOCS)


LONG = prose(30_000)
AWKWARD = [(1, None, "en", "a"), (2, "", None, None), (3, LONG, "en", "a"), (3, LONG, "en", "a"), (None, "some words here", None, "b"), (4, "12 34 ... !!", "en", "b"), (5, "é日本 ß", "de", "a"), (6, "x", "en", None)]
EVERY = {
    "leaks": lambda d: decontaminate.leaks(d, d.select(F.col("doc_id").alias("item_id"), F.substring("text", 1, 500).alias("text"))),
    "decontaminate": lambda d: decontaminate.decontaminate(d, d.select(F.col("doc_id").alias("item_id"), "text")),
    "repeats": suffix.repeats,
    "suffix_dedup": suffix.dedup,
    "pii": lambda d: pii.scan(d, MODEL),
    "licenses": licenses.scan,
    "secrets": secrets.scan,
    "mask": secrets.mask,
    "language": language.identify,
    "accepted": language.accepted,
    "jaccard": jaccard.join,
    "jaccard_dedup": jaccard.dedup,
    "mix": mixing.mix,
}
MODEL = pii.fit()


@pytest.mark.parametrize("name", EVERY)
def test_awkward_and_empty(spark, name):
    docs = table(spark, AWKWARD)
    rows = EVERY[name](docs).collect()
    assert EVERY[name](docs.limit(0)).collect() == []
    kept = [r["doc_id"] for r in rows]
    if name in ("mask", "suffix_dedup"):
        assert len(rows) == len(AWKWARD) and rows[0].asDict().keys() == docs.first().asDict().keys()
    if name == "jaccard":
        assert {tuple(r) for r in rows} == {(i, i, 0) for i in range(1, 7)}
    if name == "jaccard_dedup":
        assert len(rows) == len(AWKWARD)
    if name == "leaks":
        assert set(kept) == {3}
    if name == "decontaminate":
        assert 3 not in kept and len(rows) == len(AWKWARD) - 2
    if name == "language":
        assert len(rows) == len(AWKWARD) and not any(r["accepted"] for r in rows if r["doc_id"] in (1, 2, 4))
    if name == "accepted":
        assert set(rows[0].asDict()) == set(docs.columns) and not {1, 2, 4} & set(kept)
    if name == "mix":
        assert all(r["copy"] >= 0 for r in rows)


def grams(text, n):
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def near_copies(count, rng):
    """Texts in groups of near and equal copies."""
    out = []
    while len(out) < count:
        base = prose(int(rng.integers(1, 120)), rng).split()
        for _ in range(int(rng.integers(1, 7))):
            own = list(base)
            for _ in range(int(rng.integers(0, 1 + len(own) // 8))):
                own[int(rng.integers(0, len(own)))] = str(rng.choice(VOCABULARY))
            out.append(" ".join(own))
    return out[:count]


def linked(sets, threshold):
    """(class, links) of each set by brute force."""
    near = [[j for j, y in enumerate(sets) if j != i and x and y and len(x & y) / len(x | y) >= threshold] for i, x in enumerate(sets)]
    group = list(range(len(sets)))
    for _ in sets:
        for i, others in enumerate(near):
            for j in others:
                group[i] = group[j] = min(group[i], group[j])
    return {i: (group[i], len(near[i])) for i in range(len(sets))}


@pytest.mark.parametrize("threshold,hot", [(jaccard.THRESHOLD, jaccard.HOT), (0.8, 3), (0.3, 5), (1.0, 4)])
def test_jaccard_against_brute_force(spark, threshold, hot):
    rng = np.random.default_rng(11)
    texts = near_copies(130, rng) + ["same words here"] * 4 + ["one", "one", "two words", ""]
    base = prose(200, rng).split()
    for i in range(30):  # a family whose members differ by a few words, and a second one on the verge of it
        own = list(base)
        for k in range(i % 7):
            own[int(rng.integers(0, 200))] = f"new{i}{k}"
        if i > 20:
            own[:35] = [f"far{k}" for k in range(35)]
        texts.append(" ".join(own))
    docs = table(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    want = linked([grams(t, jaccard.N) for t in texts], threshold)
    assert {r["doc_id"]: (r["class_id"], r["links"]) for r in jaccard.join(docs, jaccard.N, threshold, hot).collect()} == want
    if threshold == jaccard.THRESHOLD:
        assert sorted(r["doc_id"] for r in jaccard.dedup(docs).collect()) == sorted(i for i, (g, _) in want.items() if i == g)


def test_suffix_repeats_against_brute_force(spark):
    rng = np.random.default_rng(5)
    shared = [prose(60, rng) for _ in range(3)]
    texts = [f"{prose(int(rng.integers(5, 80)), rng)} {shared[i % 3] if i % 4 else ''} {prose(int(rng.integers(5, 80)), rng)}" for i in range(24)] + [shared[0] + " " + shared[0]]
    size = 20
    first, most = {}, {}
    for i, t in enumerate(texts):
        for g in grams(t, size):
            first[g], most[g] = min(first.get(g, i), i), i
    want = set()
    for i, t in enumerate(texts):
        w = t.split()
        cover, cut = np.zeros(len(w), bool), np.zeros(len(w), bool)
        for p in range(len(w) - size + 1):
            g = tuple(w[p : p + size])
            if first[g] != most[g]:
                cover[p : p + size] = True
                if first[g] != i:
                    cut[p : p + size] = True
        p = 0
        while p < len(w):
            if cover[p]:
                q = p
                while q < len(w) and cover[q]:
                    q += 1
                want.add((i, p, q - p, int(cut[p:q].sum())))
                p = q
            p += 1
    docs = table(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    assert {tuple(r) for r in suffix.repeats(docs, size).collect()} == want
    for r in suffix.dedup(docs, size).collect():
        n = sum(c for i, _, _, c in want if i == r["doc_id"])
        assert len(r["text"].split()) == len(texts[r["doc_id"]].split()) - n


def runs_in_common(x, y, least, short):
    """All (words, place in x, place in y) of longest runs of ``least`` words, or of the whole of a shorter ``y``."""
    out = set()
    for p, q in itertools.product(range(len(x)), range(len(y))):
        if x[p] == y[q] and not (p and q and x[p - 1] == y[q - 1]):
            n = 0
            while p + n < len(x) and q + n < len(y) and x[p + n] == y[q + n]:
                n += 1
            if n >= least or (short <= n == len(y)):
                out.add((n, p, q))
    return out


def test_leaks_against_brute_force(spark):
    rng = np.random.default_rng(8)
    items = [prose(int(rng.integers(8, 60)), rng) for _ in range(12)] + [prose(9, rng), "a b " * 12]
    texts = [f"{prose(20, rng)} {' '.join(items[i % 14].split()[i % 5 :])} {prose(10, rng)}" for i in range(30)]
    texts += [f"{items[0]} x {items[0]}", f"{items[12]} and {items[12]}", "a b " * 20, items[3] + " " + prose(900, rng), items[3] + " " + prose(900, rng)]
    texts.append(texts[-1])
    want = {(i, k, *run) for (i, t), (k, b) in itertools.product(enumerate(texts), enumerate(items)) for run in runs_in_common(t.split(), b.split(), decontaminate.MIN_WORDS, decontaminate.LEAST_WORDS)}
    docs = table(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {tuple(r) for r in decontaminate.leaks(docs, bench).collect()} == want
    assert {tuple(r) for r in decontaminate.leaks(docs, bench, chunk_chars=600, shard_words=500).collect()} == want
    for kept in (decontaminate.decontaminate(docs, bench), decontaminate.decontaminate(docs, bench, chunk_chars=600, shard_words=500)):
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(range(len(texts))) - {x[0] for x in want})


def test_suffix_array_is_sorted_to_the_end():
    rng = np.random.default_rng(2)
    part = [rng.integers(1, 4, int(rng.integers(0, 60))).tolist() for _ in range(40)]
    ids = np.array([x for t in part + part[:9] + [[1] * 70] for x in [*t, 0]], np.int32)
    for size in (4, 2**20, 2**40):
        array = decontaminate.SuffixArray(ids, size)
        key = [(ids[p : p + list(ids[p:]).index(0)].tolist(), p) for p in range(len(ids))]
        assert array.at.tolist() == sorted(range(len(ids)), key=lambda p: key[p])


def test_automaton_against_re():
    import re

    for pattern in ("a(b|c)*d", "[0-9]{2,4}x", "ab?c+", "(foo|fo)o"):
        machine = automaton.build([automaton.parse(pattern)], False)
        for text in ("abcbcd", "123x", "acc", "fooo", "x", "12345x"):
            data = np.frombuffer(text.encode(), np.uint8)
            ends = automaton.walk(machine, data, 0, len(data))
            m = [k for k in range(1, len(text) + 1) if re.fullmatch(pattern, text[:k])]
            assert ends == m, (pattern, text)


def test_secrets_mask(spark):
    docs = table(spark, [(1, "key AKIA" + "A" * 16 + " end", "en", "a"), (2, "plain", "en", "a")])
    assert [tuple(r)[1:3] for r in secrets.scan(docs).collect()] == [("aws_access_key", 0)]
    rows = {r["doc_id"]: r for r in secrets.mask(docs).collect()}
    assert rows[1]["text"] == "key [aws_access_key] end" and rows[1]["n_chars"] == len(rows[1]["text"]) and rows[2]["text"] == "plain"


def test_language_held_out(spark):
    rng = np.random.default_rng(2)
    speech = {"aa": [f"{x}{y}" for x in "bcdfg" for y in ("anto", "ello", "iro")], "bb": [f"{x}{y}" for x in ("sch", "pf", "k") for y in ("ung", "eit", "ach")]}
    rows = [(i, " ".join(rng.choice(speech[lang], 40)), lang) for i, lang in enumerate(["aa", "bb"] * 40)]
    model = language.fit([(lang, t) for _, t, lang in rows[:60]])
    held = pa.array([t for _, t, _ in rows[60:]] + [" ".join([*rng.choice(speech["aa"], 60), *rng.choice(speech["bb"], 30)]), "@@ 11 22"])
    shares, _, accepted = language.infer(held, model)
    assert all(model.names[s.argmax()] == lang and (s > 0).sum() == 1 for s, (_, _, lang) in zip(shares, rows[60:]))
    assert abs(shares[-2][0] - 2 / 3) < 0.08 and accepted[:-1].all() and not accepted[-1]


def test_language_against_brute_force():
    """Likelihoods by a loop over bytes, shares by a grid over all mixtures, sets by comparing all of them."""
    rng = np.random.default_rng(21)
    speech = {"aa": ["banto", "cello", "diro", "fanto", "gello"], "bb": ["schung", "pfeit", "kach", "pfung"], "cc": ["zoum", "yax", "woux", "vym"]}
    model = language.fit([(lang, " ".join(rng.choice(w, 30))) for lang, w in speech.items() for _ in range(10)])
    texts = [" ".join(rng.choice(speech[x]) for x in rng.permutation(np.repeat(["aa", "bb", "cc"], counts))) for counts in ((9, 0, 0), (0, 7, 0), (12, 12, 0), (20, 0, 10), (8, 8, 8), (1, 0, 15))]
    grid = np.array([(a, b, 100 - a - b) for a in range(101) for b in range(101 - a)]) / 100
    shares, gain, accepted = language.infer(pa.array(texts), model)
    for text, got, value in zip(texts, shares, gain):
        words_ = text.split()
        like = np.zeros((len(words_), 3))
        size = 0
        for i, w in enumerate(words_):
            padded = b"\0" * (language.ORDER - 1) + w.encode() + b"\0"
            size += len(w) + 1
            for p in range(language.ORDER - 1, len(padded)):
                d = padded[p]
                before = [padded[p - k] for k in range(1, language.ORDER)]
                while 0 in before and any(before[before.index(0) :]):
                    before = before[: before.index(0)] + [0] * (len(before) - before.index(0))
                context = sum(c << 8 * (k + 1) for k, c in enumerate(before))
                slot = (((context | d) * 0x9E3779B1 & 0xFFFFFFFF) ^ ((d << 5) * 0x85EBCA6B & 0xFFFFFFFF)) >> (32 - language.BITS)
                like[i] += model.scores[:, slot]
        cost = language.PENALTY * 0.5 * np.log(len(words_))
        total = np.log(np.exp(like) @ grid.T).sum(axis=0) - cost * (grid > 0).sum(axis=1)
        best = grid[total.argmax()]
        assert ((got > 0) == (best > 0)).all() and np.abs(got - best).max() < 0.02
        assert abs(value - (total.max() - size * language.RANDOM)) < 0.1
    assert accepted.all()


def test_language_rejects_noise(spark):
    rng = np.random.default_rng(3)
    model = language.fit([("aa", " ".join(rng.choice(["banto", "cello", "diro"], 40)))])
    clean = " ".join(rng.choice(["banto", "cello", "diro,", "fanto."], 60))
    texts = [clean, " ".join(f"{w}!!" for w in clean.split()), " ".join(f"{w}%%%" for w in clean.split()), " | ".join(clean.split()), "Diro...", clean + " !!! ???", clean + " " + "#" * 5000, "", "!!!!", "*" * 300_000]
    assert language.infer(pa.array(texts), model)[2].tolist() == [True, False, False, True, True, True, False, False, False, False]
    docs = table(spark, [(i, t, "aa", "s") for i, t in enumerate(texts)])
    assert sorted(r["doc_id"] for r in language.accepted(docs, model).collect()) == [0, 3, 4, 5]


def test_pii_finds_and_spreads():
    text = "mail bob.12@site.example.com or +1 (017) 555-7713 soon and later 0175557713 too; card 4785380592391139 then 192.168.10.7 and 123-45-6789 but 1234 v1.2 2024-01-02 stay"
    found = {(label, value.decode()) for _, label, _, _, value in pii.entities(pa.array([text]), MODEL)}
    assert {("EMAIL", "bob.12@site.example.com"), ("PHONE", "+1 (017) 555-7713"), ("CARD", "4785380592391139"), ("IP", "192.168.10.7"), ("SSN", "123-45-6789")} <= found
    assert not {"1234", "v1.2", "2024-01-02"} & {v for _, v in found}
    held = pii.lines(200, seed=77)
    right = total = 0
    for line, row in held:
        spans = [(b, e) for _, _, b, e, _ in pii.entities(pa.array([line]), MODEL)]
        at = 0
        for token, label in row:
            inside = any(b < at + len(token) and at < e for b, e in spans)
            total, right = total + 1, right + (inside == bool(label))
            at += len(token) + 1
    assert right / total > 0.97


def test_pii_messages_against_enumeration():
    rng = np.random.default_rng(4)
    k = len(pii.LABELS)
    field = pii.Field(rng.normal(size=(4, k)), np.array([0, 1, 0]), np.array([1, 2, 3]), np.array([False, False, True]))
    model = pii.Model({}, np.zeros((0, k)), rng.normal(size=(k, k)), 1.3)
    want = np.zeros((4, k))
    for y in itertools.product(range(k), repeat=4):
        score = sum(field.unary[i, y[i]] for i in range(4)) + sum((model.agree * (y[a] == y[b]) if s else model.chain[y[a], y[b]]) for a, b, s in zip(field.left, field.right, field.skip))
        for i in range(4):
            want[i, y[i]] += np.exp(score)
    want /= want.sum(axis=1, keepdims=True)
    assert np.allclose(pii.marginals(field, model, 60, 0.0), want, atol=1e-3)


def test_licenses_against_brute_force(spark):
    idx = licenses.index()
    rng = np.random.default_rng(6)
    texts = []
    for i in range(60):
        body = licenses.TEMPLATES[i % len(licenses.TEMPLATES)][1].split()
        for _ in range(i % 3):
            body[int(rng.integers(0, len(body)))] = "zzz"
        texts.append(f"{prose(int(rng.integers(0, 90)), rng)} {' '.join(body)} {prose(int(rng.integers(0, 90)), rng)}")
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(table(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect()}
    want = set()
    for i, t in enumerate(texts):
        h = words(pa.array([t])).hash
        g = licenses.window_hash(h, licenses.SHINGLE)
        for k, s in enumerate(idx.sets):
            width = idx.window(len(s))
            if any(np.isin(s, g[p : p + width]).mean() >= licenses.CONTAINMENT for p in range(0, len(g), idx.stride(len(s)))):
                want.add((i, idx.names[k]))
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) >= 20
    assert licenses.bands_for(0.5) >= np.log(1e-4) / np.log(0.75)


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(150, 48))
    x = np.concatenate([base, base[:60] + 0.25 * rng.normal(size=(60, 48)), base[:10], 3 * base[:5], base[7] + 0.2 * rng.normal(size=(80, 48)), base[9] + 0.02 * rng.normal(size=(80, 48))])
    rows = [(i, [float(a) for a in v], "extra") for i, v in enumerate(x)] + [(900, None, ""), (901, [], ""), (902, [0.0] * 48, ""), (903, [1.0, 2.0], ""), (904, [float("nan")] * 48, ""), (0, [float(a) for a in x[0]], ""), (905, [None, 1.0], ""), (None, [1.0, 2.0], ""), (906, [1e300] * 5000, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, bucket string")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= embedding.THRESHOLD - 1e-12
    got = {r["vec_id"]: r for r in embedding.near(df).collect()}
    assert set(got) == {*range(len(x)), *range(900, 907)}
    assert all(got[i]["links"] == 0 and got[i]["class_id"] == i for i in range(900, 907))
    found = sum(got[i]["links"] for i in range(len(x)))
    assert all(got[i]["links"] <= near[i].sum() - 1 for i in range(len(x))) and found >= 0.99 * (near.sum() - len(x)) and near.sum() > 6000
    group = list(range(len(x)))
    for _ in range(5):
        for i, j in np.argwhere(near):
            group[i] = group[j] = min(group[i], group[j])
    assert sum(got[i]["class_id"] != g for i, g in enumerate(group)) <= 2
    assert embedding.near(df.limit(0)).collect() == []
    h = embedding.hadamard(np.eye(8, dtype=np.float32))
    assert np.allclose(h @ h.T, np.eye(8), atol=1e-6)


def test_preferences(spark):
    kind = "conv_id long, turn long, role string, text string, extra int"
    chosen = spark.createDataFrame([(1, 0, "user", "hi", 1), (1, 0, "user", "hi", 1), (1, 1, "assistant", "yes", 1), (2, 0, None, None, 1), (3, 0, "user", "<|end|>", 1), (None, 0, "user", "x", 1), (5, None, "user", "x", 1), (4, 0, "user", "a", 1)], kind)
    other = spark.createDataFrame([(1, 0, "user", "hi", 1), (1, 1, "assistant", "no!", 1), (2, 0, None, None, 1), (3, 0, "user", "<|end|>", 1), (3, 1, "assistant", "more", 1)], kind)
    rows = {r["id"]: r for r in chat.pairs(chat.turns(chosen), chat.turns(other)).collect()}
    assert set(rows) == {1, 3}
    r = rows[1]
    assert r["prompt"] == "<|turn|>user\nhi<|end|>\n" and r["shared_turns"] == 1
    for side, text in (("chosen", "yes"), ("rejected", "no!")):
        assert [r[side][s["begin"] : s["end"]] for s in r[f"{side}_mask"]] == [text + "<|end|>"]
    assert rows[3]["chosen"] == "" and rows[3]["chosen_mask"] == [] and rows[3]["prompt"].count("<|end|>") == 1
    assert chat.pairs(chat.turns(chosen.limit(0)), chat.turns(other)).collect() == []


def test_lent_turns(spark):
    kind = "conv_id long, turn long, role string, text string, block int, id string"
    said = {0: "uaua", 1: "ua", 2: "uuaau", 3: "u", 5: "aua", 9: "ua", 17: "u"}
    long = prose(30_000)
    rows = [(c, t, {"u": "user", "a": "assistant"}[x], f"{c}.{t}" if c != 5 else long + str(t), 1, "x") for c, turns in said.items() for t, x in enumerate(turns)]
    rows += [rows[0], (None, 0, "user", "x", 1, "x"), (4, None, "assistant", "x", 1, "x"), (6, 0, None, None, 1, "x"), (7, 0, "assistant", None, 1, "x")]
    got = {r["id"]: r for r in chat.formatted(chat.lent(spark.createDataFrame(rows, kind))).collect()}
    assert set(got) == {0, 1, 2, 5, 7, 9}
    # id modulo the number of replies says which one is left: 0 at its first, 1 at its only, 2 at its first, 5 at its second one
    assert {i: r["shared_turns"] for i, r in got.items()} == {0: 1, 1: 1, 2: 2, 5: 2, 7: 0, 9: 1}
    assert got[0]["rejected"] == "<|turn|>assistant\n1.1<|end|>\n" and got[0]["chosen"].count("<|turn|>") == 3 and len(got[0]["chosen_mask"]) == 2
    assert got[9]["rejected"] == "" and got[9]["rejected_mask"] == []  # none to lend
    assert got[7]["rejected"].startswith("<|turn|>assistant\n0.1<|end|>") and got[7]["chosen"] == "<|turn|>assistant\n<|end|>\n"
    assert long + "2" in got[5]["chosen"] and all(got[5]["chosen"][s["begin"] : s["end"]].endswith("<|end|>") for s in got[5]["chosen_mask"])
    assert chat.formatted(chat.lent(spark.createDataFrame([], kind))).collect() == []


def test_mixing_rates(spark):
    docs = table(spark, [(i, "w " * 10, "en", "a" if i < 300 else "b") for i in range(400)])
    rows = mixing.mix(docs, {"a": 1.0, "b": 2.0}).groupBy("source").agg(F.sum(mixing.tokens(F.col("text"))).alias("n")).collect()
    n = {r["source"]: r["n"] for r in rows}
    assert abs(n["a"] / 4000 - 1 / 3) < 0.05 and abs(n["b"] / 4000 - 2 / 3) < 0.05
    one = mixing.mix(docs, {"a": 1.0, "b": 2.0}).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, mixing.mix(docs.repartition(7), {"a": 1.0, "b": 2.0}).collect()))
