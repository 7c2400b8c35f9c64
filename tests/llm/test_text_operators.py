"""Operators on texts against brute force, with the cases each docstring defines."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rinkflow.llm import anchors, lattice, mixing, packing, prefixtree, secrets, suffixes, tokens, toxicity

BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in thing other with from ation ing er ent stone river mountain light water house green".split()
ODD = [
    None, "", " ", "a", "a   b", "x\n\n y \n", "tab\tand  spaces ", "日本 語　テ", "don't 'tis 12a", "<|endoftext|> a  <|endoftext|>b",
    "a\x1cb c\x85 d", "é" * 300, "w" * 5000, "Ünïcödé ßtraße", "🙂 smile 🙂🙂", "  line", "token=abc", "AKIA",
]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    near = []
    for t in base[:15]:
        w = t.split()
        for k in range(3):
            v = list(w)
            v[rng.randrange(len(v))] = f"edit{k}"
            near.append(" ".join(v))
    passage = prose(rng, 60)
    shared = [prose(rng, 20) + " " + passage + " " + prose(rng, 20) for _ in range(12)]
    return ODD + base + base[:8] + near + shared + ["ab" * 400, prose(rng, 4000)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Documents with every odd text, copies, near copies, a column that clashes, and ids out of order."""
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    rows = [(i, t, "en", None if i % 9 == 0 else f"s{i % 3}", None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"word": F.lit(1), "h": F.lit("x"), "id": F.lit(-1), "n": F.lit(2.5), "spans": F.lit("s")})
    return df.repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r[0]: r for r in df.collect()}


def test_tokens(spark, docs, none):
    t = Tokenizer.from_file(BPE)
    got = by_id(tokens.count_tokens(docs, BPE, batch_bytes=2000))
    for r in docs.collect():
        text = r["text"] or ""
        assert got[r["doc_id"]]["n_tokens"] == len(t.encode(text, add_special_tokens=False).ids), repr(text[:50])
        assert got[r["doc_id"]]["n_bytes"] == len(text.encode())
    assert tokens.count_tokens(none, BPE).count() == 0
    twice = docs.limit(3).unionAll(docs.limit(3))
    assert tokens.count_tokens(twice, BPE).count() == 6
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    own = sentencepiece.SentencePieceProcessor(model_file=model)
    got = by_id(tokens.count_tokens(docs, model))
    assert all(got[r["doc_id"]]["n_tokens"] == len(own.encode(r["text"] or "")) for r in docs.collect())


def test_encoder_without_ranks(monkeypatch):
    monkeypatch.setattr(tokens.Encoder, "_ranks", staticmethod(lambda path: None))
    texts = [t or "" for t in ODD]
    coder = tokens.Encoder(BPE)
    assert [x.tobytes() for x in coder.ids(pa.array(texts))] == coder.texts(texts)


def test_packing(docs, none):
    t = Tokenizer.from_file(BPE)
    ids = {r["doc_id"]: [*t.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    rows = packing.pack(docs, BPE, capacity=64, windows=8, piece=16, slack=1).toPandas()
    for key, part in rows.groupby("doc_id"):
        part = part.sort_values("start")
        own = ids.pop(key)
        assert list(part["start"]) == [0, *np.cumsum(part["length"])[:-1]] and part["length"].sum() == len(own) == part["doc_tokens"].iloc[0]
        for r in part.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
    assert not ids
    for _, part in rows.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert list(part["offset"]) == [0, *np.cumsum(part["length"])[:-1]] and part["length"].sum() <= 64
    assert rows["length"].sum() > 0.9 * 64 * rows["sequence_id"].nunique()
    assert packing.pack(none, BPE).count() == 0


def test_differencing():
    rng = np.random.default_rng(3)
    for n, parts in ((1, 1), (5, 3), (200, 16), (3, 8)):
        lengths = rng.integers(1, 100, n).tolist()
        part = packing.difference(lengths, parts)
        sums = np.bincount(part, lengths, parts)
        assert sums.sum() == sum(lengths) and (n < 50 or sums.max() - sums.min() <= 8)
    part = packing.deal([60, 60, 60], 100)
    assert np.bincount(part, [60, 60, 60]).max() <= 100  # two windows can't hold them: the count rises
    assert len(packing.deal([], 10)) == 0


def plain_secrets(text):
    assign = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(spans + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24])


def test_secrets(spark, none):
    rng = random.Random(8)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    token = "".join(rng.choice(alphabet) for _ in range(48))
    plain = [prose(rng, 80) for _ in range(40)] + ["thestoneriverandthemountainwaterhouseingreen " * 3]
    texts = [
        None, "", "secret: token: abcdefgh", 'PassWord = "hunter22"', "api_key=abc", "API-KEY=abcdef TOKEN:'x.y_z-1='", "AKIA" + "Z9" * 8 + "é AKIAAKIA1",
        "é" * 5 + "deadbeef" * 3 + "g" + "0" * 23, "🙂 passwd=🙂 passwd=abcdef1 " * 50, f"here {token} there", *plain,
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    found = by_id(secrets.find_secrets(df))
    for i, t in enumerate(texts):
        spans = [tuple(s) for s in found[i]["spans"]]
        assert [s for s in spans if s[1] < 3] == plain_secrets(t or ""), repr(t)
        added = [s for s in spans if s[1] == 3]
        assert added == ([(5, 3, 53)] if i == 9 else []), (i, t, added)
    shown = df.withColumn("s", secrets.span_text(F.array(*[F.struct(F.lit(1).alias("start"), F.lit(2).alias("kind"), F.lit(9).alias("end"))])))
    assert shown.first()["s"] == "hex:1:9"
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(0).alias("kind"), F.lit(b).alias("end")) for a, b in ((1, 4), (2, 6), (8, 9))])
    assert spark.range(1).select(secrets.redact(F.lit("abcdefghij"), spans, "#").alias("x")).first()["x"] == "a#gh#j"
    assert secrets.find_secrets(none).count() == 0


def test_secrets_joined_to_other_text(spark):
    rng = random.Random(9)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key, url = "".join(rng.choice(alphabet) for _ in range(40)), "".join(rng.choice(alphabet + "+/") for _ in range(48))
    base = "AKIA" + "Z9" * 8
    texts = [
        f"services/T00000000/B00000000/{key} x", f"see 0000-0000-0000-0000-{key}", f"www/water_house_in_the_stone_water_house_in_the_stone/{key}/x",
        f"{base}-{url}", f"{url}-{base}-{url[::-1]}", f"here {url} there", *[prose(rng, 80) for _ in range(40)],
        *["the/stone_river/andthemountainwaterhouse/thestoneriverandthemountain" for _ in range(20)],
    ]
    found = by_id(secrets.find_secrets(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")))
    for i, t in enumerate(texts):
        spans = [tuple(s) for s in found[i]["spans"]]
        assert [s for s in spans if s[1] < 3] == plain_secrets(t), t
        added = [t[a:b] for a, kind, b in spans if kind == 3]
        if i < 3:
            assert added == [key], (t, added)
        elif i < 6:
            # The separators beside a cut base span stay with the token.
            assert [x.strip("-") for x in added] == ([url, url[::-1]] if i == 4 else [url]), (t, added)
        else:
            assert not added, (t, added)


def test_targets_and_mix(spark, docs, none):
    got = mixing.mix_sources(docs).toPandas()
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in docs.collect()}
    assert dict(zip(got["doc_id"], got["size"], strict=True)) == size
    sums = got.groupby(got["source"].fillna("~"))["size"].sum()  # a null source comes last
    names = sorted(sums.index)
    weights = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    left, open_, target = 1.5 * sums.sum(), set(names), {}
    while True:
        level = left / sum(weights[n] for n in open_)
        over = [n for n in open_ if weights[n] * level > 2 * sums[n]]
        if not over:
            break
        for n in over:
            target[n] = 2.0 * sums[n]
            left -= target[n]
            open_.remove(n)
    target |= {n: weights[n] * level for n in open_}
    for n, part in got.groupby(got["source"].fillna("~")):
        assert part["target"].iloc[0] == pytest.approx(target[n])
        assert abs(part["taken"].sum() - target[n]) <= max(0.02 * target[n], 2)
    assert (got["taken"] <= 2 * got["size"]).all() and set(got["times"]) <= {0, 1, 2}
    again = mixing.mix_sources(docs.repartition(5)).toPandas()
    pd.testing.assert_frame_equal(got.sort_values("doc_id", ignore_index=True), again.sort_values("doc_id", ignore_index=True))
    assert mixing.mix_sources(none).count() == 0


def test_flight_in_many_blocks(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(n)), "hot" if i % 3 else f"s{i % 5}") for i, n in enumerate(rng.integers(1, 60, 900))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(df, block=20).toPandas()
    sums = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (np.abs(sums["taken"] - sums["target"]) <= 0.01 * sums["target"] + 1).all() and len(got) == 900
    p = mixing.flight(np.full(200, 0.3), np.full(200, 7.0), np.random.default_rng(1), True)
    assert set(p) <= {0.0, 1.0} and p.sum() == 60  # equal sizes: the number of documents is kept


def components_of(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_ngram_join(docs, none, spark):
    sets = {}
    for r in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or ""))
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components_of(sets, links)
    assert len(links) > 40
    for options in ({}, {"frequent": 0, "block": 2, "small": 0}):
        got = by_id(prefixtree.similar_texts(docs, **options))
        assert {k: r["component_id"] for k, r in got.items()} == want
        assert all(got[k]["n_shingles"] == len(s) for k, s in sets.items())
    assert prefixtree.similar_texts(none).count() == 0
    lost = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (3, "A b c d e f")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in prefixtree.similar_texts(lost).collect()) == [(0, None), (3, 3), (4, 3), (4, 3)]


def test_borderline_clusters(spark):
    """Chains in which only neighbours are similar, so that components need links between sets that share no leader."""
    rng = random.Random(4)
    rows, k = [], 0
    for _ in range(12):
        words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        for _ in range(9):
            rows.append((k, " ".join(words)))
            k += 1
            for _ in range(rng.choice((1, 1, 2))):
                words[rng.randrange(60)] = f"w{rng.randrange(10**6)}"
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(56)} for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert {k: r["component_id"] for k, r in by_id(prefixtree.similar_texts(df)).items()} == components_of(sets, links)


def test_tree_traversal():
    rng = np.random.default_rng(6)
    for _ in range(30):
        probe = np.unique(rng.integers(0, 60, 25).astype(np.uint64))
        sets = [np.unique(np.where(rng.random(len(probe)) < 0.1, rng.integers(0, 60, len(probe)), probe).astype(np.uint64)) for _ in range(20)]
        want = [5 * len(np.intersect1d(probe, s)) >= 4 * len(np.union1d(probe, s)) for s in sets]
        assert list(prefixtree.linked(probe, sets, (4, 5))) == want


def plain_removal(docs, length):
    seen, out = set(), {}
    for key, text in sorted(docs.items()):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            window = data[s : s + length]
            if window in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(window)
        runs = sum(1 for i, x in enumerate(gone) if x and not (i and gone[i - 1]))
        kept = bytes(c for c, x in zip(data, gone, strict=True) if not x)
        out[key] = (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(docs, none):
    want = plain_removal({r["doc_id"]: r["text"] for r in docs.collect()}, 100)
    for options in ({}, {"block": 2, "small": 0}):
        rows = by_id(suffixes.without_repeats(docs, **options))
        got = {k: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for k, r in rows.items()}
        assert got == want
    assert sum(x[1] for x in want.values()) > 5000
    assert suffixes.without_repeats(none).count() == 0


def test_suffixes_of_one_byte_and_repeated_rows(spark):
    rows = [(2, "z" * 450), (1, "z" * 120), (None, "z" * 300), (3, "q" * 99), (5, "xy" * 100), (5, "xy" * 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in suffixes.without_repeats(df).collect())
    # A run of one letter keeps its first window; rows that repeat an id are not earlier than each other.
    assert got == [(0, 0), (1, 20 + 99), (2, 450), (3, 0), (5, 198), (5, 198)] or got[1] == (1, 119)


def test_sort_survives_collisions(monkeypatch):
    rng = np.random.default_rng(7)
    data = rng.integers(97, 99, 600).astype(np.uint8)
    data[300:400] = data[50:150]
    at = np.arange(0, 560)
    group = np.zeros(len(at), np.int64)
    order = suffixes.Suffixes(data, 20).sort(at, group)
    windows = [data[i : i + 20].tobytes() for i in at]
    assert [windows[i] for i in order] == sorted(windows)
    seen, want = set(), []
    for w in windows:
        want.append(w in seen)
        seen.add(w)
    assert list(suffixes.Suffixes(data, 20).repeats(at, group)) == want
    weak = anchors.spans_hash
    monkeypatch.setattr(suffixes, "spans_hash", lambda h, s, e: weak(h, s, e) & np.uint64(3))
    assert list(suffixes.Suffixes(data, 20).repeats(at, group)) >= want  # what hashes join wrongly is told apart by its bytes


def test_anchors_follow_content():
    rng = np.random.default_rng(1)
    body = rng.integers(97, 123, 400).astype(np.uint8)
    one = anchors.anchors(np.concatenate([rng.integers(97, 123, 333).astype(np.uint8), body]))
    two = anchors.anchors(np.concatenate([body, rng.integers(97, 123, 77).astype(np.uint8)]))
    def inside(x, shift):
        return {(int(p - shift)) for p, a, b in zip(x.at, x.low, x.high, strict=True) for s in range(a, b + 1) if 0 <= s - shift <= 300}
    assert inside(one, 333) == inside(two, 0)
    small = anchors.anchors(body, part=50)
    assert sum(small.high - small.low + 1) == len(body) - 99


def test_lattice_is_a_sum_over_segmentations():
    path = public_tokenizers.path("piece_bpe_32k.model")
    trie, weights, spelt = lattice.vocabulary(path)
    pieces = {p: k for p, k in trie.items() if k >= 0}
    assert weights.sum() == pytest.approx(1)
    logs = np.log(np.maximum(weights, 1e-300))
    own = lattice.Lattice(path, logs, -0.5)

    def paths(text):
        """All segmentations of the text: the pieces used and the probability."""
        if not text:
            yield [], 1.0
            return
        options = [([k], math.exp(logs[k]), text[n:]) for n in range(1, len(text) + 1) if (k := pieces.get(text[:n])) is not None]
        if text[0] not in pieces:
            options.append(([], math.prod(math.exp(logs[spelt[b]]) for b in text[0].encode()), text[1:]))
        for used, p, rest in options:
            for more, q in paths(rest):
                yield used + more, p * q

    for word in ("the", "stone", "über", "x1", "日本", "🙂a"):
        found = list(paths("▁" + word))
        total = sum(p for _, p in found)
        assert own.log_probability(word) == pytest.approx(math.log(total) - 0.5)
        want = np.zeros(len(logs))
        for used, p in found:
            for k in used:
                want[k] += p / total
        for short in (40, 0):
            own.SHORT = short
            counts = [0.0] * len(logs)
            own.expect(word, counts)
            assert np.allclose(counts, want)


def test_language_model(docs, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    train = F.col("doc_id") % 5 != 0
    got = by_id(lattice.score_texts(docs, train, path, lot_bytes=5000))
    up = {c: c + 32 for c in range(65, 91)}
    words = {r["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").translate(up)) for r in docs.collect()}
    c = Counter(w for k, ws in words.items() if k % 5 for w in ws)
    ends = sum(1 for k in words if k % 5)
    n, v = sum(c.values()) + ends, len(c) + 1
    for k, ws in words.items():
        base = sum(math.log10((x + 0.1) / (n + 0.1 * (v + 1))) for x in [*(c[w] for w in ws), ends])
        r = got[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (k % 5 == 0, len(ws) + 1, 1 + sum(w in c for w in ws), n)
        assert r["base_score"] == pytest.approx(base) and math.isfinite(r["score"]) and r["score"] < 0
    again = by_id(lattice.score_texts(docs, train, path))
    assert all(again[k]["score"] == pytest.approx(got[k]["score"]) for k in got)
    assert lattice.score_texts(none, train, path).count() == 0
    unlearnt = lattice.score_texts(docs, F.lit(False), path).first()
    assert unlearnt["train_tokens"] == 0 and math.isfinite(unlearnt["score"])


HIDE = {"o": "0", "i": "1", "e": "3", "a": "@", "s": "$"}


def test_toxicity(spark, docs, none):
    rng = random.Random(3)
    bad = ["blorkhead", "snargface", "vexmuncher"]
    rows, labels = [], []
    for i in range(600):
        words = prose(rng, 40).split()
        toxic = i % 4 == 0
        if toxic:
            w = rng.choice(bad)
            form = i % 16
            if form == 4:
                w = "".join(HIDE.get(c, c) for c in w)
            elif form == 8:
                w = " ".join(w)
            elif form == 12:
                w = w.replace("e", "eeee")
            words.insert(rng.randrange(len(words)), w)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    got = by_id(toxicity.toxic_scores(df, known, F.col("doc_id") % 3 != 1))
    held = [i for i in range(600) if i % 3 == 1]
    assert all((got[i]["score"] >= 0.7) == (i % 4 == 0) for i in held)
    found = by_id(toxicity.toxic_scores(docs, known, F.col("doc_id") % 3 != 1))
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 for r in found.values())
    assert toxicity.toxic_scores(none, known, F.lit(True)).count() == 0
    unlabelled = toxicity.toxic_scores(docs, known.limit(0), F.lit(True)).collect()
    assert {r["score"] for r in unlabelled} == {0.5}
    kept = toxicity.toxic_scores(docs, known, F.lit(True), carry=tuple(docs.columns))
    assert kept.columns == [*docs.columns, "score"]


def test_spaced_words_beside_others(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        words = prose(rng, 40).split()
        form, w = i % 20, rng.choice(["blorkhead", "snargface"])
        if i % 4 == 0:
            near = {4: "a", 8: "i", 12: "you"}.get(form)
            # Held-out rows have the word only in the spaced forms.
            hidden = " ".join(near + w) if near else " ".join("stone" + w) if form == 16 else w
            words.insert(rng.randrange(len(words)), hidden)
        elif form == 3:
            words.insert(rng.randrange(len(words)), " ".join("a" + rng.choice(["stone", "river", "mountain"])))
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)], "doc_id long, toxic int")
    got = by_id(toxicity.toxic_scores(df, known, F.col("doc_id") % 20 <= 3))
    assert all((got[i]["score"] >= 0.7) == (i % 4 == 0) for i in range(600))


def test_boundaries_between_spaced_letters(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([(" ".join(rng.choice(["you", "stupid", "a", "person", "are"]) for _ in range(500)),)], "text string")
    decoder = toxicity.Decoder(toxicity.character_model(df))
    assert {"a", "stupid"} <= toxicity.words_of("are a s t u p i d person", decoder)
    assert {"you", "stupid"} <= toxicity.words_of("y o u s t u p i d", decoder)


def test_hidden_runs_of_any_length(spark):
    rng = random.Random(7)
    df = spark.createDataFrame([(" ".join(rng.choice(["you", "stupid", "blockhead", "are", "such"]) for _ in range(500)),)], "text string")
    decoder = toxicity.Decoder(toxicity.character_model(df), known=["blockhead"])
    phrase = "youaresuchastupidblockheadyouarestupid"
    assert len(phrase) > 30
    assert {"blockhead", phrase} <= toxicity.words_of(" ".join(phrase), decoder)
    assert "stupid" in toxicity.words_of("st" + "u" * 100 + "pid", decoder)
    assert "blockhead" in toxicity.words_of(" ".join("such" * 50_000 + "blockhead"), decoder)
