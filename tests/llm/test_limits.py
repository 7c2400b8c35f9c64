"""Hard inputs of the text operators: rare scripts, long lines of marks, clashing frequencies, large families."""

import itertools
import math
import random
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from rinkflow.llm import lattice, prefixtree, secrets, toxicity

PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: Letters of scripts of which the vocabulary has few pieces or none.
SCRIPTS = {"ethiopic": 0x1200, "javanese": 0xA98F, "cherokee": 0x13A0, "linear b": 0x10080, "han": 0x4E00}


@pytest.mark.parametrize("start", SCRIPTS.values(), ids=SCRIPTS)
def test_words_of_any_script_have_expectations(start):
    """Words of 1 to 60 letters, also after expectation over a corpus of other scripts has made their pieces rare."""
    _, weights, _ = lattice.vocabulary(PIECES)
    logs, end = np.log(np.maximum(weights, 1e-300)) + math.log(0.7), math.log(0.3)
    for _ in range(2):
        own, sums = lattice.Lattice(PIECES, logs, end), [0.0] * (len(weights) + 1)
        for word in ("the", "stone", "of", "water") * 1000:
            own.expect(word, sums)
        sums[-1] += 4e9  # a large corpus
        counts = np.array(sums) * 1e6
        logs = np.log(np.maximum((counts[:-1] + weights) / (counts.sum() + 1), 1e-300))
        end = math.log(counts[-1] / counts.sum())
    own = lattice.Lattice(PIECES, logs, end)
    before = 0.0
    for n in range(1, 61):
        word = "".join(chr(start + i % 40) for i in range(n))
        counts = [0.0] * (len(weights) + 1)
        own.expect(word, counts)
        p = own.log_probability(word)
        assert math.isfinite(p) and p < before and all(math.isfinite(c) and c >= 0 for c in counts)
        before = p
        logged = [0.0] * (len(weights) + 1)
        own._expect_logs(*own.arcs(word), logged)
        assert np.allclose(counts, logged, rtol=1e-6, atol=1e-9)


def test_scores_are_marginals_of_the_lattice(spark):
    rows = [(1, "a stone of water"), (2, "ሀሁሂሃሄህሆለሉሊላሌልሎሐሑሒሓሔሕሖመሙሚ A stone"), (3, None), (5, "water water")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in lattice.score_texts(df, F.col("doc_id") != 5, PIECES, steps=0).collect()}
    _, weights, _ = lattice.vocabulary(PIECES)
    own = lattice.Lattice(PIECES, np.log(np.maximum(weights, 1e-300)) + math.log(0.7), math.log(0.3))
    words, ends = 4 + 3, 3
    for k, text in rows:
        ws = (text or "").lower().split()
        want = sum(own.log_probability(w) + math.log((words + 1) / (words + ends + 2)) for w in ws) + math.log((ends + 1) / (words + ends + 2))
        assert got[k]["score"] == pytest.approx(want / math.log(10))
        assert math.isfinite(got[k]["mixed_score"]) and got[k]["mixed_score"] < 0
    # Expectation raises the likelihood of the words it has seen.
    seen = spark.createDataFrame([(1, "a stone of water")], "doc_id long, text string")
    plain, fitted = (lattice.score_texts(seen, F.lit(True), PIECES, steps=n).first()["score"] for n in (0, 2))
    assert fitted > plain


@pytest.fixture(scope="module")
def decoder():
    rng = np.random.default_rng(3)
    return toxicity.Decoder(np.log(rng.dirichlet(np.ones(toxicity.SYMBOLS), (toxicity.SYMBOLS, toxicity.SYMBOLS))).astype(np.float32))


@pytest.mark.parametrize("tail", ["", "a", " b"])
def test_long_lines_of_marks(decoder, tail):
    for mark in "#*!@$+(|1403_.-a":
        start = time.perf_counter()
        words = toxicity.words_of(mark * 1_000_000 + tail, decoder)
        assert time.perf_counter() - start < 2 and len(words) <= 4, mark
    for unit in ("a ", "1 ", "a.", "a*"):
        start = time.perf_counter()
        toxicity.words_of(unit * 500_000, decoder)
        assert time.perf_counter() - start < 2, unit


def test_search_is_the_best_of_all_paths(decoder):
    """Every path of short runs, one choice of each character after the other, against the Viterbi search."""

    def paths(run):
        for choice in itertools.product(*[range(4) for _ in run]):
            score, out, a, b = 0.0, [], 0, 0
            for i, (c, pick) in enumerate(zip(run, choice, strict=True)):
                options = [(x, decoder.index.get(x, 0), decoder.swap) for x in toxicity.LOOKS.get(c, "")]
                if c.isalpha():
                    options.append((c, decoder.index.get(c, 0), 0.0))
                many = any(run[j : j + 3] == c * 3 for j in (i - 2, i - 1, i) if j >= 0)
                last = out[-1] if out else ""
                if many and last and (c == last or last in toxicity.LOOKS.get(c, "")):
                    options.append((None, None, decoder.repeat))
                if not options or not any(o[0] for o in options):
                    options.append((None, None, decoder.keep))
                if pick >= len(options):
                    break
                x, k, cost = options[pick]
                score -= cost
                if x is not None:
                    score += decoder.model[a][b][k]
                    out, a, b = [*out, x], b, k
            else:
                yield score + decoder.model[a][b][0], "".join(out)

    rng = random.Random(5)
    for _ in range(60):
        run = "".join(rng.choice("ab1!3e0oo") for _ in range(rng.randrange(1, 6)))
        scores = sorted(paths(run), reverse=True)
        found = decoder._search(run)
        assert found in {word for s, word in scores if s > scores[0][0] - 1e-3}, run


def test_skew_from_one_pass(spark):
    texts = ["Aa0-_+/ zZ f09", None, "", "ABC234 abcdef 0123456789"]
    got = secrets.symbol_skew(spark.createDataFrame([(t,) for t in texts], "text string"))
    for kind, order in secrets.ORDERS.items():
        counts = dict.fromkeys(order, 0)
        for c in "".join(t or "" for t in texts):
            plain = {"-": "+", "_": "/"}.get(c, c)
            plain = plain.lower() if kind == "hex" else plain
            if plain in counts:
                counts[plain] += 1
        total = sum(counts.values())
        assert got[kind] == pytest.approx(len(order) * sum(n * n for n in counts.values()) / total**2 - 1)
    assert secrets.symbol_skew(spark.createDataFrame([], "text string")) == {"hex": 0.0, "base32": 0.0, "base64": 0.0}


def similar(a, b):
    return 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))


def test_forest_joins_what_links_join():
    rng = np.random.default_rng(8)
    for trial in range(40):
        base = rng.choice(400, 30, replace=False)
        sets = []
        for _ in range(40):
            own = base.copy()
            change = rng.random(30) < rng.choice([0.05, 0.1, 0.2])
            own[change] = rng.integers(0, 400, change.sum())
            sets.append(np.unique(own.astype(np.uint64)))
        labels = rng.integers(0, 12, 40)
        cut = 40 if trial % 2 else int(rng.integers(1, 40))
        left, right = sets[:cut], sets[cut:] or sets[:cut]
        right = left if cut == 40 else right
        ll, rl = labels[:cut], labels[:cut] if cut == 40 else labels[cut:]
        found = prefixtree.forest(left, ll, right, rl, (4, 5))
        want = {(int(a), int(b)) for x, a in zip(left, ll) for y, b in zip(right, rl) if a != b and similar(x, y)}
        assert {tuple(sorted(e)) for e in found} <= {tuple(sorted(e)) for e in want}

        def joined(edges):
            parent = list(range(12))
            for _ in range(12):
                for a, b in edges:
                    parent[a] = parent[b] = min(parent[a], parent[b])
            return parent

        assert joined(found) == joined(want) and len(found) < 12


def test_large_family_without_links_to_its_leader(spark):
    """Copies that differ from each other in a quarter of their words, some of them close to one another: blocks of a family."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(60):
        own = [w if rng.random() > 0.03 else f"x{rng.randrange(10**6)}" for w in words]
        rows.append((i, " ".join(own)))
        if i % 6 == 0:
            rows.append((100 + i, " ".join([*own[:-1], "end"])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(76)} for i, t in rows}
    reach = {i: i for i in sets}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for _ in range(70):
        for a, b in links:
            reach[a] = reach[b] = min(reach[a], reach[b])
    assert 5 < len(set(reach.values())) < 60
    for options in ({}, {"block": 5000}):
        got = {r["doc_id"]: r["component_id"] for r in prefixtree.similar_texts(df, **options).collect()}
        assert got == reach
