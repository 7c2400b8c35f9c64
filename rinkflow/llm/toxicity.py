"""Toxicity of texts, read through a noisy channel.

Writers hide words by look-alike characters, by spacing letters out and by repeating them. Runs that look so are decoded: every
character becomes a column of a lattice (its look-alikes, itself, nothing if it repeats the letter before or only separates, a
word boundary if it stands between spaced letters), and a Viterbi search takes the path that a character trigram model of all
documents and the costs of the channel like best. Spaced letters are read as one word and as words set apart, and words of the
lexicon are looked for from every letter of them. Runs may have any length from three characters on. The restored words are scored with the plain ones.

Words and their first letters (stems) are weighed by how much more often toxic training documents have them. The fit reads at
most ``sample`` toxic and ``2 * sample`` other labelled rows, the smallest by hash; evidence below a Bonferroni bound is left
out and at most ``lexicon`` entries are kept, so all that is broadcast has a fixed bound. A document's score is a noisy-or of
its strongest entries, above the rate of toxic documents without any.

Null and empty texts, and tables without labels, get that rate. Rows are scored one by one, so repeated rows, long texts and
further columns change nothing; a document labelled twice counts as toxic if one of its labels says so.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinkflow.llm.batches import by_bytes, stored, strings, text_or_empty

#: Characters and the letters they may stand for.
LOOKS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "*": "aeiou", "#": "h"}
SEPARATORS = " .-_*"
#: At the end of a run these are punctuation.
CLOSING = "!*(|+#"
WORD = re.compile(r"[^\W\d_]+")
ODD_CHARS = "".join(re.escape(c) for c in LOOKS)
#: A run with a look-alike between or beside letters, a letter three times or more, or four letters and more spaced out. A run of
#: letters and look-alikes is tried from its beginning alone, so that long lines of marks cost no more than their length.
HIDDEN = re.compile(
    rf"(?<![\w{ODD_CHARS}])(?=[\w{ODD_CHARS}]*[^\W\d_])(?:[\w{ODD_CHARS}]*[{ODD_CHARS}][\w{ODD_CHARS}]*|\w*([^\W\d_])\1\1\w*)"
    rf"|(?<!\w)[\w{ODD_CHARS}](?:([ .\-_*])[\w{ODD_CHARS}])(?:\2[\w{ODD_CHARS}])+(?!\w)"
)
TRIPLE = re.compile(r"([^\W\d_])\1\1")
#: More than three of a character say no more than three.
MORE = re.compile(r"(.)\1{3,}", re.DOTALL)
MORE_SPACED = re.compile(rf"([^{re.escape(SEPARATORS)}][{re.escape(SEPARATORS)}])\1{{3,}}")
#: Letters of the character model: none, a-z, and the Latin letters of one byte.
LETTERS = [chr(c) for c in [*range(97, 123), *range(0xDF, 0x100)] if c != 0xF7]
SYMBOLS = len(LETTERS) + 1
STEMS = (4, 5, 6)
#: Runs up to this length are decoded once; longer ones every time, so that what is remembered has a bound.
KEPT = 40


@lru_cache(maxsize=1)
def _codes() -> np.ndarray:
    table = np.zeros(1 << 8, np.int64)
    for i, c in enumerate(LETTERS):
        table[ord(c)] = i + 1
    return table


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS**3, np.int64)
    for batch in by_bytes(batches, "text"):
        text = "  ".join(["", *strings(batch.column(0)), ""]).lower()
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        s = np.where(code < 256, _codes()[np.minimum(code, 255)], 0)
        if len(s) > 2:
            total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])


def character_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Log-probability of a letter after two others, interpolated; counts of all documents, one cell per trigram."""
    counts = docs.select(text_or_empty(text).alias("text")).mapInArrow(_trigrams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    table = np.zeros(SYMBOLS**3)
    rows = counts.toArrow()
    table[rows["gram"].to_numpy()] = rows["n"].to_numpy()
    three = table.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + SYMBOLS)
    p2 = (two + 20 * p1) / (two.sum(axis=1, keepdims=True) + 20)
    p3 = (three + 20 * p2[None]) / (three.sum(axis=2, keepdims=True) + 20)
    return np.log(p3).astype(np.float32)


class Decoder:
    """Viterbi search over the lattice of a hidden run.

    Spaced letters have two readings, as one word and with words set apart at separators, since trigrams alone don't place every
    boundary. ``known`` words are found in them wherever they start.
    """

    def __init__(
        self, model: np.ndarray, swap: float = 1.0, drop: float = 0.5, repeat: float = 0.2, keep: float = 6.0, known: Iterable[str] = ()
    ):
        self.model, self.swap, self.drop, self.repeat, self.keep = model.tolist(), swap, drop, repeat, keep
        self.index = {x: i + 1 for i, x in enumerate(LETTERS)}
        self.known = {w for w in known if len(w) >= STEMS[0]}
        self.lengths = sorted({len(w) for w in self.known})
        self.seen: dict[str, set[str]] = {}

    def restore(self, run: str) -> set[str]:
        """The words of a run."""
        run = MORE_SPACED.sub(r"\1\1\1", MORE.sub(r"\1\1\1", run))
        if len(run) > KEPT:
            return self._words(run)
        if len(self.seen) > 50_000:
            self.seen.clear()
        if (words := self.seen.get(run)) is None:
            words = self.seen[run] = self._words(run)
        return words

    def _words(self, run: str) -> set[str]:
        whole = self._search(run)
        # Letters and one separator in turn: a separator may also stand between two words.
        if not (len(run) > 2 and run[1] in SEPARATORS and run[1::2] == run[1] * len(run[1::2])):
            return {whole}
        apart = self._search(run, words=True)
        words = {whole, *apart.split()}
        for letters in {whole, apart.replace(" ", "")}:
            words.update(w for i in range(len(letters)) for n in self.lengths if (w := letters[i : i + n]) in self.known)
        return words

    def _search(self, run: str, words: bool = False) -> str:
        index, model = self.index, self.model
        spaced = len(run) > 2 and run[1] in SEPARATORS and not run[0].isspace()
        # A path is its score, its last letter and the path before that letter, so that steps cost the same in runs of any length.
        paths: dict = {(0, 0): (0.0, "", None)}
        for i, c in enumerate(run):
            options = [(x, index.get(x, 0), self.swap) for x in LOOKS.get(c, "")]
            if c.isalpha():
                options.append((c, index.get(c, 0), 0.0))
            # Only letters that stand three times or more may be dropped as repeated.
            many = any(run[j : j + 3] == c * 3 for j in (i - 2, i - 1, i) if j >= 0)
            apart = spaced and c in SEPARATORS
            step: dict = {}
            for (a, b), path in paths.items():
                score, last, _ = path
                row = model[a][b]
                for x, k, cost in options:
                    value = score + row[k] - cost
                    if (b, k) not in step or value > step[b, k][0]:
                        step[b, k] = value, x, path
                if many and last and (c == last or last in LOOKS.get(c, "")):
                    value = score - self.repeat
                    if (a, b) not in step or value > step[a, b][0]:
                        step[a, b] = value, last, path[2]
                if not options or apart:
                    value = score - (self.drop if apart else self.keep)
                    if (a, b) not in step or value > step[a, b][0]:
                        step[a, b] = value, last, path[2]
                if words and i % 2:
                    value = score + row[0] - self.drop
                    if (b, 0) not in step or value > step[b, 0][0]:
                        step[b, 0] = value, " ", path
            paths = step
        path = max(((score + model[a][b][0], (score, x, before)) for (a, b), (score, x, before) in paths.items()), key=lambda p: p[0])[1]
        letters = []
        while path is not None:
            letters.append(path[1])
            path = path[2]
        return "".join(reversed(letters))


def words_of(text: str, decoder: Decoder) -> set[str]:
    """Distinct words in lower case, restored ones included."""
    tokens = text.lower().split()
    distinct = set(tokens)
    lines = [t for t in distinct if not t.isalpha()]
    words = distinct.difference(lines)
    # Plain letters hide nothing unless one repeats; what else is there is searched on lines of its own.
    if TRIPLE.search("\n".join(words)):
        repeated = [t for t in words if TRIPLE.search(t)]
        words, lines = words | set(WORD.findall(" ".join(lines))), lines + repeated
    else:
        words |= set(WORD.findall(" ".join(lines)))
    single = [i for i, t in enumerate(tokens) if len(t) == 1]
    lines += [" ".join(run) for run in _runs(tokens, single) if len(run) > 3]
    for found in HIDDEN.finditer("\n".join(lines)):
        run = found[0].rstrip(CLOSING)
        if len(run) >= 3 and HIDDEN.fullmatch(run):
            words |= decoder.restore(run)
    return words


def _runs(tokens: list[str], single: list[int]) -> Iterator[list[str]]:
    """Tokens of one character that follow each other."""
    start = 0
    for k in range(1, len(single) + 1):
        if k == len(single) or single[k] != single[k - 1] + 1:
            yield tokens[single[start] : single[k - 1] + 1]
            start = k


def entries(words: set[str]) -> set[str]:
    """Words, and their stems marked by a star."""
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


class Lexicon:
    """Weights of words and of stems."""

    def __init__(self, weights: dict[str, float]):
        self.words = {e: q for e, q in weights.items() if not e.endswith("*")}
        self.stems = {n: {e[:-1]: q for e, q in weights.items() if e.endswith("*") and len(e) == n + 1} for n in STEMS}

    def evidence(self, words: set[str]) -> float:
        """1 minus the product of the chances that none of the three strongest entries is right."""
        found = [self.words[w] for w in words & self.words.keys()]
        for n, stems in self.stems.items():
            found += [stems[s] for s in {w[:n] for w in words if len(w) > n} & stems.keys()]
        return 1 - math.prod(1 - q for q in sorted(found, reverse=True)[:3])


def _labelled(labels: DataFrame, train: Column, sample: int, key: str, label: str) -> tuple[DataFrame, float, float]:
    """At most ``sample`` toxic and twice as many other rows with their weights: how many rows each stands for."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & train)
    known = known.groupBy(F.col(key).alias("__id")).agg((F.max(label) > 0).alias("__toxic"))
    counts = {r["__toxic"]: r["count"] for r in known.groupBy("__toxic").count().collect()}
    order = [F.xxhash64("__id"), F.col("__id")]
    picked = known.where("__toxic").orderBy(*order).limit(sample).unionAll(known.where(~F.col("__toxic")).orderBy(*order).limit(2 * sample))
    bad, good = counts.get(True, 0), counts.get(False, 0)
    return picked, max(1.0, bad / sample), max(1.0, good / (2 * sample))


def toxic_scores(
    docs: DataFrame, labels: DataFrame, train: Column, sample: int = 10_000, lexicon: int = 20_000, level: float = 0.01,
    text: str = "text", key: str = "doc_id", label: str = "toxic", carry: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """The ``carry`` columns and ``score`` of every row. ``train`` says which rows of ``labels`` may be learnt from."""
    model = character_model(docs, text)
    picked, bad_weight, good_weight = _labelled(labels, train, sample, key, label)
    # 3 * sample rows at most.
    rows = docs.select(F.col(key).alias("__id"), text_or_empty(text).alias("text")).join(F.broadcast(picked), "__id")
    rows = stored(rows.select("text", "__toxic"), "toxic-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model)
        for batch in by_bytes(batches, "text"):
            found: tuple[Counter, Counter] = (Counter(), Counter())
            for t, toxic in zip(strings(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                found[toxic].update(entries(words_of(t, decoder)))
            names = list(found[0] | found[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([found[1][x] for x in names], pa.int64()), pa.array([found[0][x] for x in names], pa.int64())],
                ["entry", "bad", "good"],
            )

    sizes = rows.agg(F.count(F.when(F.col("__toxic"), 1)), F.count(F.when(~F.col("__toxic"), 1))).first()
    a_all, b_all = sizes[0], sizes[1]
    counted = rows.mapInArrow(count, "entry string, bad long, good long").groupBy("entry").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    tested = stored(counted.where("bad >= 3"), "toxic-entries")
    weights: dict[str, float] = {}
    if a_all and b_all:
        bound = 2 * math.log(max(1, tested.count()) / level)
        n, share = F.col("bad") + F.col("good"), a_all / (a_all + b_all)
        gain = F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / (n * (1 - share)))).otherwise(0.0)
        gain = 2 * (F.col("bad") * F.log(F.col("bad") / (n * share)) + gain)
        kept = tested.where((F.col("bad") > n * share) & (gain >= bound)).orderBy(gain.desc(), "entry").limit(lexicon)
        for r in kept.collect():
            bad, good = r["bad"] * bad_weight, r["good"] * good_weight
            weights[r["entry"]] = (bad + 0.1) / (bad + good + 1)

    lexicon_ = Lexicon(weights)

    def silent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model, known=lexicon_.words)
        for batch in by_bytes(batches, "text"):
            none = [lexicon_.evidence(words_of(t, decoder)) == 0 for t in strings(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(none), batch.column(1)], ["none", "bad"])

    rest = {r["bad"]: r["count"] for r in rows.mapInArrow(silent, "none boolean, bad boolean").where("none").groupBy("bad").count().collect()}
    bad, good = rest.get(True, 0) * bad_weight, rest.get(False, 0) * good_weight
    rate = (bad + 0.5) / (bad + good + 1)

    # A text that is carried is sent once: it is scored from the carried column, where null counts as empty.
    again = text in carry and docs.schema[text].dataType.simpleString() == "string"
    place = carry.index(text) if again else len(carry)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model, known=lexicon_.words)
        for batch in by_bytes(batches, batch_name):
            values = [1 - (1 - rate) * (1 - lexicon_.evidence(words_of(t or "", decoder))) for t in strings(batch.column(place))]
            fields = list(batch.schema)[: len(carry)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array(values, pa.float64())], schema=pa.schema([*fields, ("score", pa.float64())]))

    names = [f"__{i}" for i in range(len(carry))]
    batch_name = names[place] if again else "text"
    narrow = docs.select(*[F.col(c).alias(n) for c, n in zip(carry, names, strict=True)], *([] if again else [text_or_empty(text).alias("text")]))
    schema = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(carry, names, strict=True))
    return narrow.mapInArrow(score, f"{schema}, score double").select(*[F.col(n).alias(c) for c, n in zip(carry, names, strict=True)], "score")
