"""Language-model scores of texts by a subword lattice.

The probability of a word is the sum over all its segmentations into pieces of an existing vocabulary, found by a forward recursion
in log space; that of a text is the product over its words and its end. The vocabulary's scores are merge ranks; by Zipf's law they
give the first weights of the pieces, which ``steps`` of expectation over the distinct training words then fit to the corpus. Any
word of any script has a probability: characters without a piece are spelt by their bytes.

``mixed_score`` is the same sum over a lattice with one more arc for every word seen in training: the whole word, with its relative
frequency. Only the mass of unseen words (Witten-Bell: as many as there are distinct words) goes through the pieces. Pieces alone
(``score``) are fitted to distinct words and don't know how often a word occurs, so held-out texts get far less from them.

Work is shared by words, not tokens. Documents are dealt into lots of about ``lot_bytes`` by a hash of their content; a lot
sends each distinct word once, words are counted and scored once each, and every lot gets its words back. The most frequent
word thus costs one row a lot. Nothing that grows with the corpus passes through the driver: it sees totals, and one number
per piece of the vocabulary.

Null text counts as empty (one token, the end). Repeated rows count each. Without training rows all counts are 0 and the
subword model has the weights of the vocabulary alone. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinkflow.llm.batches import stored, strings, text_or_empty

START = "▁"
#: Distinct words that a task takes the expectation of.
WORDS_PER_TASK = 100_000


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[dict[str, int], np.ndarray, list[int]]:
    """A trie of the pieces (number of each piece, -1 for what only begins one), weights by Zipf's law from their scores, and
    the pieces of the 256 bytes, which spell characters without a piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    trie, weights, spelt = {}, np.zeros(n), [-1] * 256
    for i in range(n):
        if model.is_control(i) or model.is_unknown(i):
            continue
        piece = model.id_to_piece(i)
        rank = n if model.is_byte(i) else min(n, -model.get_score(i))
        weights[i] = 1 / (rank + 2.7)
        if model.is_byte(i):
            spelt[int(piece[3:5], 16)] = i
            continue
        for k in range(1, len(piece)):
            trie.setdefault(piece[:k], -1)
        trie[piece] = i
    return trie, weights / weights.sum(), spelt


class Lattice:
    """Marginal probabilities of words under piece log-probabilities."""

    #: Below this, sums without logarithms lose digits.
    TINY = 1e-280
    #: Words up to this length are first tried without logarithms.
    SHORT = 40

    def __init__(self, path: str, logs: np.ndarray, stop: float):
        self.trie, _, self.spelt = vocabulary(path)
        self.logs, self.stop = logs.tolist(), stop

    def arcs(self, word: str) -> tuple[int, list[tuple[int, int, int, float]]]:
        """Length of the word with its start mark, and its arcs (start, end, piece, log-probability) by start."""
        text, trie, logs = START + word, self.trie, self.logs
        n, out = len(text), []
        for i in range(n):
            for j in range(i + 1, n + 1):
                k = trie.get(text[i:j])
                if k is None:
                    break
                if k >= 0:
                    out.append((i, j, k, logs[k]))
            if trie.get(text[i], -1) < 0:  # a character without a piece is spelt by its bytes, as one arc
                spelt = text[i].encode("utf-8", "surrogatepass")
                out.append((i, i + 1, -1, sum(logs[self.spelt[b]] for b in spelt)))
        return n, out

    @staticmethod
    def forward(n: int, arcs: list[tuple[int, int, int, float]]) -> list[float]:
        """Log-probability of all ways to each position."""
        exp, log = math.exp, math.log
        coming: list[list[float]] = [[] for _ in range(n + 1)]
        coming[0].append(0.0)
        alpha, at = [0.0] * (n + 1), -1
        for i, j, _, weight in arcs:
            # Arcs come by start, so all ways to a position are known before the first arc that leaves it.
            while at < i:
                at += 1
                alpha[at] = Lattice._sum(coming[at], exp, log)
            coming[j].append(alpha[i] + weight)
        while at < n:
            at += 1
            alpha[at] = Lattice._sum(coming[at], exp, log)
        return alpha

    @staticmethod
    def _sum(logs: list[float], exp, log) -> float:
        if len(logs) == 1:
            return logs[0]
        top = max(logs)
        return top + log(sum([exp(x - top) for x in logs]))

    def log_probability(self, word: str) -> float:
        """Natural logarithm of the sum over all segmentations, the end of the word included."""
        return self.forward(*self.arcs(word))[-1] + self.stop

    def expect(self, word: str, counts: list[float]) -> None:
        """Add the expected uses of every piece in the word."""
        n, arcs = self.arcs(word)
        if n > self.SHORT:
            self._expect_logs(n, arcs, counts)
            return
        exp = math.exp
        chances = [exp(log) for _, _, _, log in arcs]
        alpha, beta = [1.0] + [0.0] * n, [0.0] * n + [1.0]
        for (i, j, _, _), q in zip(arcs, chances, strict=True):
            alpha[j] += alpha[i] * q
        all_ = alpha[n]
        if all_ < self.TINY:
            self._expect_logs(n, arcs, counts)
            return
        for (i, j, k, _), q in zip(reversed(arcs), reversed(chances), strict=True):
            share = q * beta[j]
            beta[i] += share
            if k >= 0:
                counts[k] += alpha[i] * share / all_

    def _expect_logs(self, n: int, arcs: list, counts: list[float]) -> None:
        alpha = self.forward(n, arcs)
        beta = [-math.inf] * n + [0.0]
        for i, j, k, log in reversed(arcs):
            t = beta[j] + log
            beta[i] = t if beta[i] == -math.inf else max(t, beta[i]) + math.log1p(math.exp(-abs(t - beta[i])))
            if k >= 0:
                counts[k] += math.exp(alpha[i] + t - alpha[n])


def cut_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of ``texts`` with A-Z in lower case, and the row of each."""
    plain = pc.ascii_lower(texts.cast(pa.large_string()))
    plain = pc.replace_substring_regex(plain, "[\t-\r]", " ")
    lists = pc.split_pattern(plain, " ")
    words, rows = lists.flatten(), pc.list_parent_indices(lists)
    some = pc.not_equal(words, "")
    return words.filter(some).dictionary_encode(), rows.filter(some).to_numpy()


def _fitted(words: DataFrame, path: str, logs: np.ndarray, end: float, prior: np.ndarray) -> tuple[np.ndarray, float]:
    """One step of expectation over distinct words: log-probabilities of pieces and of a word's end. One number per piece returns."""

    def expected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, sums = Lattice(path, logs, end), [0.0] * (len(prior) + 1)
        for batch in batches:
            for word in strings(batch.column(0)):
                lattice.expect(word, sums)
            sums[-1] += batch.num_rows
        counts = np.array(sums)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["piece", "n"])

    uses = words.mapInArrow(expected, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(prior) + 1)
    counts[uses["piece"].to_numpy()] = uses["n"].to_numpy()
    pieces, ends = counts[:-1] + prior, counts[-1] + 1
    total = pieces.sum() + ends
    return np.log(np.maximum(pieces / total, 1e-300)), math.log(ends / total)


def score_texts(
    docs: DataFrame, train: Column, vocabulary_path: str, steps: int = 2, smoothing: float = 0.1, lot_bytes: int = 12 << 20,
    text: str = "text", key: str = "doc_id",
) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score, mixed_score) of every row; ``train`` says what is learnt from."""
    kind = docs.schema[key].dataType.simpleString()
    named = docs.select(F.col(key).alias("id"), F.coalesce(train, F.lit(False)).alias("train"), text_or_empty(text).alias("text"))
    size, trained = named.agg(F.sum(F.octet_length("text")), F.count(F.when(F.col("train"), 1))).first()
    lots = max(1, -(-(size or 0) // lot_bytes))
    dealt = named.withColumn("lot", F.pmod(F.xxhash64("id", "text"), F.lit(lots)).cast("int"))

    def send(table: pa.Table) -> pa.Table:
        texts = table["text"].combine_chunks()
        coded, rows = cut_words(texts)
        learnt = table["train"].combine_chunks().to_numpy(zero_copy_only=False)[rows]
        n = np.bincount(coded.indices.to_numpy()[learnt.astype(bool)], minlength=len(coded.dictionary))
        lot = pa.array(np.full(len(n), table["lot"][0].as_py(), np.int32))
        return pa.table({"word": coded.dictionary.cast(pa.string()), "lot": lot, "n": pa.array(n, pa.int64())})

    sent = dealt.groupBy("lot").applyInArrow(send, "word string, lot int, n long")
    # The same exchange serves the totals and, below, the way back to the lots.
    sent = stored(sent, "lot-words")
    counted = stored(sent.groupBy("word").agg(F.sum("n").alias("c")), "words")
    totals = counted.agg(F.sum("c"), F.count(F.when(F.col("c") > 0, 1))).first()
    n_words, distinct = (totals[0] or 0) + trained, (totals[1] or 0) + (1 if trained else 0)

    weights = vocabulary(vocabulary_path)[1]
    logs, end = np.log(np.maximum(weights, 1e-300)) + math.log(0.7), math.log(0.3)
    # Every step reads the distinct words again: as many tasks as words need, whatever their bytes.
    parts = max(1, -(-distinct // WORDS_PER_TASK))
    known = counted.where("c > 0").select("word")
    known = stored(known.repartition(parts, "word"), "known-words") if distinct else known
    for _ in range(steps if distinct else 0):
        logs, end = _fitted(known, vocabulary_path, logs, end, weights)

    new = max(1, distinct)
    total = n_words + new + 1
    # A text ends after a word as often as training texts do, with one more of either kind.
    go_on, stop_text = math.log((n_words - trained + 1) / (n_words + 2)), math.log10((trained + 1) / (n_words + 2))

    def word_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(vocabulary_path, logs, end)
        for batch in batches:
            c = batch.column(1).to_numpy()
            sub = np.array([lattice.log_probability(w) for w in strings(batch.column(0))])
            with np.errstate(divide="ignore"):
                mixed = np.logaddexp(np.log(c), math.log(new) + sub) - math.log(total)
            columns = [*batch.columns, pa.array((sub + go_on) / math.log(10)), pa.array(mixed / math.log(10))]
            yield pa.RecordBatch.from_arrays(columns, ["word", "c", "s", "m"])

    scored = counted.repartition(max(1, -(-counted.count() // WORDS_PER_TASK)), "word").mapInArrow(word_scores, "word string, c long, s double, m double")
    returned = sent.select("word", "lot").join(scored, "word")
    missing = math.log10(smoothing / (n_words + smoothing * (distinct + 1)))
    end_base = math.log10((trained + smoothing) / (n_words + smoothing * (distinct + 1)))
    end_mixed = math.log10((trained + 1) / total)
    names = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "mixed_score"]

    def finish(texts: pa.Table, words: pa.Table) -> pa.Table:
        coded, rows = cut_words(texts["text"].combine_chunks())
        at = pc.index_in(coded.dictionary.cast(pa.string()), value_set=words["word"].combine_chunks()).to_numpy(zero_copy_only=False)
        c = words["c"].to_numpy()[at.astype(np.int64)] if len(at) else np.zeros(0)
        s, m = (words[x].to_numpy()[at.astype(np.int64)] if len(at) else np.zeros(0) for x in ("s", "m"))
        base = np.where(c > 0, np.log10((c + smoothing) / (n_words + smoothing * (distinct + 1))), missing)
        token, n = coded.indices.to_numpy(), len(texts)
        sums = [np.bincount(rows, w, n) for w in (np.ones(len(rows)), (c > 0)[token], base[token], s[token], m[token])]
        return pa.table(
            [
                texts["id"], pc.invert(texts["train"]), pa.array((sums[0] + 1).astype(np.int64)),
                pa.array((sums[1] + (1 if trained else 0)).astype(np.int64)), pa.array(np.full(n, n_words, np.int64)),
                pa.array(sums[2] + end_base), pa.array(sums[3] + stop_text), pa.array(sums[4] + end_mixed),
            ],
            names=names,
        )

    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, mixed_score double"
    out = dealt.groupBy("lot").cogroup(returned.groupBy("lot")).applyInArrow(finish, schema)
    return out.withColumnRenamed("id", key)
