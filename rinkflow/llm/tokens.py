"""Token counts: batch encoding inside Arrow functions.

A byte-level BPE vocabulary first cuts a text into pre-tokens. No pre-token spans a change from a character that is not
white space to a space, so texts (long ones too) are split at such spaces, and the pieces of a batch are encoded once each.
Batches are cut by bytes, so a partition of a few long texts needs no more memory than one of many short ones.

Rows: null text counts as empty (0 tokens); repeated rows are counted each; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinkflow.llm.batches import by_bytes, string_bytes, strings, text_or_empty

#: Texts in which a space does not stand alone, or with control characters on which libraries differ, are not split.
UNSAFE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}-\x{202f}\x{205f}\x{3000}] |[\x{1c}-\x{1f}\x{85}\x{180e}\x{200b}]| $"
#: Pieces of these characters only are cut alike by both libraries, whatever Unicode version each knows.
latin = re.compile("[\t\n -~¡-ɏ]*").fullmatch
#: Pieces kept in a worker's memory (twice as many at most), and the longest one kept.
KEPT, LONGEST = 400_000, 64


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, without added tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = spec.get("pre_tokenizer") or {}
        self.splits = (
            spec.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True)
            and not cut.get("add_prefix_space") and not any(x["lstrip"] or x["rstrip"] or x["normalized"] for x in spec["added_tokens"])
        )
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.ranks = self._ranks(path.removesuffix(".json") + ".tiktoken")
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def _ranks(path: str):
        """The same vocabulary as ranks, where the file is there: faster on single pieces."""
        if not os.path.exists(path):
            return None
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coder = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return coder.encode_ordinary

    def texts(self, texts: list[str]) -> list[bytes]:
        """Whole texts by the library itself."""
        return [np.array(e.ids, "<u4").tobytes() for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, pieces: list[str]) -> list[bytes]:
        """Pieces without special strings, which come again and again; those seen before are looked up."""
        if len(self.kept) > KEPT:
            self.kept, self.older = {}, self.kept
        kept, older, ranks = self.kept, self.older, self.ranks
        out = [kept.get(p) for p in pieces]
        new = [i for i, ids in enumerate(out) if ids is None]
        slow = []
        for i in new:
            piece = pieces[i]
            ids = older.get(piece)
            if ids is None:
                if ranks is None or not latin(piece):
                    slow.append(i)
                    continue
                ids = array("I", ranks(piece)).tobytes()
            out[i] = ids
            if len(piece) <= LONGEST:
                kept[piece] = ids
        for i, ids in zip(slow, self.texts([pieces[i] for i in slow]) if slow else (), strict=True):
            out[i] = ids
            if len(pieces[i]) <= LONGEST:
                kept[pieces[i]] = ids
        return out

    def batch(self, texts: pa.Array) -> tuple[pa.LargeBinaryArray, np.ndarray]:
        """Ids of the pieces of all ``texts`` in order, and the offsets of each text's pieces."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        whole = pc.match_substring_regex(texts, UNSAFE) if self.splits else pa.array([True] * len(texts))
        for special in self.special if self.splits else ():
            whole = pc.or_(whole, pc.match_substring(texts, special))
        odd = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        lists = pc.split_pattern(pc.if_else(whole, "", texts), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        index = coded.indices.to_numpy().astype(np.int64)
        table = self.pieces([" " + p for p in strings(coded.dictionary)])
        # The first piece of a text has no space before it.
        firsts = strings(lists.flatten().take(pa.array(offsets[:-1])))
        index[offsets[:-1]] = len(table) + np.arange(len(firsts))
        ends = self.pieces(firsts)
        for i, ids in zip(odd, self.texts(strings(texts.take(pa.array(odd)))) if len(odd) else (), strict=True):
            ends[i] = ids
        return pa.array(table + ends, pa.large_binary()).take(pa.array(index)), offsets

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        pieces, offsets = self.batch(texts)
        ends = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
        data = np.frombuffer(pieces.buffers()[2] or b"", "<u4")
        cuts = ends[offsets] // 4
        return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def counts(self, texts: pa.Array) -> np.ndarray:
        pieces, offsets = self.batch(texts)
        ends = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
        return np.diff(ends[offsets]) // 4


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    return Encoder(path)


@lru_cache(maxsize=2)
def sentence_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", batch_bytes: int = 8 << 20) -> DataFrame:
    """(key, n_bytes, n_tokens) of every row, as the library of the file gives them; only lengths leave the workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", batch_bytes):
            texts = batch.column(1)
            if tokenizer.endswith(".model"):
                n = np.array([len(x) for x in sentence_model(tokenizer).encode(strings(texts), num_threads=1)], np.int64)
            else:
                n = encoder(tokenizer).counts(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(string_bytes(texts)), pa.array(n.astype(np.int64))], [key, "n_bytes", "n_tokens"]
            )

    kind = docs.schema[key].dataType.simpleString()
    narrow = docs.select(F.col(key), text_or_empty(text).alias("text"))
    return narrow.mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long")
