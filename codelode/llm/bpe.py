"""Byte-level BPE encoding and decoding by tree concatenation.

Texts of up to ``leaf_chars`` code points are encoded as they are. A longer text, whether or not white space splits it,
is halved until its pieces fit; the pieces are encoded in parallel and joined pairwise, level by level. A join re-encodes
a window around it and doubles the window until its encoding agrees with the left piece at its start and with the right
piece at its end, away from the join. Every pair of neighbouring tokens then occurs in an encoding of its own
surroundings, which makes the joined ids those of the whole text.

The window rests on three properties of the vocabulary's patterns: a match depends on what follows its start alone, it
looks at most a few characters ahead, and classes of characters end a run wherever it began (a window never starts at
an apostrophe). ``MARGIN`` bytes cover the longest special token and look-ahead.

Nulls and empty texts have no ids; ids of null decode to an empty text. Long texts are keyed by their digest, so
repeated rows and ids cost one encoding. Extra columns pass through; a column named as the ids is replaced, and names
starting with ``_bpe`` are reserved.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, tidy

#: The pattern of the byte-level pre-tokeniser (fixed value, from the tokenizers library).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF_CHARS = 32_768
MARGIN = 24
AGREE = 2


class Bpe:
    """Ids of whole texts, and texts of ids, for one byte-level vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre != {**pre, "type": "ByteLevel", "add_prefix_space": False, "use_regex": True} or spec["normalizer"]:
            raise ValueError("only plain byte-level BPE vocabularies are supported")
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        bytes_of = {chr(b): b for b in shown}
        bytes_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(bytes_of[c] for c in t): i for t, i in model["vocab"].items() if t not in self.special}
        merged = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        order = [model["vocab"][a + b] for a, b in merged]
        if order != sorted(order):
            raise ValueError("ids do not follow the order of merges")
        self.table: list[bytes] = [b""] * (1 + max([*ranks.values(), *self.special.values()]))
        for t, i in [*ranks.items(), *((t.encode(), i) for t, i in self.special.items())]:
            self.table[i] = t
        self.ranks, self._model = ranks, None

    @property
    def model(self):
        """The merging part, which is large; decoding does without."""
        if self._model is None:
            import tiktoken

            self._model = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens=self.special)
        return self._model

    def encode(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.model.encode(text, allowed_special="all")
        return self.model.encode_ordinary(text)

    def decode(self, ids) -> str:
        return b"".join(map(self.table.__getitem__, ids)).decode("utf-8", "replace")

    def _starts_char(self, token: int) -> bool:
        return self.table[token][0] & 0xC0 != 0x80

    def join(self, left: list[int], right: list[int], width: int = 16) -> list[int]:
        """The ids of the texts of ``left`` and ``right`` written one after the other."""
        table = self.table
        if not left or not right:
            return left + right
        while True:
            i, j = max(0, len(left) - width), min(len(right), width)
            while i and not (self._starts_char(left[i]) and table[left[i]][0] != 0x27):
                i -= 1
            while j < len(right) and not self._starts_char(right[j]):
                j += 1
            window = self.encode(b"".join(map(table.__getitem__, left[i:] + right[:j])).decode("utf-8"))
            whole_left, whole_right = i == 0, j == len(right)
            if (whole_left or self._agrees(window, left[i:])) and (whole_right or self._agrees(window[::-1], right[:j][::-1])):
                return left[:i] + window + right[j:]
            width *= 2

    def _agrees(self, window: list[int], side: list[int]) -> bool:
        """Whether the outermost tokens are the same, and end before the margin at the join."""
        size = sum(len(self.table[t]) for t in side)
        return window[:AGREE] == side[:AGREE] and size - sum(len(self.table[t]) for t in side[:AGREE]) >= MARGIN


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    return Bpe(path)


def _bytes(ids) -> bytes:
    return array("I", ids).tobytes()


def _ids(data: bytes) -> list[int]:
    return array("I", data).tolist()


def _encode_udf(path: str):
    @F.arrow_udf("binary")
    @tidy
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for texts in batches:
                bpe = load(path)
                yield pa.array([_bytes(bpe.encode(t.as_py() or "")) for t in texts], pa.binary())
        finally:
            load.cache_clear()  # the worker may go on to other stages

    return encode


def encode_texts(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """The input with ``ids_col``: ids as little-endian unsigned 32-bit integers."""
    docs = docs.drop(*[c for c in docs.columns if c == ids_col and c != text_col])
    text = F.coalesce(F.col(text_col), F.lit(""))
    encode = _encode_udf(path)
    short = docs.filter(F.length(text) <= leaf_chars).withColumn(ids_col, encode(text))
    long = docs.filter(F.length(text) > leaf_chars).withColumn("_bpe_key", F.sha2(text, 256))
    longest = long.agg(F.max(F.length(text))).first()[0]
    if longest is None:
        return short
    distinct = long.groupBy("_bpe_key").agg(F.first(text).alias("_bpe_text"))
    leaves = F.col("_bpe_n")
    nodes = (
        distinct.withColumn("_bpe_n", F.expr(f"shiftleft(1L, int(ceil(log2(length(_bpe_text) / double({leaf_chars})))))"))
        .withColumn("_bpe_at", F.explode(F.sequence(F.lit(0).cast("long"), leaves - 1)))
        .withColumn("_bpe_from", F.expr("_bpe_at * length(_bpe_text) div _bpe_n"))
        .withColumn("_bpe_to", F.expr("(_bpe_at + 1) * length(_bpe_text) div _bpe_n"))
        .select("_bpe_key", "_bpe_n", "_bpe_at", F.expr("substring(_bpe_text, int(_bpe_from) + 1, int(_bpe_to - _bpe_from))").alias("_bpe_leaf"))
        .repartition("_bpe_key", "_bpe_at")
        .select("_bpe_key", "_bpe_n", "_bpe_at", encode(F.col("_bpe_leaf")).alias("_bpe_ids"))
    )

    def joined(pair: pd.DataFrame) -> pd.DataFrame:
        bpe, pair = load(path), pair.sort_values("_bpe_at")
        ids = _ids(pair["_bpe_ids"].iloc[0])
        for more in pair["_bpe_ids"].iloc[1:]:
            ids = bpe.join(ids, _ids(more))
        return pd.DataFrame({"_bpe_key": pair["_bpe_key"].iloc[:1], "_bpe_n": pair["_bpe_n"].iloc[:1] // 2, "_bpe_at": pair["_bpe_at"].iloc[:1] // 2, "_bpe_ids": [_bytes(ids)]})

    done = None
    while longest > leaf_chars:
        # All trees are cut at powers of two, so a tree of n leaves is whole after log2(n) rounds.
        nodes = nodes.groupBy("_bpe_key", F.floor(F.col("_bpe_at") / 2).alias("_bpe_pair")).applyInPandas(
            lambda pair: joined(pair), "_bpe_key string, _bpe_n long, _bpe_at long, _bpe_ids binary"
        )
        nodes = materialize(nodes, "bpe")
        whole = nodes.filter("_bpe_n = 1").select("_bpe_key", F.col("_bpe_ids").alias(ids_col))
        done = whole if done is None else done.unionByName(whole)
        nodes = nodes.filter("_bpe_n > 1")
        longest = -(-longest // 2)
    return short.unionByName(long.join(done, "_bpe_key").drop("_bpe_key"))


def decode_ids(ids: Column, path: str) -> Column:
    """Text of ids as written by ``encode_texts``; bytes that are no UTF-8 become U+FFFD."""

    @F.arrow_udf("string")
    @tidy
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = load(path)
        for arrays in batches:
            yield pa.array([bpe.decode(_ids(a.as_py() or b"")) for a in arrays], pa.string())

    return decode(ids)
