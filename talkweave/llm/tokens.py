"""Token counts of a byte-level BPE, looking whole pre-tokens up instead of merging them.

A vocabulary string is proved once to be a single pre-token that the library encodes, alone, as one token.  Such
pre-tokens count one.  The others are merged by the library, each once per worker while a bounded memo holds it.
The split into pre-tokens is done by a pattern; characters on which it and the library's own splitter disagree
(new in one Unicode version) are found by trial, and texts that hold one, or a character not tried, are counted
by the library as a whole.  Added special tokens in a text are one token each, as the library has it by default.
"""

from __future__ import annotations

import json
import os
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

# Fixed value: the pattern by which byte-level BPE vocabularies of this family split a text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TRIED = ((0, 0xD800), (0xF900, 0xFE70), (0xFF00, 0xFFF0), (0x1F000, 0x1FB00))
MEMO = 200_000


def _pieces(tokenizer: Tokenizer) -> tuple[frozenset[str], str]:
    """Strings proved to be one token alone, and the class of characters on which both splitters agree."""
    split = regex.compile(SPLIT)
    theirs = tokenizer.pre_tokenizer.pre_tokenize_str
    agreed = []
    for low, high in TRIED:
        for code in range(low, high):
            c = chr(code)
            probe = f"a{c}1{c} {c}{c}!{c} b\n{c}\n"
            if [x[1] for x in theirs(probe)] == [m.span() for m in split.finditer(probe)]:
                agreed.append(code)
    texts = [t for t in tokenizer.decode_batch([[i] for i in range(tokenizer.get_vocab_size(False))], skip_special_tokens=False) if t and "\ufffd" not in t]
    whole = [t for t in texts if split.fullmatch(t) and len(theirs(t)) == 1]
    singles = frozenset(t for t, e in zip(whole, tokenizer.encode_batch(whole, add_special_tokens=False), strict=True) if len(e.ids) == 1)
    runs, start = [], None
    for i, code in enumerate(agreed):
        start = code if start is None else start
        if i + 1 == len(agreed) or agreed[i + 1] != code + 1:
            runs.append(rf"\U{start:08x}-\U{code:08x}")
            start = None
    return singles, "".join(runs)


class Counter(dict):
    """Tokens of a pre-token; ones not proved are merged by the library and remembered."""

    def __init__(self, source: str, singles: frozenset[str], agreed: str):
        super().__init__(dict.fromkeys(singles, 1))
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.least = len(self) + MEMO
        self.singles = singles
        self.whole = Tokenizer.from_str(source)
        self.merge = Tokenizer.from_str(source)
        self.merge.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.split = regex.compile(SPLIT).findall
        self.odd = regex.compile(f"[^{agreed}]").search
        special = [t["content"] for t in json.loads(source)["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.least:
            self.clear()
            self.update(dict.fromkeys(self.singles, 1))
        self[piece] = count = len(self.merge.encode(piece, add_special_tokens=False).ids)
        return count

    def count(self, text: str) -> int:
        if self.odd(text):
            return len(self.whole.encode(text, add_special_tokens=False).ids)
        if self.special is None or not self.special.search(text):
            return sum(map(self.__getitem__, self.split(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.split(p))) for p in parts)


@cache
def _counter(source: str, singles: frozenset[str], agreed: str) -> Counter:
    return Counter(source, singles, agreed)


def supported(tokenizer: Tokenizer) -> bool:
    """Byte-level BPE without normaliser and prefix space, split by the known pattern, with plain special tokens."""
    j = json.loads(tokenizer.to_str())
    pre = j["pre_tokenizer"] or {}
    plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in j["added_tokens"])
    return j["normalizer"] is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and plain


def token_count(spark: SparkSession, text: Column, path: str) -> Column:
    """Tokens of each text; a null text has none.  ``path`` is read by the driver alone and sent on.

    What is sent is bounded by the vocabulary: its file, the proved strings and the characters tried.
    """
    tokenizer = Tokenizer.from_file(path)
    if not supported(tokenizer):
        raise ValueError("the shortcut is proved for byte-level BPE with the known split only")
    sent = spark.sparkContext.broadcast((tokenizer.to_str(), *_pieces(tokenizer)))

    @F.arrow_udf("bigint")
    def count(column: pa.Array) -> pa.Array:
        counter = _counter(*sent.value)
        return pa.array([counter.count(t) if t else 0 for t in column.to_pylist()], pa.int64())

    return count(text)
