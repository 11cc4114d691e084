"""Token counts with a whole-token shortcut.

Offline, every vocabulary string is encoded alone: those that are one pre-token and come out as one token are proven
whole. A text's pre-tokens that are in this set count one each; only the others go through the merges, and a bounded
table remembers what they gave.

Null texts count as empty: 0 bytes, 0 tokens. Each row is counted by its text alone, so null or repeated ids, repeated
rows and extra columns change nothing. An empty table gives an empty result. Texts are counted whole, without limit.
"""

from __future__ import annotations

import json
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Fixed value: the pre-token pattern of byte-level BPE vocabularies of this family.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens that aren't whole whose counts a worker remembers; the table starts anew when it is full.
REMEMBERED = 200_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 stands for itself, the rest follow from code point 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


def _checked(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError(f"{path}: only byte-level BPE without a normalizer or prefix space is supported")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        raise ValueError(f"{path}: added tokens that take in white space aren't supported")
    return spec


def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings that are one pre-token and encode alone as one token; at most as many as the vocabulary has."""
    spec, model, pattern = _checked(path), Tokenizer.from_file(path).model, regex.compile(PRE_TOKEN)
    value = {c: b for b, c in enumerate(byte_letters())}
    special, whole = {t["content"] for t in spec["added_tokens"]}, []
    for piece in spec["model"]["vocab"]:
        if piece in special:
            continue
        try:
            text = bytes(value[c] for c in piece).decode()
        except UnicodeDecodeError:
            continue  # part of a character: never a pre-token of its own
        if pattern.fullmatch(text) and pattern.findall(text) == [text] and len(model.tokenize(piece)) == 1:
            whole.append(text)
    return frozenset(whole)


class Counter(dict):
    """Tokens of a pre-token: 1 for whole ones, else what the merges give."""

    def __init__(self, path: str, whole: frozenset[str]) -> None:
        super().__init__(dict.fromkeys(whole, 1))
        self.whole, self.letters = whole, byte_letters()
        self.model = Tokenizer.from_file(path).model
        special = [regex.escape(t["content"]) for t in _checked(path)["added_tokens"]]
        self.special = regex.compile("|".join(sorted(special, key=len, reverse=True))) if special else None
        self.find = regex.compile(PRE_TOKEN).findall

    def __missing__(self, piece: str) -> int:
        if len(self) > len(self.whole) + REMEMBERED:
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))
        letters = self.letters
        n = len(self.model.tokenize("".join([letters[b] for b in piece.encode()])))
        if len(piece) < 64:
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        """Tokens of a text; an added token's string inside it is one token, and no pre-token crosses it."""
        parts = self.special.split(text) if self.special else [text]
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.find(part))) for part in parts)


@lru_cache(maxsize=2)
def _counter(path: str, whole: frozenset[str]) -> Counter:
    return Counter(path, whole)


def token_count(text: Column, path: str) -> Column:
    """Tokens of each text under the byte-level BPE vocabulary at `path`, which every executor has."""
    whole = whole_tokens(path)

    def count(texts: pa.Array) -> pa.Array:
        counter = _counter(path, whole)
        return pa.array([counter.count(x.as_py() or "") for x in texts], pa.int64())

    return F.arrow_udf(count, "long").asNondeterministic()(text)


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, UTF-8 bytes, tokens, and whether the tokens exceed `limit`, for every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), token_count(text, path).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
