"""Sizes of texts in tokens of a public byte-level vocabulary."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Place of the vocabulary's rank file; a parameter everywhere.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the public vocabulary's texts are cut before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def tokenizer(vocabulary: str = VOCABULARY):
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: White space of a length that the library's own pattern can't take in one run.
LONG_SPACE = re.compile(r"[^\S\x1c-\x1f]{10000,}")


def tokens_of(enc, text: str) -> list[int]:
    """Tokens of a text of any length. Long runs of white space are cut off first, where the pattern cuts too: before the
    run, and before its last character if more text follows."""
    if len(text) < 10_000 or not LONG_SPACE.search(text):
        return enc.encode_ordinary(text)
    out, at = [], 0
    for run in LONG_SPACE.finditer(text):
        end = run.end() - (run.end() < len(text))
        out += enc.encode_ordinary(text[at : run.start()])
        out += enc._encode_single_piece(text[run.start() : end].encode())
        at = end
    return out + enc.encode_ordinary(text[at:])


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Number of tokens of the whole text as bigint; null for null, 0 for an empty text.

    Declared nondeterministic, so that a filter on the count isn't moved below it, which would count twice."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = tokenizer(vocabulary)
        for texts in batches:
            yield pd.Series([None if t is None else len(tokens_of(enc, t)) for t in texts], dtype="Int64")

    return count.asNondeterministic()(text)


def pieces_of(text: str, starts: list[int], vocabulary: str = VOCABULARY) -> list[str]:
    """The texts of the tokens from each start (in rising order, the first 0) up to the next; together they are the text.
    A character cut by an end is in the piece that has its first byte."""
    if len(starts) == 1:
        return [text]
    enc = tokenizer(vocabulary)
    data, at, ids = text.encode(), 0, tokens_of(enc, text)
    edges = []
    for start, end in zip([0, *starts[1:]], [*starts[1:], len(ids)]):
        edges.append(at)
        at += len(enc.decode_bytes(ids[start:end]))
    # On to the next first byte of a character.
    edges = [next((i for i in range(e, min(len(data), e + 4)) if data[i] & 0xC0 != 0x80), len(data)) for e in edges]
    return [data[i:j].decode() for i, j in zip(edges, [*edges[1:], len(data)])]


def piece_of(text: str, start: int, end: int, vocabulary: str = VOCABULARY) -> str:
    """The tokens start..end - 1 of a text as text, cut as by pieces_of."""
    n = len(tokens_of(tokenizer(vocabulary), text))
    starts = sorted({0, min(start, n), min(end, n)})
    return pieces_of(text, starts, vocabulary)[starts.index(min(start, n))] if start < min(end, n) else ""
