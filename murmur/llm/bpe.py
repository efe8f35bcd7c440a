"""Byte-level BPE with the tiktoken library and a local rank file.

``encode`` adds ``token_ids`` (ids as little-endian unsigned 32-bit integers) and ``n_tokens``; ``decode`` turns ids
back into raw bytes. Long texts are cut at boundaries that no match of the split pattern crosses, so pieces encode
separately to the ids of the whole.

Edge cases: a null text encodes like the empty one, to no ids; null ids decode to no bytes; repeated rows are encoded
each; an empty table gives an empty table; all further columns pass through, except that columns named like an output
are replaced. Very long texts and very long runs of white space or letters are handled piecewise.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Texts up to so many characters go to the library whole.
WHOLE = 50_000
#: A match of the pattern longer than this is merged directly, without the library's own regular expression.
LONG_MATCH = 20_000


@functools.lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=1)
def _pattern():
    return regex.compile(public_tokenizers.PATTERN)


def cuts(text: str, step: int = WHOLE):
    """Safe boundaries about ``step`` apart: before a space or line feed that follows a character which isn't white space.

    No alternative of the pattern goes from another character on to white space, and none looks back.
    """
    at = 0
    while len(text) - at > step:
        for i in range(at + step, len(text)):
            if text[i] in " \n" and not text[i - 1].isspace():
                break
        else:
            break
        yield text[at:i]
        at = i
    yield text[at:]


def encode_text(enc, text: str) -> list[int]:
    if len(text) <= WHOLE:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for piece in cuts(text):
        if len(piece) <= 2 * WHOLE:
            ids += enc.encode_ordinary(piece)
        else:  # no boundary for long: match by match, and long matches straight to the merges
            for m in _pattern().finditer(piece):
                part = m.group()
                ids += enc.encode_ordinary(part) if len(part) <= LONG_MATCH else enc._encode_single_piece(part)
    return ids


def encode(df: DataFrame, rank_file: str = RANKS, text: str = "text") -> DataFrame:
    path = public_tokenizers.path(rank_file)

    @F.pandas_udf(T.BinaryType())
    def ids_of(texts: pd.Series) -> pd.Series:
        enc = encoding(path)
        return pd.Series([np.array(encode_text(enc, t), dtype="<u4").tobytes() if t else b"" for t in texts], dtype=object)

    return df.withColumn("token_ids", ids_of(F.coalesce(F.col(text), F.lit("")))).withColumn("n_tokens", (F.octet_length("token_ids") / 4).cast("long"))


def decode(df: DataFrame, rank_file: str = RANKS, ids: str = "token_ids") -> DataFrame:
    """Adds ``decoded``: the raw bytes of the ids, which need not be valid UTF-8."""
    path = public_tokenizers.path(rank_file)

    @F.pandas_udf(T.BinaryType())
    def bytes_of(column: pd.Series) -> pd.Series:
        enc = encoding(path)
        return pd.Series([enc.decode_bytes(np.frombuffer(b, dtype="<u4").tolist()) if b else b"" for b in column], dtype=object)

    return df.withColumn("decoded", bytes_of(F.col(ids)))
