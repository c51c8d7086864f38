"""Byte-level BPE with the tiktoken library: encode whole texts, decode back to raw bytes.

The rank file is a parameter and stays where the cluster has it; each Python worker loads it once. Texts longer than
`piece_chars` are first cut where no match of the splitting pattern can reach across: before a blank or newline that
follows a letter or digit, or else between a letter and a digit. The ids of the pieces, joined, are the ids of the
whole text. A text without such a place stays one piece.

Long runs of white space are taken out first. Of a run before another character the pattern matches all but the last
character at once, and all of a run that ends the text; tiktoken's matcher backtracks over the run to find that out
and runs out of stack at about a million. The match is merged as one piece of bytes instead, which is what the library
does with it after matching.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.text import packed, slices, utf8

PIECE_CHARS = 50_000
RUN_CHARS = 10_000
#: No alternative of the pattern goes from a letter or digit on to white space, nor between letters and digits.
SAFE = regex.compile(r"(?<=[\p{L}\p{N}])(?=[ \n])|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")

#: White space as the library's pattern language sees it.
LONG_RUN = regex.compile(r"\p{White_Space}{%d,}" % RUN_CHARS)


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, most: int = PIECE_CHARS) -> list[str]:
    """The text cut at safe places, each piece at least `most` characters long but for the last."""
    out, start = [], 0
    while len(text) - start > most:
        found = SAFE.search(text, start + most)
        if found is None or found.start() >= len(text):
            break
        out.append(text[start : found.start()])
        start = found.start()
    return [*out, text[start:]]


def encode(text: str, enc: tiktoken.Encoding, most: int = PIECE_CHARS) -> list[int]:
    """Ids of a whole text, however long it or any run in it is."""
    if len(text) <= most:
        return enc.encode_ordinary(text)
    out, start = [], 0
    for run in LONG_RUN.finditer(text):
        out += [i for piece in pieces(text[start : run.start()], most) for i in enc.encode_ordinary(piece)]
        start = run.end() if run.end() == len(text) else run.end() - 1
        out += enc._encode_single_piece(text[run.start() : start].encode())
    return out + [i for piece in pieces(text[start:], most) for i in enc.encode_ordinary(piece)]


def decode(ids, enc: tiktoken.Encoding) -> bytes:
    """Raw bytes: a sequence of ids need not be valid UTF-8."""
    return enc.decode_bytes(list(ids))


def tokenized(df: DataFrame, path: str, pattern: str, text: str = "text", piece_chars: int = PIECE_CHARS) -> DataFrame:
    """(`row`, `ids` array<int>, `decoded` binary): `row` holds all columns of `df`, one output row per input row.

    NULL and empty texts have no ids and decode to no bytes. Bytes that are not UTF-8 are read as U+FFFD. Very long
    texts are whole texts too, also where they are one run of white space.
    Repeated rows stay repeated; columns of any name are carried inside `row`.
    """

    def encoded(batches):
        enc = encoding(path, pattern)
        for batch in (part for whole in batches for part in slices(whole)):
            ids = [encode(t.decode("utf-8", "replace"), enc, piece_chars) for t in batch.column("bytes").to_pylist()]
            out = [pa.array(ids, pa.list_(pa.int32())), pa.array([decode(i, enc) for i in ids], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *out], names=["row", "ids", "decoded"])

    rows = packed(df, bytes=utf8(f"`{text}`"))
    more = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())]
    return rows.mapInArrow(encoded, T.StructType([rows.schema["row"], *more]))


def token_digests(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", piece_chars: int = PIECE_CHARS) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) per row of `df`; ids are hashed as little-endian 32-bit integers."""

    def digests(batches):
        enc = encoding(path, pattern)
        for batch in (part for whole in batches for part in slices(whole)):
            counts, of_ids, of_bytes = [], [], []
            for data in batch.column("bytes").to_pylist():
                ids = encode(data.decode("utf-8", "replace"), enc, piece_chars)
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest())
                of_bytes.append(hashlib.sha256(decode(ids, enc)).hexdigest())
            out = [pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *out], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = df.select(F.col(f"`{key}`"), utf8(f"`{text}`").alias("bytes"))
    more = [T.StructField("n_tokens", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("ids_sha256", "decoded_sha256"))]
    return rows.mapInArrow(digests, T.StructType([rows.schema[0], *more]))
