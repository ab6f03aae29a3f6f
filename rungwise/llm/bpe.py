"""Byte-level BPE encoding and decoding (operator 1).

The rank file is read once per Python worker process and handed to the ``tiktoken`` library. Long
texts are cut before they reach it: at places where the split pattern always starts a new match,
that is between a character that is not white space and one that is. Runs of white space too long
for the library's regex engine are split by rule (all but the last character form one match if
something follows). Pieces are encoded on their own and their ids joined, so results equal one call
over the whole text. Decoding concatenates the raw bytes of the ids and never needs valid UTF-8.

Defined cases: a null text counts as empty (no ids, empty bytes); a null list of ids decodes to
null; repeated rows and null ids are kept as they are; an empty table gives an empty table; columns
other than the named ones are passed through by ``encode`` and ``decode`` (the output column
replaces one of the same name).
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rungwise.llm.common import map_arrow

RANKS = "byte_bpe_50k.tiktoken"
#: Texts are handed to the library in parts of about so many characters.
PART_CHARS = 1 << 16
#: White-space runs of at least this length are split by rule.
LONG_SPACE = 512

# The characters with the Unicode property White_Space.
_WIDE = [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SPACE = "\t\n\x0b\x0c\r \x85\xa0" + "".join(map(chr, _WIDE))
_LONG = re.compile(f"[{SPACE}]{{{LONG_SPACE},}}")
_EDGE = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")

_ENCODINGS: dict[str, tiktoken.Encoding] = {}


def encoding(rank_file: str) -> tiktoken.Encoding:
    """The encoding of a local rank file, built once per process."""
    if rank_file not in _ENCODINGS:
        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _ENCODINGS[rank_file] = tiktoken.Encoding(
            rank_file, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
    return _ENCODINGS[rank_file]


def parts(text: str) -> Iterator[tuple[str, bool]]:
    """(part, single): parts that encode separately; ``single`` ones are one match of the pattern."""
    at = 0
    for run in _LONG.finditer(text):
        last = run.end() - (run.end() < len(text))
        yield from ((p, False) for p in _cut(text, at, run.start()))
        yield text[run.start() : last], True
        at = last
    yield from ((p, False) for p in _cut(text, at, len(text)))


def _cut(text: str, at: int, end: int) -> Iterator[str]:
    while end - at > PART_CHARS:
        edge = _EDGE.search(text, at + PART_CHARS, end)
        if edge is None:
            break
        yield text[at : edge.start()]
        at = edge.start()
    if at < end:
        yield text[at:end]


def encode_text(text: str | None, own: tiktoken.Encoding) -> list[int]:
    if not text:
        return []
    if len(text) <= PART_CHARS and not _LONG.search(text):
        return own.encode_ordinary(text)
    ids: list[int] = []
    for part, single in parts(text):
        ids += own._encode_single_piece(part) if single else own.encode_ordinary(part)
    return ids


def _replaced(df: DataFrame, column: str, kind: T.DataType) -> T.StructType:
    fields = [f for f in df.schema.fields if f.name != column]
    return T.StructType([*fields, T.StructField(column, kind)])


def encode(
    df: DataFrame, rank_file: str, text: str = "text", ids: str = "ids"
) -> DataFrame:
    """``df`` with the token ids of ``text`` in ``ids`` (array of int)."""
    schema = _replaced(df, ids, T.ArrayType(T.IntegerType(), False))

    def kernel(batches):
        own = encoding(rank_file)
        for batch in batches:
            found = [encode_text(x, own) for x in batch.column(text).to_pylist()]
            keep = [i for i, n in enumerate(batch.schema.names) if n != ids]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in keep), pa.array(found, pa.list_(pa.int32()))],
                names=[*(batch.schema.names[i] for i in keep), ids],
            )

    return map_arrow(df, kernel, schema)


def decode(df: DataFrame, rank_file: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the raw bytes of ``ids`` in ``out`` (binary)."""
    schema = _replaced(df, out, T.BinaryType())

    def kernel(batches):
        own = encoding(rank_file)
        for batch in batches:
            found = [None if x is None else own.decode_bytes(x) for x in batch.column(ids).to_pylist()]
            keep = [i for i, n in enumerate(batch.schema.names) if n != out]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in keep), pa.array(found, pa.binary())],
                names=[*(batch.schema.names[i] for i in keep), out],
            )

    return map_arrow(df, kernel, schema)


def round_trip(
    df: DataFrame, rank_file: str, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Encode, decode and digest in one pass, so that ids never leave the worker.

    Columns: the id, n_tokens, ids_sha256 (of the decimal ids joined by one space), decoded_sha256.
    One row per input row.
    """
    picked = df.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    kind = picked.schema["id"].dataType.simpleString()

    def kernel(batches):
        own = encoding(rank_file)
        decimal = [str(i) for i in range(own.max_token_value + 1)]
        sha = hashlib.sha256
        for batch in batches:
            n, first, second = [], [], []
            for text in batch.column(1).to_pylist():
                ids = encode_text(text, own)
                n.append(len(ids))
                first.append(sha(" ".join([decimal[i] for i in ids]).encode()).hexdigest())
                second.append(sha(own.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(first), pa.array(second)],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_arrow(picked, kernel, schema).withColumnRenamed("id", id_column)
