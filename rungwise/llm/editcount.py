"""Token counts of edited documents (operator 10).

A document is kept as a row of pre-token segments: stretches of about ``LEAF_CHARS`` characters that
end where the split pattern always starts a new match, each with its character and token count.
``Tree`` holds their sums in a binary segment tree. An edit finds the segments it touches plus the
ones holding the characters just before and after it (the boundary context), so the cuts at both
ends of that region stay valid; only the region is encoded again, and the sums above it are updated.
Counts therefore always equal those of encoding the whole edited text.

``build`` writes the segments as two array columns, so a later run need not encode what no edit
touches; ``apply`` reads them, applies a column of edits and returns the new state.

Defined cases: a null text is empty; edits are applied in order, each on the text the one before
left, positions in code points and clipped to the text; an edit with a null position and a null
array or element change nothing, a null replacement deletes; the order of ties is that of the
array; repeated rows are independent; an empty table gives an empty table; other columns are passed
through, and output columns replace columns of the same name.
"""

from __future__ import annotations

import re

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rungwise.llm import bpe
from rungwise.llm.common import map_arrow

LEAF_CHARS = 256
_CUT = re.compile(f"(?<=[^{bpe.SPACE}])(?=[{bpe.SPACE}])")

EDITS = "array<struct<start:int,end:int,text:string>>"


def leaves(text: str) -> list[str]:
    """The text in stretches that encode separately, each of LEAF_CHARS characters at least."""
    out, at = [], 0
    while len(text) - at > LEAF_CHARS:
        cut = _CUT.search(text, at + LEAF_CHARS)
        if cut is None:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    if at < len(text):
        out.append(text[at:])
    return out


class Tree:
    """Sums of characters and tokens over the segments of one document."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self._grow(chars, tokens)

    def _grow(self, chars: list[int], tokens: list[int]) -> None:
        self.n = len(chars)
        self.width = 1 << max(0, self.n - 1).bit_length()
        pad = [0] * (self.width - self.n)
        self.chars = [0] * self.width + list(chars) + pad
        self.tokens = [0] * self.width + list(tokens) + pad
        for i in range(self.width - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def leaf_chars(self) -> list[int]:
        return self.chars[self.width : self.width + self.n]

    def leaf_tokens(self) -> list[int]:
        return self.tokens[self.width : self.width + self.n]

    def find(self, place: int) -> tuple[int, int]:
        """The segment holding character ``place``, and where it starts."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if place >= start + self.chars[node]:
                start += self.chars[node]
                node += 1
        return node - self.width, start

    def put(self, first: int, last: int, chars: list[int], tokens: list[int]) -> None:
        """Replace segments first..last; the shape changes only if there are more than before."""
        if len(chars) > last - first + 1:
            old_c, old_t = self.leaf_chars(), self.leaf_tokens()
            self._grow(old_c[:first] + chars + old_c[last + 1 :], old_t[:first] + tokens + old_t[last + 1 :])
            return
        gap = [0] * (last - first + 1 - len(chars))
        for k, (c, t) in enumerate(zip(chars + gap, tokens + gap, strict=True)):
            node = self.width + first + k
            up_c, up_t = c - self.chars[node], t - self.tokens[node]
            while node and (up_c or up_t):
                self.chars[node] += up_c
                self.tokens[node] += up_t
                node //= 2


class Document:
    """A text with its tree."""

    def __init__(self, text: str, own: tiktoken.Encoding, chars=None, tokens=None):
        self.text, self.own, self.encoded = text, own, 0
        if chars is None or tokens is None or sum(chars) != len(text):
            cut = leaves(text)
            chars, tokens = [len(x) for x in cut], [self._count(x) for x in cut]
        self.tree = Tree(chars or [0], tokens or [0])

    def _count(self, part: str) -> int:
        self.encoded += len(part)
        return len(bpe.encode_text(part, self.own))

    def tokens(self) -> int:
        return self.tree.tokens[1]

    def edit(self, start: int, end: int, new: str) -> None:
        size = len(self.text)
        start = min(max(start, 0), size)
        end = min(max(end, start), size)
        if start == end and not new:
            return
        if not size:
            first = last = low = high = 0
        else:
            first, low = self.tree.find(max(start - 1, 0))
            last, high = self.tree.find(min(end, size - 1))
            high += self.tree.chars[self.tree.width + last]
        region = self.text[low:start] + new + self.text[end:high]
        self.text = self.text[:low] + region + self.text[high:]
        cut = leaves(region)
        self.tree.put(first, last, [len(x) for x in cut], [self._count(x) for x in cut])


def _schema(df: DataFrame, added: list[T.StructField]) -> tuple[T.StructType, list[str]]:
    names = {f.name for f in added}
    kept = [f for f in df.schema.fields if f.name not in names]
    return T.StructType(kept + added), [f.name for f in kept]


def build(df: DataFrame, rank_file: str, text: str = "text") -> DataFrame:
    """``df`` with leaf_chars and leaf_tokens: the segments of every whole text."""
    numbers = T.ArrayType(T.IntegerType(), False)
    schema, kept = _schema(df, [T.StructField("leaf_chars", numbers), T.StructField("leaf_tokens", numbers)])

    def kernel(batches):
        own = bpe.encoding(rank_file)
        for batch in batches:
            chars, tokens = [], []
            for x in batch.column(text).to_pylist():
                cut = leaves(x or "")
                chars.append([len(p) for p in cut])
                tokens.append([len(bpe.encode_text(p, own)) for p in cut])
            arrays = [pa.array(v, pa.list_(pa.int32())) for v in (chars, tokens)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *arrays], names=schema.names)

    return map_arrow(df, kernel, schema)


def apply(df: DataFrame, edits: str, rank_file: str, text: str = "text") -> DataFrame:
    """The state after the edits: text, leaf_chars, leaf_tokens are replaced; n_tokens_before,
    n_tokens, and encoded_chars (characters encoded again) are added, the column of edits goes."""
    numbers = T.ArrayType(T.IntegerType(), False)
    added = [
        T.StructField(text, T.StringType()), T.StructField("leaf_chars", numbers), T.StructField("leaf_tokens", numbers),
        T.StructField("n_tokens_before", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("encoded_chars", T.LongType()),
    ]
    schema, kept = _schema(df.drop(edits), added)
    kinds = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64()]

    def kernel(batches):
        own = bpe.encoding(rank_file)
        for batch in batches:
            rows = []
            columns = [batch.column(c).to_pylist() for c in (text, "leaf_chars", "leaf_tokens", edits)]
            for x, chars, tokens, changes in zip(*columns, strict=True):
                doc = Document(x or "", own, chars, tokens)
                before = doc.tokens()
                for change in changes or ():
                    if change and change["start"] is not None and change["end"] is not None:
                        doc.edit(change["start"], change["end"], change["text"] or "")
                rows.append((doc.text, doc.tree.leaf_chars(), doc.tree.leaf_tokens(), before, doc.tokens(), doc.encoded))
            made = [pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], names=schema.names)

    return map_arrow(df, kernel, schema)


def derived_edits(id_column: str = "doc_id", text: str = "text") -> Column:
    """Four edits per document, derived from its id and text: an insertion, a deletion, a
    replacement by the same characters in upper case, and an appended line."""
    size = F.coalesce(F.length(text), F.lit(0))
    number = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    place = lambda k: F.pmod(F.xxhash64(number, F.lit(k)), (size + 1).cast("long")).cast("int")
    one = lambda start, end, new: F.struct(start.alias("start"), end.alias("end"), new.alias("text"))
    words = F.upper(F.substring(F.col(text), place(3) + 1, F.lit(11)))
    return F.array(
        one(place(1), place(1), F.concat(F.lit(" revised "), number)),
        one(place(2), place(2) + 7, F.lit("")),
        one(place(3), place(3) + 11, words),
        one(F.lit(2**31 - 1), F.lit(2**31 - 1), F.concat(F.lit("\nSee also "), number, F.lit("."))),
    ).cast(EDITS)
