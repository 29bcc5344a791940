"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Texts are encoded by Arrow batches. A long text is first cut by a regular expression where the split pattern
certainly ends a match: between a non-blank and a blank, or where an ASCII letter meets an ASCII digit. No
match spans such a place and no match looks behind itself, so the pieces' ids joined are the whole text's ids.
Decoding joins the tokens' raw bytes, which need not be valid UTF-8 one by one.

Defined results: null or empty texts have no ids and decode to no bytes; repeated rows are encoded each;
other columns may be carried along; an empty table gives an empty result. A run without any safe place is
encoded in one piece.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, table, text_of

RANKS = "byte_bpe_50k.tiktoken"
#: Characters encoded at once.
PIECE_CHARS = 1 << 16
#: Where a match of the split pattern always ends.
SAFE = re.compile(r"(?<=[A-Za-z0-9.,;:!?])(?=[ \n])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")

_encodings: dict = {}


def encoding(path: str, pattern: str = public_tokenizers.PATTERN):
    """The tiktoken encoding of a rank file, kept per Python worker."""
    if (path, pattern) not in _encodings:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _encodings[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path, pattern]


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """The text in pieces of about ``size`` characters, cut at safe places only."""
    start = 0
    while len(text) - start > size:
        found = SAFE.search(text, start + size)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def encode(docs: DataFrame, text_col: str = "text", ranks: str | None = None, decode: bool = False, size: int = PIECE_CHARS) -> DataFrame:
    """(doc_id, n_tokens, ids) of (doc_id, text) rows; ids are packed little-endian unsigned 32-bit integers. With ``decode``,
    also ``decoded``: the bytes that decoding those ids gives."""
    path = ranks or public_tokenizers.path(RANKS)
    fields = [pa.field("doc_id", pa.int64()), pa.field("n_tokens", pa.int64()), pa.field("ids", pa.binary())]
    ddl = "doc_id long, n_tokens long, ids binary"
    if decode:
        fields, ddl = [*fields, pa.field("decoded", pa.binary())], ddl + ", decoded binary"
    schema = pa.schema(fields)

    def run(batches):
        enc = encoding(path)
        for part, _, _ in blocks(batches, text_col):
            counts, packed, back = [], [], []
            for text in part.column(part.schema.get_field_index(text_col)).to_pylist():
                ids = [np.array(enc.encode_ordinary(p), dtype="<u4") for p in pieces(text or "", size)]
                ids = ids[0] if len(ids) == 1 else np.concatenate(ids)
                counts.append(len(ids))
                packed.append(ids.tobytes())
                if decode:
                    back.append(enc.decode_bytes(ids.tolist()))
            arrays = [part.column(part.schema.get_field_index("doc_id")), pa.array(counts, pa.int64()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(back, pa.binary())] if decode else arrays, schema=schema)

    return docs.mapInArrow(run, ddl)


def decode(tokens: DataFrame, ids_col: str = "ids", ranks: str | None = None) -> DataFrame:
    """(doc_id, decoded) of packed ids; null ids decode to no bytes."""
    path = ranks or public_tokenizers.path(RANKS)
    schema = pa.schema([("doc_id", pa.int64()), ("decoded", pa.binary())])

    def run(batches):
        enc = encoding(path)
        for part, _, _ in blocks(batches, ids_col):
            back = [enc.decode_bytes(np.frombuffer(x or b"", dtype="<u4").tolist()) for x in part.column(part.schema.get_field_index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), pa.array(back, pa.binary())], schema=schema)

    return tokens.mapInArrow(run, "doc_id long, decoded binary")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


def digests(docs: DataFrame) -> DataFrame:
    return encode(text_of(docs), decode=True).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
