"""Token ids in sorted-string-table shards.

Documents are dealt out by ranges of their id, sorted, encoded with the tokenizers library and written by the
tasks as shard files on the shared folder (through pyarrow's file systems, under a temporary name that is then
renamed, so a task that runs twice leaves one whole file). A shard is:

  data blocks   entries sorted by key; a key shares a stated number of bytes with the one before, and every
                RESTART entries one is whole. entry: varint shared, varint rest, varint value bytes, rest, value.
                After the entries: the restarts' offsets (u32 each), their number (u32), crc32 of all that.
  index         an entry a block: key length (u32), last key, offset (u64), length (u64)
  Bloom filter  hashes (u32), bits
  footer        offset and length of index and filter, documents, ids (u64 each), bytes an id (u32), magic

A key is one byte 1 and the id as 8 big-endian bytes with the sign flipped, which sorts as the ids do; a null id
is the byte 0 alone and comes first. Rows repeating an id are all kept, in the order of their texts. Null texts
count as empty and have only the end id. An empty table gives no shards. Other columns are ignored.
"""

from __future__ import annotations

import array
import bisect
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, scratch, table, tasks_for, text_of

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
MAGIC = b"SPANSST1"
FOOTER = struct.Struct("<QQQQQQI8s")
BLOCK_BYTES, SHARD_BYTES, RESTART, BITS_A_KEY, HASHES = 32 << 10, 64 << 20, 16, 10, 7
#: Words whose ids a worker remembers; common words come early, so they are among them.
WORDS_KEPT = 800_000


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else int.from_bytes(key[1:], "big") - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def bloom_places(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + i * b) % bits for i in range(HASHES)]


class ShardWriter:
    """Writes entries, which must come in the order of their keys, to a binary stream."""

    def __init__(self, out, id_bytes: int = 4):
        self.out, self.id_bytes, self.at = out, id_bytes, 0
        self.index, self.keys, self.n_ids = [], [], 0
        self._open()

    def _open(self) -> None:
        self.block, self.restarts, self.last, self.n = bytearray(), [], b"", 0

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.n % RESTART:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(len(self.block))
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:]
        self.block += value
        self.last, self.n = key, self.n + 1
        self.keys.append(key)
        self.n_ids += len(value) // self.id_bytes
        if len(self.block) >= BLOCK_BYTES:
            self._close()

    def _close(self) -> None:
        if self.n:
            body = bytes(self.block) + struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))
            body += struct.pack("<I", zlib.crc32(body))
            self.out.write(body)
            self.index.append((self.last, self.at, len(body)))
            self.at += len(body)
        self._open()

    def finish(self) -> int:
        """Writes index, filter and footer; the file's size."""
        self._close()
        index = b"".join(struct.pack("<I", len(k)) + k + struct.pack("<QQ", at, n) for k, at, n in self.index)
        bits = max(64, BITS_A_KEY * len(self.keys))
        bloom = np.zeros((bits + 7) // 8 * 8, dtype=np.uint8)
        for key in self.keys:
            bloom[bloom_places(key, bits)] = 1
        bloom = struct.pack("<IQ", HASHES, bits) + np.packbits(bloom, bitorder="little").tobytes()
        self.out.write(index + bloom + FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), len(self.keys), self.n_ids, self.id_bytes, MAGIC))
        return self.at + len(index) + len(bloom) + FOOTER.size


class ShardReader:
    """Reads a shard from a seekable binary file: ``get`` looks one key up, ``scan`` gives all in order."""

    def __init__(self, file):
        self.file = file
        file.seek(0, io.SEEK_END)
        size = file.tell()
        at, n, bloom_at, bloom_n, self.n_docs, self.n_ids, self.id_bytes, magic = FOOTER.unpack(self._bytes(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        index, self.ends, self.places, p = self._bytes(at, n), [], [], 0
        while p < n:
            (k,) = struct.unpack_from("<I", index, p)
            self.ends.append(index[p + 4 : p + 4 + k])
            self.places.append(struct.unpack_from("<QQ", index, p + 4 + k))
            p += 20 + k
        bloom = self._bytes(bloom_at, bloom_n)
        _, self.bits = struct.unpack_from("<IQ", bloom)
        self.bloom = bloom[12:]

    def _bytes(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _block(self, i: int) -> tuple[bytes, list[int]]:
        body = self._bytes(*self.places[i])
        if zlib.crc32(body[:-4]) != struct.unpack("<I", body[-4:])[0]:
            raise ValueError("damaged block")
        (n,) = struct.unpack_from("<I", body, len(body) - 8)
        return body[: len(body) - 8 - 4 * n], list(struct.unpack_from(f"<{n}I", body, len(body) - 8 - 4 * n))

    @staticmethod
    def _entries(body: bytes, at: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < len(body):
            shared, at = read_varint(body, at)
            rest, at = read_varint(body, at)
            n, at = read_varint(body, at)
            key = key[:shared] + body[at : at + rest]
            at += rest
            yield key, body[at : at + n]
            at += n

    def ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, dtype=f"<u{self.id_bytes}").astype("<u4")

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.places)):
            for key, value in self._entries(self._block(i)[0], 0):
                yield id_of(key), self.ids(value)

    def may_have(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in bloom_places(key, self.bits))

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """The ids of the first entry of that id: Bloom filter, binary search over blocks, then over restarts."""
        key = key_of(doc_id)
        i = bisect.bisect_left(self.ends, key)
        if not self.may_have(key) or i == len(self.ends):
            return None
        body, restarts = self._block(i)
        j = bisect.bisect_left(restarts, key, key=lambda at: next(self._entries(body, at))[0])
        for k, value in self._entries(body, restarts[max(0, j - 1)]):
            if k >= key:
                return self.ids(value) if k == key else None
        return None


class WordIds:
    """Packed ids of blank-separated words. The tokenizer normalises and splits at blanks before it merges, and its special
    tokens (the library finds their strings in a text) have no blanks, so a text's ids are its words' ids in a row."""

    def __init__(self, path: str, id_bytes: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.form = {2: "H", 4: "I"}[id_bytes]
        self.known: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        for word, found in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True):
            self.known[word] = array.array(self.form, found.ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text; words that are new are encoded together, and remembered while there is room."""
        split = [text.replace("\n", " ").split(" ") for text in texts]
        new = set().union(*split).difference(self.known)
        full = len(self.known) >= WORDS_KEPT
        self.learn(list(new))
        out = [b"".join(map(self.known.__getitem__, x)) for x in split]
        if full:
            for word in new:
                del self.known[word]
        return out


_words: dict[tuple[str, int], WordIds] = {}


def words_of(path: str, end_id: int) -> WordIds:
    """The words that this Python worker knows; tasks that follow one another in it share them."""
    if (path, end_id) not in _words:
        words = WordIds(path, 4)
        words.id_bytes = 2 if max(words.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        words.form = {2: "H", 4: "I"}[words.id_bytes]
        _words[path, end_id] = words
    return _words[path, end_id]


def filesystem(folder: str):
    """pyarrow's file system and path of a folder's address."""
    from pyarrow import fs

    if folder.startswith(("file:", "/")):
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


def write(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, partitions: int | None = None) -> DataFrame:
    """Encode and write the documents; a row a shard: part, shard, path, n_docs, n_ids. Evaluating the result writes the files."""
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def run(batches):
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        files, root = filesystem(folder)
        files.create_dir(root, recursive=True)
        words = words_of(path, end_id)
        id_bytes = words.id_bytes
        end = end_id.to_bytes(id_bytes, "little")
        state = {"n": 0}

        def start():
            state["temp"] = f"{root}/.{part:06d}-{state['n']:06d}-{attempt}"
            state["out"] = files.open_output_stream(state["temp"])
            state["shard"] = ShardWriter(state["out"], id_bytes)

        def finish():
            shard = state["shard"]
            shard.finish()
            state["out"].close()
            name = f"{root}/{part:06d}-{state['n']:06d}.sst"
            files.move(state["temp"], name)
            state["n"] += 1
            state.pop("shard")
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part, state["n"] - 1, f"{folder}/{name.rsplit('/', 1)[1]}", len(shard.keys), shard.n_ids), schema.types, strict=True)], schema=schema)

        for rows, _, _ in blocks(batches, most=1 << 20):
            for doc_id, ids in zip(rows.column(0).to_pylist(), words.encode([x or "" for x in rows.column(1).to_pylist()]), strict=True):
                if "shard" not in state:
                    start()
                state["shard"].add(key_of(doc_id), ids + end)
                if state["shard"].at >= SHARD_BYTES:
                    yield finish()
        if "shard" in state:
            yield finish()

    rows = text_of(docs, id_col, text_col)
    n = partitions or tasks_for(rows)
    return rows.repartitionByRange(n, "doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").mapInArrow(run, "part int, shard int, path string, n_docs long, n_ids long")


def read(spark: SparkSession, shards: list, with_ids: bool = False) -> DataFrame:
    """Read shards back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and packed ``ids`` if asked for.

    ``shards`` is the list of rows that writing gave: a few numbers a file, whose running sum places each."""
    shards = sorted(shards, key=lambda r: (r["part"], r["shard"]))
    starts = np.concatenate([[0], np.cumsum([r["n_ids"] for r in shards])]).astype(int).tolist()
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids)
    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                files, root = filesystem(path)
                with files.open_input_file(root) as file:
                    out, held = [], 0
                    for doc_id, ids in ShardReader(file).scan():
                        data = ids.tobytes()
                        out.append((doc_id, start, len(ids), zlib.crc32(data), data)[: 4 + with_ids])
                        start += len(ids)
                        held += len(data)
                        if len(out) >= 4096 or with_ids and held >= 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                            out, held = [], 0
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    rows = spark.createDataFrame([(r["path"], s) for r, s in zip(shards, starts, strict=False)], "path string, start long")
    return rows.repartition(max(1, min(len(shards), 10_000))).mapInArrow(run, ddl)


def op6_token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, write(table(spark, sf_dir, "documents"), scratch(spark)).collect())
