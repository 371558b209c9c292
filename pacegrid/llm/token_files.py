"""Token ids in binary files: one id array a file, with Elias-Fano coded document boundaries.

A file holds, in this order: the ids of its documents one after the other (unsigned 16-bit where the vocabulary allows
it, else 32-bit), the Elias-Fano code of the documents' end offsets, that of their doc_ids (taken from the smallest),
and a footer of fixed size. An Elias-Fano code of n rising numbers up to u keeps the l = floor(log2(u / n)) low bits of each
number packed, and the high parts in unary in a bit array of about 2n bits; a sample of the places of every 64th one-bit
answers select(i) by a scan of a few words, so the i-th offset is found without a table of 64-bit numbers."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch
from .tokens import default_vocabulary, encoder

MAGIC = b"PGTOK001"
SAMPLE = 64
FOOTER = "<8sQQQQqQQQQ"  # magic, documents, null-id documents, ids, bytes an id, smallest doc_id, sizes of two codes, their upper bounds


class EliasFano:
    """n numbers in rising order (repeats allowed) from 0 to upper."""

    def __init__(self, n: int, upper: int, low: np.ndarray, high: np.ndarray):
        self.n, self.upper, self.low, self.high = n, upper, low, high
        self.bits = self.low_bits(n, upper)
        ones = np.flatnonzero(np.unpackbits(high, bitorder="little"))
        self.sample = ones[::SAMPLE].astype(np.uint32 if len(high) < 1 << 29 else np.uint64)

    @staticmethod
    def low_bits(n: int, upper: int) -> int:
        return max(0, (upper // n).bit_length() - 1) if n else 0

    @classmethod
    def sizes(cls, n: int, upper: int) -> tuple[int, int]:
        """Bytes of the low and of the high part."""
        bits = cls.low_bits(n, upper)
        return -(-n * bits // 8), -(-(n + (upper >> bits) + 1) // 8)

    @classmethod
    def of(cls, numbers: np.ndarray) -> EliasFano:
        n, upper = len(numbers), int(numbers[-1]) if len(numbers) else 0
        bits = cls.low_bits(n, upper)
        numbers = numbers.astype(np.uint64)
        low_size, high_size = cls.sizes(n, upper)
        low = np.zeros(low_size, np.uint8)
        if bits:
            each = (numbers[:, None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
            low = np.packbits(each.ravel(), bitorder="little")
        high = np.zeros(high_size * 8, np.uint8)
        high[(numbers >> np.uint64(bits)).astype(np.int64) + np.arange(n)] = 1
        return cls(n, upper, low, np.packbits(high, bitorder="little"))

    def tobytes(self) -> bytes:
        return self.low.tobytes() + self.high.tobytes()

    @classmethod
    def read(cls, n: int, upper: int, data: bytes) -> EliasFano:
        low, high = cls.sizes(n, upper)
        return cls(n, upper, np.frombuffer(data, np.uint8, low), np.frombuffer(data, np.uint8, high, low))

    def select(self, i: int) -> int:
        """The i-th number: the place of the i-th one-bit, less i, is its high part."""
        at = int(self.sample[i // SAMPLE])
        byte, wanted = at >> 3, i % SAMPLE
        bits = np.unpackbits(self.high[byte : byte + 8], bitorder="little")
        bits[: at & 7] = 0
        while (found := int(bits.sum())) <= wanted:
            wanted, byte = wanted - found, byte + 8
            bits = np.unpackbits(self.high[byte : byte + 8], bitorder="little")
        place = byte * 8 + int(np.flatnonzero(bits)[wanted])
        return (place - i) << self.bits | self._low(i)

    def _low(self, i: int) -> int:
        if not self.bits:
            return 0
        first, last = i * self.bits, (i + 1) * self.bits
        word = int.from_bytes(self.low[first >> 3 : (last + 7) >> 3].tobytes(), "little")
        return word >> (first & 7) & ((1 << self.bits) - 1)

    def numbers(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """The numbers from the first to before the last, in blocks of whole arrays."""
        last = self.n if last is None else last
        if first >= last:
            return np.zeros(0, np.int64)
        start = int(self.sample[first // SAMPLE])
        stop = int(self.sample[-(-last // SAMPLE)]) if -(-last // SAMPLE) < len(self.sample) else len(self.high) * 8
        ones = np.flatnonzero(np.unpackbits(self.high[start >> 3 : (stop >> 3) + 1], bitorder="little")) + (start >> 3 << 3)
        ones = ones[ones >= start][first % SAMPLE :][: last - first]
        out = (ones - np.arange(first, last)) << self.bits
        if self.bits:
            a, b = first * self.bits, last * self.bits
            each = np.unpackbits(self.low[a >> 3 : (b + 7) >> 3], bitorder="little")[a & 7 :][: b - a].reshape(-1, self.bits)
            out |= each.astype(np.int64) @ (1 << np.arange(self.bits, dtype=np.int64))
        return out


def file_system(path: str):
    """pyarrow's file system for a path that executors share (file, hdfs, s3, gs), and the path inside it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


@dataclass
class TokenFiles:
    """The files of one write, in doc_id order; base is the number of ids in the files before. One entry a file."""

    root: str
    files: list[tuple[str, int, int, int]]  # name, documents, ids, base


def write_tokens(docs: DataFrame, root: str | None = None, vocabulary: str | None = None, files: int | None = None) -> TokenFiles:
    """Encodes every whole text, and writes the ids in ascending doc_id order, a file for each range of doc_ids.

    A null text counts as empty, a null doc_id comes first, repeated rows are all written. A task writes under a name of
    its own attempt, and only the names that finished tasks return count, so lost executors and repeated tasks leave
    nothing behind that is read. Ids go to the file batch by batch; a task keeps the lengths and doc_ids of its documents.
    files: ranges to cut the doc_ids into, by default as many as shuffle partitions."""
    spark = docs.sparkSession
    root, vocabulary = root or scratch(spark, "tokens"), vocabulary or default_vocabulary()
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made, (fs, inner) = encoder(vocabulary), file_system(root)
        name, doc_ids, lengths, nulls = f"{uuid.uuid4().hex}.tok", [], [], 0
        wide = len(made.ends) > 1 << 16
        fs.create_dir(inner, recursive=True)
        with fs.open_output_stream(f"{inner}/{name}") as out:
            for b in batches:
                nulls += int(b["doc_id"].isna().sum())
                doc_ids.append(b["doc_id"].dropna().to_numpy(np.int64))
                for ids in made.encode(b["text"].tolist()):
                    lengths.append(len(ids))
                    out.write((ids if wide else ids.astype("<u2")).tobytes())
            if not lengths:
                return
            known, ends = np.concatenate(doc_ids), EliasFano.of(np.cumsum(lengths))
            least = int(known[0]) if len(known) else 0
            ids = EliasFano.of((known.astype(np.uint64) - np.uint64(least & (1 << 64) - 1)))
            parts = ends.tobytes(), ids.tobytes()
            out.write(parts[0] + parts[1])
            out.write(struct.pack(FOOTER, MAGIC, len(lengths), nulls, ends.upper, 4 if wide else 2, least, len(parts[0]), len(parts[1]), ends.upper, ids.upper))
        yield pd.DataFrame({"name": [name], "first": [least if len(known) else None], "nulls": [nulls], "documents": [len(lengths)], "ids": [ends.upper]}).astype({"first": "Int64"})

    sorted_docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    schema = T.StructType([T.StructField("name", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("first", "nulls", "documents", "ids"))])
    rows = sorted_docs.mapInPandas(run, schema).collect()  # one row a file
    base, out = 0, []
    for r in sorted(rows, key=lambda r: (r["nulls"] == 0, r["first"] if r["first"] is not None else -(1 << 63), r["name"])):
        out.append((r["name"], r["documents"], r["ids"], base))
        base += r["ids"]
    return TokenFiles(root, out)


class TokenFile:
    """Random access to one file: the ids of its i-th document by two selects and one read."""

    def __init__(self, path: str):
        fs, inner = file_system(path)
        self.file = fs.open_input_file(inner)
        size, end = self.file.size(), struct.calcsize(FOOTER)
        magic, self.n, self.nulls, self.n_ids, self.width, self.least, a, b, ends_upper, ids_upper = struct.unpack(FOOTER, self.file.read_at(end, size - end))
        if magic != MAGIC:
            raise ValueError(f"not a token file: {path}")
        self.ends = EliasFano.read(self.n, ends_upper, self.file.read_at(a, size - end - b - a))
        self.doc_ids = EliasFano.read(self.n - self.nulls, ids_upper, self.file.read_at(b, size - end - b))

    def document(self, i: int) -> np.ndarray:
        first, last = self.ends.select(i - 1) if i else 0, self.ends.select(i)
        return self.ids(first, last)

    def ids(self, first: int, last: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((last - first) * self.width, first * self.width), f"<u{self.width}").astype("<u4")

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self._signed(self.doc_ids.select(i - self.nulls) + self.least)

    @staticmethod
    def _signed(x: int) -> int:
        return (x + (1 << 63)) % (1 << 64) - (1 << 63)

    def blocks(self, documents: int = 512):
        """(doc_ids, starts, ends, ids of the whole block) of so many documents at a time."""
        for k in range(0, self.n, documents):
            last = min(self.n, k + documents)
            ends = self.ends.numbers(k, last)
            starts = np.concatenate([[self.ends.select(k - 1) if k else 0], ends[:-1]])
            known = self.doc_ids.numbers(max(0, k - self.nulls), max(0, last - self.nulls)) + self.least
            yield [None] * (last - k - len(known)) + known.tolist(), starts, ends, self.ids(int(starts[0]), int(ends[-1]))


def read_tokens(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """One row per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids (unsigned
    32-bit little-endian). A task reads whole files, block by block."""
    root = files.root
    schema = "doc_id long, start long, n_tokens long, ids binary"
    if not files.files:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, base in zip(b["name"], b["base"]):
                for doc_ids, starts, ends, ids in TokenFile(f"{root}/{name}").blocks():
                    at = starts[0]
                    yield pd.DataFrame({"doc_id": pd.array(doc_ids, "Int64"), "start": base + starts, "n_tokens": ends - starts, "ids": [ids[s - at : e - at].tobytes() for s, e in zip(starts, ends)]})

    listed = spark.createDataFrame([(x[0], x[3]) for x in files.files], "name string, base long").repartition(len(files.files))
    return listed.mapInPandas(run, schema)

