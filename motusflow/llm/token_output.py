"""Token ids as entropy-coded blocks: canonical length-limited Huffman codes from global counts.

File format, a folder that Spark's committed Parquet writer fills, so a lost executor leaves no half file behind:

* ``codebook``: one row, the longest code in bits and one length (a byte) for each id. The canonical code follows from it.
* ``blocks``: independent blocks in ascending doc_id order. Each row has its file and block number, the ids of its file
  before it, the documents in it (doc_id, whether that is null, number of ids), the code bits (first bit highest) and
  the bit offset of every ``EVERY``-th id. Decoding starts at any of those offsets and looks the longest code's bits up at once.

Codes have at most MAX_BITS bits, or as many as it takes to tell the used ids apart, if those are more.

Defined cases: a null or empty text has the end id alone; documents with equal or null doc_id keep separate rows (nulls
first); an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batches, count_in, new_path, written
from .encode import encoder

MAX_BITS = 16
#: Ids after which a block is closed, and ids between two stored bit offsets.
BLOCK_IDS, EVERY = 1 << 19, 128
#: Files whose starts are broadcast at most.
SMALL = 1_000_000


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits, or of as many as the used ids need (package-merge); 0 where an id does not occur."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    limit = max(limit, int(np.ceil(np.log2(len(used)))))
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    merged, singles = weights, [np.ones(len(order), bool)]
    for _ in range(limit - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weights, pairs])
        place = np.argsort(both, kind="stable")
        merged = both[place]
        singles.append(place < len(order))
    take, lengths = 2 * len(order) - 2, np.zeros(len(order), np.uint8)
    for level in reversed(singles):
        own = int(level[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    size = lengths[used].astype(np.int64)
    if len(used):
        # each code is the sum of the shares of those before it, written with its own number of bits
        share = np.uint64(1) << (np.uint64(32) - size.astype(np.uint64))
        before = np.cumsum(share) - share
        codes[used] = before >> (np.uint64(32) - size.astype(np.uint64))
    return codes


def pack_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The code bits of the ids, and the bit offset of each id."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    if not len(ids):
        return b"", at
    total = int(ends[-1])
    word, left = at >> 6, 64 - (at & 63) - size
    code = codes[ids]
    fits = left >= 0
    high = np.where(fits, code << np.where(fits, left, 0).astype(np.uint64), code >> np.where(fits, 0, -left).astype(np.uint64))
    heads = np.flatnonzero(np.diff(word, prepend=-1))
    out = np.zeros((total >> 6) + 2, np.uint64)
    out[word[heads]] = np.add.reduceat(high, heads)
    over = np.flatnonzero(~fits)
    out[word[over] + 1] += code[over] << (64 + left[over]).astype(np.uint64)
    return out.astype(">u8").tobytes()[: (total + 7) // 8], at


def decode_table(lengths: np.ndarray, bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """For each value of the next ``bits`` bits, no fewer than the longest code has: the id and its code length."""
    bits = max(bits, int(lengths.max(initial=0)))
    codes = canonical_codes(lengths)
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    ids, size = np.zeros(1 << bits, np.int32), np.ones(1 << bits, np.uint8)
    span = 1 << (bits - lengths[used].astype(np.int64))
    n = int(span.sum())
    assert not len(used) or (codes[used[0]] == 0 and n <= 1 << bits)
    ids[:n] = np.repeat(used, span)
    size[:n] = np.repeat(lengths[used], span)
    return ids, size


def unpack_bits(data: bytes, n: int, marks: np.ndarray, table: tuple[np.ndarray, np.ndarray], every: int = EVERY) -> np.ndarray:
    """The n ids of a block; all stretches between stored offsets advance together."""
    ids, size = table
    bits = len(ids).bit_length() - 1  # up to 24: four bytes hold them from any bit on
    b = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.uint32)
    four = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
    at = marks.astype(np.int64)
    out = np.zeros((every, len(at)), np.int32)
    whole = n // every
    for k in range(every):
        lanes = len(at) if k < n - whole * every else whole
        if not lanes:
            break
        p = at[:lanes]
        seen = (four[p >> 3] << (p & 7).astype(np.uint32)) >> np.uint32(32 - bits)
        out[k, :lanes] = ids[seen]
        p += size[seen]
    return out.T.reshape(-1)[:n]


def _encode(docs: DataFrame, path: str, how: str, end_id: int) -> DataFrame:
    """Rows of one document each (ids as 16- or 32-bit integers), and at a task's end one row for each id with its count."""

    def run(frames):
        enc = encoder(path, how)
        top = max(enc.tokenizer.get_vocab_size(), end_id + 1)
        width = np.dtype("<u2" if top <= 65536 else "<u4")
        counts = np.zeros(top, np.int64)
        for b in batches(frames):
            ids, bounds = enc.encode(b.column("text").to_pylist())
            counts += np.bincount(ids, minlength=top)
            size = np.diff(bounds)
            counts[end_id] += len(size)
            ids = np.insert(ids, bounds[1:], end_id).astype(width)
            at = np.concatenate([[0], np.cumsum(size + 1)]) * width.itemsize
            data = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(ids)])
            k = len(size)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size + 1), data, pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64())], names=["doc_id", "n", "ids", "id", "count"])
        seen = np.flatnonzero(counts)
        k = len(seen)
        yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(seen.astype(np.int32)), pa.array(counts[seen])], names=["doc_id", "n", "ids", "id", "count"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, ids binary, id int, count long")


def write_tokens(docs: DataFrame, path: str, how: str = "clip", end_id: int = 1, out: str | None = None) -> str:
    """Write the ids of all documents, each closed by ``end_id``, in ascending doc_id order; the folder written."""
    spark = docs.sparkSession
    out = out or new_path(spark, "tokens")
    encoded = written(_encode(docs, path, how, end_id), "encoded")
    held = encoded.filter("id is not null").groupBy("id").agg(F.sum("count").alias("count")).toPandas()  # at most the vocabulary
    counts = np.zeros(int(held["id"].max()) + 1 if len(held) else 1, np.int64)
    counts[held["id"].to_numpy(np.int64)] = held["count"].to_numpy(np.int64)
    lengths = code_lengths(counts)
    spark.createDataFrame([(max(MAX_BITS, int(lengths.max())), bytearray(lengths.tobytes()))], "max_bits int, lengths binary").coalesce(1).write.parquet(f"{out}/codebook")
    codes, wide = canonical_codes(lengths), len(counts) > 65536

    def run(frames):
        file, block, before = TaskContext.get().partitionId(), 0, 0
        names: list = []
        parts: list[np.ndarray] = []
        held = 0

        def closed():
            size = np.fromiter(map(len, parts), np.int64, len(parts))
            ids = np.concatenate(parts).astype(np.int64)
            bits, at = pack_bits(ids, codes, lengths)
            doc = np.array([x or 0 for x in names], np.int64)
            none = np.packbits(np.array([x is None for x in names], bool))
            row = [file, block, before, len(ids), len(names), doc.tobytes(), none.tobytes(), size.tobytes(), bits, at[::EVERY].astype("<u4").tobytes()]
            return pa.RecordBatch.from_pylist([dict(zip(BLOCK.names, row, strict=True))], BLOCK)

        for b in frames:
            for doc, data in zip(b.column("doc_id").to_pylist(), b.column("ids"), strict=True):
                names.append(doc)
                parts.append(np.frombuffer(data.as_buffer(), "<u4" if wide_ids else "<u2").copy())
                held += len(parts[-1])
                if held >= BLOCK_IDS:
                    yield closed()
                    before, block = before + held, block + 1
                    names, parts, held = [], [], 0
        if names:
            yield closed()

    wide_ids = wide or _vocabulary(path, how, end_id) > 65536
    rows = encoded.filter("n is not null").select("doc_id", "n", "ids")
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "n", "ids")
    ordered.mapInArrow(run, BLOCK_DDL).write.option("compression", "none").parquet(f"{out}/blocks")
    return out


def _vocabulary(path: str, how: str, end_id: int) -> int:
    return max(encoder(path, how).tokenizer.get_vocab_size(), end_id + 1)


BLOCK_DDL = "file int, block int, before long, n_ids long, n_docs int, docs binary, nulls binary, sizes binary, bits binary, marks binary"
BLOCK = pa.schema([("file", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("n_docs", pa.int32()), *((x, pa.binary()) for x in ("docs", "nulls", "sizes", "bits", "marks"))])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary, unsigned 32-bit little-endian), from the files."""
    book = spark.read.parquet(f"{path}/codebook").first()
    table = decode_table(np.frombuffer(bytes(book["lengths"]), np.uint8), book["max_bits"])
    blocks = spark.read.schema(BLOCK_DDL).parquet(f"{path}/blocks")
    files = blocks.groupBy("file").agg(F.sum("n_ids").alias("n_ids"))  # one row a file
    base = files.select("file", (F.sum("n_ids").over(W.orderBy("file")) - F.col("n_ids")).alias("base"))
    base = F.broadcast(base) if count_in(files, SMALL) else base  # else the ids would be shuffled for one number a file

    def run(frames):
        for b in frames:
            for row in b.to_pylist():
                ids = unpack_bits(row["bits"], row["n_ids"], np.frombuffer(row["marks"], "<u4"), table).astype("<u4")
                size = np.frombuffer(row["sizes"], np.int64)
                k = row["n_docs"]
                ends = np.cumsum(size)
                none = np.unpackbits(np.frombuffer(row["nulls"], np.uint8))[:k].astype(bool)
                at = np.concatenate([[0], ends]).astype(np.int64) * 4
                if at[-1] >= 2**31:
                    data = pa.array([ids[e - n : e].tobytes() for e, n in zip(ends, size, strict=True)], pa.binary())
                else:
                    data = pa.BinaryArray.from_buffers(pa.binary(), k, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(ids)])
                doc = pa.array(np.frombuffer(row["docs"], np.int64), mask=none)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, row["file"], np.int32)), doc, pa.array(row["before"] + ends - size), pa.array(size), data], names=["file", "doc_id", "start", "n_tokens", "ids"])

    rows = blocks.mapInArrow(run, "file int, doc_id long, start long, n_tokens long, ids binary")
    return rows.join(base, "file").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids")
