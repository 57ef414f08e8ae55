"""Questions from blocks of documents to buckets of keys, and the answers.

Several operators need a corpus-wide fact (a count, a smallest document, an
encoding) for very many keys found in texts.  Shuffling a row for each
occurrence would move several times the input, and a frequent key would make
a hot group.  Here documents are dealt into blocks by a hash of their id and text;
each block asks about its *distinct* keys, packed into one row for each hash
bucket of keys; each bucket merges what all blocks sent and answers each block
in the order asked.  A key weighs at most one entry for each block however
often it occurs, nothing is broadcast or collected, and the numbers of blocks
and buckets follow the input.  What a block asks depends on the set of its
documents alone, so a rerun task asks the same question.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALLEST_BLOCK, LARGEST_BLOCK, MANY = 8 << 20, 64 << 20, 1024
ROWS = "_bucket int, _block int, _n long, _body binary"
FIELDS = pa.schema([("_bucket", pa.int32()), ("_block", pa.int32()), ("_n", pa.int64()), ("_body", pa.binary())])
#: Rows bundled at a time, to bound what a task holds.
BUNDLE_ROWS = 5_000
_CODEC = pa.Codec("zstd", 1)


def give_back() -> None:
    """Return freed memory to the system: a Python worker stays for later tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(function: Callable) -> Callable:
    """The function of a group, giving memory back after it."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        out = function(key, table)
        give_back()
        return out

    return run


def lean_pair(function: Callable) -> Callable:
    """The function of two cogrouped tables, giving memory back after it."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table, replies: pa.Table) -> pa.Table:
        out = function(key, table, replies)
        give_back()
        return out

    return run


def lean_batches(function: Callable) -> Callable:
    """The function of a partition's batches, giving memory back after the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        give_back()

    return run


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts; one aggregate over one column."""
    return docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0


def block_count(size: int) -> int:
    """Blocks of 8 to 64 MiB of text, at least 8 of them."""
    each = min(max(size // MANY, SMALLEST_BLOCK), LARGEST_BLOCK)
    return max(8, -(-size // each))


def power_of_two(n: int) -> int:
    return 1 << max(0, int(n) - 1).bit_length()


def in_blocks(docs: DataFrame, id_col: str, text_col: str, n_blocks: int) -> DataFrame:
    """The rows dealt into blocks, as (_block, _docs): compressed Arrow bundles.

    A bundle holds the rows of one block out of one batch, so the exchange
    moves well-compressed columns.  A null text counts as empty.  Rows are dealt
    by id and text, so that null or equal ids don't meet in one block.
    """
    dealt = docs.withColumn(text_col, F.coalesce(F.col(text_col), F.lit(""))).withColumn(
        "_block", F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(n_blocks)).cast("int")
    )

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches):
            block = batch.column(batch.num_columns - 1).to_numpy()
            order = np.argsort(block, kind="stable")
            rows = batch.select(batch.schema.names[:-1]).take(pa.array(order))
            at = np.concatenate([np.flatnonzero(np.diff(block[order], prepend=-1)), [len(block)]])
            bodies = [_written(rows.slice(i, j - i)) for i, j in zip(at[:-1], at[1:])]
            keys = pa.array(block[order][at[:-1]], pa.int32())
            yield pa.RecordBatch.from_arrays([keys, pa.array(bodies, pa.binary())], ["_block", "_docs"])

    return dealt.mapInArrow(lean_batches(bundle), "_block int, _docs binary")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of BUNDLE_ROWS rows or a few more, so that bundles compress well."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= BUNDLE_ROWS:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _written(rows: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(rows)
    return out.getvalue().to_pybytes()


def unbundled(bundles: pa.Table) -> pa.Table:
    """The rows of a block (not none: a block without rows has no group)."""
    return pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in bundles["_docs"].to_pylist()])


def pack(values: np.ndarray) -> bytes:
    """Compressed integers; byte planes keep the small high bytes together."""
    if not len(values):
        return b""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return _CODEC.compress(np.ascontiguousarray(planes), asbytes=True)


def unpack(body: bytes, n: int, kind: type) -> np.ndarray:
    if not n:
        return np.zeros(0, kind)
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(_CODEC.decompress(body, n * width), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """Compressed gaps of ascending integers."""
    return pack(np.diff(values, prepend=values[:1] * 0))


def unpack_sorted(body: bytes, n: int, kind: type) -> np.ndarray:
    return np.cumsum(unpack(body, n, kind), dtype=kind)


def frames(*bodies: bytes) -> bytes:
    """Several byte strings in one."""
    return b"".join(len(x).to_bytes(4, "little") + x for x in bodies)


def unframe(body: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(body):
        n = int.from_bytes(body[at : at + 4], "little")
        out.append(body[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def rows(found: list[tuple[int, int, int, bytes]]) -> pa.Table:
    columns = zip(*found) if found else [[], [], [], []]
    return pa.table([pa.array(c, t) for c, t in zip(columns, FIELDS.types)], schema=FIELDS)


def cuts(keys: np.ndarray, bits: int, n_buckets: int) -> np.ndarray:
    """Where ascending keys of that many bits pass from bucket to bucket."""
    edges = np.arange(1, n_buckets, dtype=np.uint64) << np.uint64(bits - (n_buckets.bit_length() - 1))
    return np.concatenate([[0], np.searchsorted(keys, edges.astype(keys.dtype)), [len(keys)]])
