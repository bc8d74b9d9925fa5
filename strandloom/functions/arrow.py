"""Arrow scalar functions over whole batches of sequences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strandloom.functions import kernel


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string()).cast(pa.large_binary())
    else:
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1] if offs is not None else np.zeros(len(column) + 1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def list_of(row: np.ndarray, rows: int, values: pa.Array) -> pa.Array:
    first = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(first), values)


def value_type(length: int) -> str:
    if length > 64:
        raise ValueError("values hold at most 64 bases")
    return "bigint" if length <= 31 else "decimal(38,0)" if length <= 63 else "binary"


def value_array(high: np.ndarray, low: np.ndarray, length: int) -> pa.Array:
    """Unsigned values: int64 to 31 bases, decimal to 63, 16 big-endian bytes for 64."""
    if length <= 31:
        return pa.array(low.view(np.int64))
    if length <= 63:
        return pa.Array.from_buffers(pa.decimal128(38, 0), len(low), [None, pa.py_buffer(np.stack([low, high], 1).tobytes())])
    raw = np.stack([high.byteswap(), low.byteswap()], 1).tobytes()
    return pa.array([raw[i : i + 16] for i in range(0, len(raw), 16)], pa.binary())


def sketch_udf(options, value: bool = False):
    """struct<win, pos[, value]> of arrays, one element per sample."""
    kind = "struct<win:array<bigint>,pos:array<bigint>" + (f",value:array<{value_type(options.value_length)}>>" if value else ">")

    def run(seq: pa.Array) -> pa.Array:
        data, offsets = column_bytes(seq)
        row, win, pos = kernel.sample(data, offsets, options)
        fields = [list_of(row, len(seq), pa.array(x)) for x in (win, pos)]
        names = ["win", "pos"]
        if value:
            at = offsets[:-1][row] + (pos if options.kind == "minimizers" else win)
            codes = kernel.CODES[data] if options.alphabet == "dna" else data
            fields.append(list_of(row, len(seq), value_array(*kernel.values(codes, at, options.value_length, options.canonical), options.value_length)))
            names.append("value")
        return pa.StructArray.from_arrays(fields, names)

    run.__annotations__ = {"seq": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, kind)


def hashes_udf(options):
    def run(seq: pa.Array) -> pa.Array:
        data, offsets = column_bytes(seq)
        codes = kernel.CODES[data] if options.alphabet == "dna" else data
        found = kernel.kmer_hashes(codes, options)
        sizes = np.diff(offsets)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        ok = np.flatnonzero(owner[: len(found)] == owner[options.k - 1 :]) if len(found) else np.zeros(0, np.int64)
        row = owner[ok] if len(ok) else ok
        start = offsets[:-1][row] if len(ok) else ok
        return pa.StructArray.from_arrays(
            [list_of(row, len(seq), pa.array(ok - start)), list_of(row, len(seq), pa.array(found[ok].astype(np.int64)))], ["pos", "hash"]
        )

    run.__annotations__ = {"seq": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "struct<pos:array<bigint>,hash:array<bigint>>")


def pack_udf():
    def run(seq: pa.Array) -> pa.Array:
        data, offsets = column_bytes(seq)
        out = []
        for a, b in zip(offsets[:-1], offsets[1:]):
            codes = np.zeros(-(-(b - a) // 4) * 4, np.uint8)
            codes[: b - a] = kernel.CODES[data[a:b]]
            quads = codes.reshape(-1, 4)
            out.append((quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6).astype(np.uint8).tobytes())
        return pa.array(out, pa.binary())

    run.__annotations__ = {"seq": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "binary")


def unpack_udf():
    letters = np.frombuffer(b"ACTG", np.uint8)

    def run(packed: pa.Array, length: pa.Array) -> pa.Array:
        out = []
        for raw, n in zip(packed.to_pylist(), length.to_pylist()):
            if raw is None or n is None:
                out.append(None)
                continue
            b = np.frombuffer(raw, np.uint8)
            out.append(letters[np.stack([(b >> s) & 3 for s in (0, 2, 4, 6)], 1).ravel()[:n]].tobytes().decode())
        return pa.array(out, pa.string())

    run.__annotations__ = {"packed": pa.Array, "length": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")
