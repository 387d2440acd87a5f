"""Array files as tables: NPY, NPZ, safetensors, IDX, CIFAR and images.

Files are read with Spark's binary-file source, one row a file, and decoded in
Arrow batches: any store that Spark reaches will do. Writers are for arrays
that fit the driver, as in the formats themselves.
"""

from __future__ import annotations

import io
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TENSOR = "path string, name string, dtype string, shape array<long>, values array<double>"


def _tensor_rows(spark: SparkSession, path: str, decode) -> DataFrame:
    """(path, name, dtype, shape, values) of the arrays in files; values in row-major order."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for name, a in decode(content.as_py()):
                    real = np.asarray(a, np.float64) if a.dtype.kind != "c" else np.stack([a.real, a.imag], -1)
                    yield pa.RecordBatch.from_arrays([pa.array([where]), pa.array([name], pa.string()), pa.array([str(a.dtype)]), pa.array([list(a.shape)], pa.list_(pa.int64())), pa.array([real.ravel()], pa.list_(pa.float64()))], ["path", "name", "dtype", "shape", "values"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, TENSOR)


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    return _tensor_rows(spark, path, lambda b: [("", np.load(io.BytesIO(b), allow_pickle=False))])


def read_npz(spark: SparkSession, path: str, entry: str | None = None) -> DataFrame:
    def decode(b: bytes):
        with np.load(io.BytesIO(b), allow_pickle=False) as z:
            return [(n, z[n]) for n in z.files if entry is None or n == entry]

    return _tensor_rows(spark, path, decode)


# Names of the element types in the format (fixed values).
_SAFE = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "<i1", "U8": "<u1", "U16": "<u2", "U32": "<u4", "U64": "<u8", "BOOL": "?"}


def decode_safetensors(b: bytes) -> list[tuple[str, np.ndarray]]:
    """Eight bytes of length, a JSON header, then the data."""
    (size,) = struct.unpack("<Q", b[:8])
    head = json.loads(b[8 : 8 + size])
    data = b[8 + size :]
    out = []
    for name, x in head.items():
        if name == "__metadata__":
            continue
        low, high = x["data_offsets"]
        if x["dtype"] == "BF16":
            a = (np.frombuffer(data[low:high], "<u2").astype("<u4") << 16).view("<f4")
        else:
            a = np.frombuffer(data[low:high], _SAFE[x["dtype"]])
        out.append((name, a.reshape(x["shape"])))
    return out


def encode_safetensors(arrays: dict[str, np.ndarray]) -> bytes:
    names = {np.dtype(v): k for k, v in _SAFE.items()}
    head, parts, at = {}, [], 0
    for n, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        head[n] = {"dtype": names[a.dtype.newbyteorder("<") if a.dtype.itemsize > 1 else a.dtype], "shape": list(a.shape), "data_offsets": [at, at + len(raw)]}
        parts.append(raw)
        at += len(raw)
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    return struct.pack("<Q", len(text)) + text + b"".join(parts)


def read_safetensors(spark: SparkSession, path: str) -> DataFrame:
    return _tensor_rows(spark, path, decode_safetensors)


def save_npy(path: str, a: np.ndarray, overwrite: bool = True) -> None:
    with open(path, "wb" if overwrite else "xb") as f:
        np.save(f, a)


def save_npz(path: str, arrays: dict[str, np.ndarray], overwrite: bool = True) -> None:
    with open(path, "wb" if overwrite else "xb") as f:
        np.savez(f, **arrays)


def save_safetensors(path: str, arrays: dict[str, np.ndarray], overwrite: bool = True) -> None:
    with open(path, "wb" if overwrite else "xb") as f:
        f.write(encode_safetensors(arrays))


def decode_idx(b: bytes) -> list[tuple[str, np.ndarray]]:
    """Two zero bytes, a type, the number of dimensions, their sizes, the data; gzip is inflated."""
    import gzip

    b = gzip.decompress(b) if b[:2] == b"\x1f\x8b" else b
    kind = {0x08: ">u1", 0x09: ">i1", 0x0B: ">i2", 0x0C: ">i4", 0x0D: ">f4", 0x0E: ">f8"}[b[2]]
    shape = struct.unpack(f">{b[3]}I", b[4 : 4 + 4 * b[3]])
    return [("", np.frombuffer(b, kind, offset=4 + 4 * b[3]).reshape(shape))]


def read_idx(spark: SparkSession, path: str) -> DataFrame:
    return _tensor_rows(spark, path, decode_idx)


def read_cifar(spark: SparkSession, path: str, normalize: bool = True) -> DataFrame:
    """(path, i, label, pixels): records of a label byte and 3072 bytes of a 32 by 32 image, by channel."""

    def run(batches):
        for batch in batches:
            for where, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                a = np.frombuffer(content.as_py(), np.uint8).reshape(-1, 3073)
                for low in range(0, len(a), 1000):
                    part = a[low : low + 1000]
                    pixels = part[:, 1:].astype(np.float64) / (255 if normalize else 1)
                    yield pa.RecordBatch.from_arrays([pa.array([where] * len(part)), pa.array(np.arange(low, low + len(part))), pa.array(part[:, 0].astype(np.int32)), pa.array(list(pixels), pa.list_(pa.float64()))], ["path", "i", "label", "pixels"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, i long, label int, pixels array<double>")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Spark's image source: origin, height, width, channels and bytes of each file."""
    return spark.read.format("image").load(path).select("image.*")


def read_gzip_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text; files ending in .gz are inflated by the source."""
    return spark.read.text(path)


def explode_tensor(df: DataFrame) -> DataFrame:
    """(path, name, at, v): cells by row-major position."""
    return df.select("path", "name", F.posexplode("values").alias("at", "v"))
