"""Token ids as flat binary files, memory-mapped on reading.

For each range of ids in ascending order there are three files without headers, little-endian:
``.ids`` holds the token ids of all its documents in a row (16 bits if the vocabulary allows it, else
32), ``.off`` one 64-bit offset per document and one for the end, counted from the file's first id, and
``.doc`` the 64-bit document ids. ``manifest`` is a Parquet table with a row per file: how many documents
(of which ``n_null`` without id, which come first) and ids it holds, and how many lie in files before it.
The folder must be a path that the driver and every executor can open; files appear under their
names only when they are complete, so a task that is run again does no harm.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagekit.llm.encode import encoder, load_tokenizer

MANIFEST = "part int, n_docs long, n_null long, n_ids long, width int"
DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"
DOCUMENT = "doc_id long, start long, ids array<long>"


def local_path(folder: str) -> str:
    """The path by which tasks open files in ``folder``."""
    url = urlparse(folder)
    if url.scheme not in ("", "file"):
        raise ValueError(f"flat files are memory-mapped and need a mounted folder, not {folder}")
    return url.path


def _append(handle, values: np.ndarray) -> None:
    handle.write(memoryview(np.ascontiguousarray(values)).cast("B"))


def write_ids(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write the ids of all documents in ascending order of their ids; returns the manifest with bases.

    Null ids come first, equal ids in the order of their texts; a null or empty text has only the end
    id. An empty table gives an empty manifest. Other columns are ignored.
    """
    spark = docs.sparkSession
    root = local_path(folder)
    size = load_tokenizer(tokenizer_path).get_vocab_size(with_added_tokens=True)
    width = 2 if max(size - 1, end_id) < 1 << 16 else 4
    end = end_id.to_bytes(4, "little")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encode = encoder(tokenizer_path).encode
        os.makedirs(root, exist_ok=True)
        name = f"{root}/part-{part:06d}"
        own = f"{name}.{uuid.uuid4().hex}"
        at = n_docs = n_null = 0
        with open(f"{own}.ids", "wb") as ids_file, open(f"{own}.off", "wb") as off_file, open(f"{own}.doc", "wb") as doc_file:
            _append(off_file, np.zeros(1, "<i8"))
            for batch in batches:
                keys = batch.column(0)
                _append(doc_file, keys.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
                n_null += keys.null_count
                n_docs += len(keys)
                ends = []
                for ids in encode(batch.column(1)):
                    whole = np.frombuffer(ids + end, "<u4")
                    _append(ids_file, whole.astype(f"<u{width}"))
                    at += len(whole)
                    ends.append(at)
                _append(off_file, np.array(ends, "<i8"))
        for kind in ("ids", "off", "doc"):
            if n_docs:
                os.replace(f"{own}.{kind}", f"{name}.{kind}")
            else:
                os.remove(f"{own}.{kind}")
        if n_docs:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n_docs": [n_docs], "n_null": [n_null], "n_ids": [at], "width": pa.array([width], pa.int32())})

    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
        .repartitionByRange(ranges, "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(write, MANIFEST)
        .collect()  # one row per file
    )
    rows = sorted(tuple(r) for r in rows)
    docs_before = accumulate((r[1] for r in rows), initial=0)
    ids_before = accumulate((r[3] for r in rows), initial=0)
    based = [(*r, d, i) for r, d, i in zip(rows, docs_before, ids_before)]
    spark.createDataFrame(based, f"{MANIFEST}, docs_before long, ids_before long").coalesce(1).write.mode("overwrite").parquet(
        f"{folder}/manifest"
    )
    return spark.read.parquet(f"{folder}/manifest")


def _scan(
    spark: SparkSession, folder: str, schema: str, per_doc: Callable[[int | None, int, np.ndarray], tuple], types: list[pa.DataType],
    batch_docs: int = 1024,
) -> DataFrame:
    root = local_path(folder)
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.to_pylist():
                name = f"{root}/part-{f['part']:06d}"
                ids = np.memmap(f"{name}.ids", f"<u{f['width']}", "r", shape=(f["n_ids"],))
                offsets = np.memmap(f"{name}.off", "<i8", "r", shape=(f["n_docs"] + 1,))
                keys = np.memmap(f"{name}.doc", "<i8", "r", shape=(f["n_docs"],))
                for low in range(0, f["n_docs"], batch_docs):
                    rows = [
                        per_doc(
                            None if i < f["n_null"] else int(keys[i]), f["ids_before"] + int(offsets[i]),
                            ids[offsets[i] : offsets[i + 1]].astype("<u4"),
                        )
                        for i in range(low, min(low + batch_docs, f["n_docs"]))
                    ]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    manifest = spark.read.parquet(f"{folder}/manifest")
    files = manifest.count()
    return manifest.repartition(max(1, files)).mapInArrow(read, schema)


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: the ids of all documents before it, its own number of ids and their CRC."""
    return _scan(
        spark, folder, DIGEST, lambda key, start, ids: (key, start, len(ids), zlib.crc32(ids.tobytes())), [pa.int64()] * 4
    )


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: the ids of all documents before it, and its ids."""
    return _scan(
        spark, folder, DOCUMENT, lambda key, start, ids: (key, start, ids.astype("i8")), [pa.int64(), pa.int64(), pa.list_(pa.int64())],
        batch_docs=64,
    )
