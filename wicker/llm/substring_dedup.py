"""Substring dedup: every fixed-length token window that occurs twice is removed.

Texts are packed into chunks of about a megabyte. A chunk sends the Rabin-Karp hashes of all its
windows, each once, dealt over hash buckets: eight bytes a window and no row per window. A bucket
sees every occurrence of its hashes, finds those that two chunks share and sends each chunk one
bit per hash back. The chunk hashes its texts again, marks the windows and merges them into
maximal removal intervals. No text is shuffled uncompressed, and a passage that every document
shares reaches its bucket once per chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from .scratch import written
from .words import U, Words, column_bytes, pieces

CHUNK_BYTES = 1 << 20
BUCKET_BYTES = 24 << 20
_SECOND = 0xA0761D6478BD642F


def _window_hashes(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, an independent hash for the bucket, and each text's range of windows."""
    hashes = words.hashes(lower=False)
    first, of = words.windows(hashes, k)
    second, _ = words.windows(hashes, k, base=_SECOND)
    return first, second, of


def _distinct(first: np.ndarray, second: np.ndarray, buckets: int):
    """The distinct window hashes in bucket order, how often each occurs, each window's place among them, bucket ranges."""
    distinct, at, inverse, counts = np.unique(first, return_index=True, return_inverse=True, return_counts=True)
    bucket = ((second[at] >> U(32)) * U(buckets)) >> U(32)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return distinct[order], counts[order], place[inverse], np.searchsorted(bucket[order], np.arange(buckets + 1))


def _pack(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            raw, offs = column_bytes(text)
            for lo, hi in pieces(offs, CHUNK_BYTES):
                part = raw[offs[lo] : offs[hi]]
                counts = Words(part, offs[lo : hi + 1] - offs[lo]).counts
                blob = pa.compress(part.tobytes(), codec="zstd", asbytes=True) if len(part) else b""
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([task << 32 | n], pa.int64()),
                        pa.array([int(np.maximum(counts - k + 1, 0).sum())], pa.int64()),
                        pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), ids.slice(lo, hi - lo)),
                        pa.array([np.diff(offs[lo : hi + 1]).astype(np.int64).tolist()], pa.list_(pa.int64())),
                        pa.array([blob], pa.binary()),
                    ],
                    ["chunk", "n_windows", "ids", "lengths", "blob"],
                )
                n += 1

    return run


def _unpack(lengths: np.ndarray, blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    offs = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
    raw = np.frombuffer(pa.decompress(blob, int(offs[-1]), codec="zstd", asbytes=True), np.uint8) if offs[-1] else np.zeros(0, np.uint8)
    return raw, offs


def _deal(k: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, lengths, blob in zip(batch.column("chunk").to_pylist(), batch.column("lengths"), batch.column("blob")):
                words = Words(*_unpack(lengths.values.to_numpy(), blob.as_py()))
                first, second, _ = _window_hashes(words, k)
                distinct, _, _, of = _distinct(first, second, buckets)
                some = [b for b in range(buckets) if of[b + 1] > of[b]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array([chunk] * len(some), pa.int64()), pa.array([distinct[of[b] : of[b + 1]].tobytes() for b in some], pa.binary())],
                    ["bucket", "chunk", "hashes"],
                )

    return run


def _shared(table: pa.Table) -> pa.Table:
    """One bucket: for each chunk a bit per hash, set where another chunk has the hash too."""
    raw, offs = column_bytes(table.column("hashes"))
    hashes, at = raw.view(np.uint64) if len(raw) else np.zeros(0, np.uint64), offs // 8
    order = np.argsort(hashes)
    ordered = hashes[order]
    same = ordered[1:] == ordered[:-1]
    flag = np.zeros(len(hashes), bool)
    flag[order[1:][same]] = True
    flag[order[:-1][same]] = True
    bits = [np.packbits(flag[at[i] : at[i + 1]]).tobytes() if flag[at[i] : at[i + 1]].any() else None for i in range(table.num_rows)]
    some = [i for i, b in enumerate(bits) if b is not None]
    return pa.table({"chunk": table.column("chunk").take(pa.array(some, pa.int64())), "bucket": table.column("bucket").take(pa.array(some, pa.int64())), "bits": pa.array([bits[i] for i in some], pa.binary())})


def _remove(k: int, buckets: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw, offs = _unpack(batch.column("lengths")[i].values.to_numpy(), batch.column("blob")[i].as_py())
                words = Words(raw, offs)
                first, second, of = _window_hashes(words, k)
                distinct, counts, place, ranges = _distinct(first, second, buckets)
                repeated = counts > 1
                found = batch.column("found")[i].as_py() or []
                for x in found:
                    lo, hi = ranges[x["bucket"]], ranges[x["bucket"] + 1]
                    repeated[lo:hi] |= np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=hi - lo).astype(bool)
                window = repeated[place]
                # a word goes if a repeated window starts at it or at one of the k - 1 words before
                n_words = words.counts
                total = int(n_words.sum())
                change = np.zeros(total + 1, np.int64)
                doc = np.repeat(np.arange(len(n_words)), np.diff(of))
                starts = (np.arange(len(window)) - of[:-1][doc] + words.of[:-1][doc])[window]
                np.add.at(change, starts, 1)
                np.add.at(change, starts + k, -1)
                gone = np.cumsum(change[:-1]) > 0
                removed = np.add.reduceat(np.append(gone, False).astype(np.int64), words.of[:-1]) * (n_words > 0) if len(n_words) else n_words
                whole, texts, digests = raw.tobytes(), [], []
                for d in range(len(n_words)):
                    a, b = words.of[d], words.of[d + 1]
                    if removed[d]:
                        keep = np.flatnonzero(~gone[a:b]) + a
                        text = b" ".join([whole[s:e] for s, e in zip(words.starts[keep].tolist(), words.ends[keep].tolist())])
                    else:
                        text = whole[offs[d] : offs[d + 1]]
                    if with_text:
                        texts.append(text)
                    else:
                        joined = text if removed[d] else b" ".join(text.split())
                        digests.append(hashlib.sha256(joined).hexdigest())
                last = pa.array(texts, pa.binary()).cast(pa.string()) if with_text else pa.array(digests, pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, pa.array(n_words.astype(np.int64)), pa.array(removed.astype(np.int64)), last], ["doc_id", "n_words", "n_removed", "text" if with_text else "kept_sha256"])

    return run


def remove_repeated(docs: DataFrame, key: str = "doc_id", k: int = 35, digests: bool = False) -> DataFrame:
    """``docs(key, text)`` -> ``doc_id, n_words, n_removed, text``, one row for each row of ``docs``.

    A window is k consecutive words ``[^\\x20\\x09-\\x0D]+`` of one text. Every word covered by a
    window whose word sequence also starts anywhere else, in the same text too, is removed;
    windows are judged on the input. The kept words of a changed text are joined by one space; an
    unchanged text stays as it is. With ``digests``, ``kept_sha256`` of the kept words joined by one space
    takes the place of ``text``. Texts that are null, empty or shorter than k words lose nothing
    (null becomes empty). Repeated rows count as repetitions. Other columns are ignored.
    """
    kind = docs.schema[key].dataType
    shape = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("n_windows", T.LongType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("blob", T.BinaryType())])
    packed = docs.select(F.col(key).alias("id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    chunks = written(packed.mapInArrow(_pack(k), shape), "chunks")
    windows = chunks.agg(F.coalesce(F.sum("n_windows"), F.lit(0))).first()[0]
    buckets = max(8, -(-windows * 8 // BUCKET_BYTES))
    dealt = chunks.where("n_windows > 0").select("chunk", "lengths", "blob").mapInArrow(_deal(k, buckets), "bucket int, chunk long, hashes binary")
    shared = dealt.groupBy("bucket").applyInArrow(_shared, "chunk long, bucket int, bits binary")
    found = shared.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("found"))
    both = chunks.select("chunk", "ids", "lengths", "blob").join(found, "chunk", "left").select("ids", "lengths", "blob", "found")
    last = "kept_sha256" if digests else "text"
    shape = T.StructType([T.StructField("doc_id", kind), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField(last, T.StringType())])
    return both.mapInArrow(_remove(k, buckets, not digests), shape)


def without_repeated(docs: DataFrame, k: int = 35) -> DataFrame:
    """``docs`` with the repeated windows removed from ``text``; ``n_chars``, if there, is counted anew. Other columns stay.

    Null and empty texts become empty, kept words are joined by one space. Repeated rows repeat each other's windows, so their texts of k words or
    more are emptied, all of them. An empty table gives an empty table.
    """
    rest = [c for c in docs.columns if c != "text"]
    whole = remove_repeated(docs.select(F.struct(*rest).alias("rest"), "text"), key="rest", k=k).select("doc_id.*", "text")
    if "n_chars" in rest:
        whole = whole.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return whole.select(*docs.columns)
