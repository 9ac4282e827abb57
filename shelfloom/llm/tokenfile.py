"""Token-ID files: independent zstandard frames, a trailing seek table and a checksum for each frame.

A file holds the documents of one range of doc_id in ascending order, a frame each:

    frame*  seek table (one 40-byte entry a frame)  trailer (magic, version, entries, bytes of the table, its crc32)

An entry is doc_id, offset, compressed bytes, number of ids, crc32 of the ids as unsigned 32-bit integers. A reader takes the
files whose range can hold the documents asked for from the manifest, fetches the trailer, then the table, then only the
frames wanted, neighbours together, and checks each by its checksum. Frames are made where texts are read, so only compressed
ids are shuffled; the files of a lost executor are written again under a new name and moved into place. More data make more
files, not larger ones: ranges are of (doc_id, a hash of the text), so that many rows of one doc_id, or without one, are split.
There are at most MOST_RANGES ranges, so their bounds stay small at any size; a task cuts its range into as many files as it needs.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, fresh_dir, prepared
from .tokens import encoder

MAGIC, VERSION = b"ZTOK", 1
ENTRY = np.dtype([("doc_id", "<i8"), ("offset", "<i8"), ("size", "<i8"), ("ids", "<i8"), ("crc32", "<u4"), ("flags", "<u4")])
TRAILER = "<4sIQQI"
#: flags of an entry: 1: doc_id is null; 2: ids are stored in 16 bits.
NULL_ID, NARROW = 1, 2
MANIFEST = "shard int, file string, n_docs long, n_ids long, first_id long, last_id long"


#: Ranges that rows are dealt to, at most; files of a range, at most.
MOST_RANGES, MOST_FILES = 4096, 1 << 18
#: Bytes that one read takes together, at most, unless a single frame is longer.
READ = 8 << 20


def bounds_of(docs: DataFrame, shards: int) -> np.ndarray:
    """Least (doc_id, hash) of each range but the first, in order: rows of (is there a doc_id, doc_id, hash)."""
    if shards < 2:
        return np.zeros((0, 3), np.int64)
    keys = docs.select(F.coalesce("doc_id", F.lit(0)).alias("d"), F.col("doc_id").isNotNull().cast("long").alias("there"), "h")
    parts = keys.repartitionByRange(shards, "there", "d", "h").select(F.spark_partition_id().alias("part"), F.struct("there", "d", "h").alias("k"))
    least = parts.groupBy("part").agg(F.min("k").alias("k")).orderBy("k").select("k.*").toPandas()  # a row for each range
    return least.to_numpy(np.int64)[1:]


def shards_of(doc_ids: list[int | None], hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Number of the bounds that are not above each (doc_id, hash)."""
    if not len(bounds):
        return np.zeros(len(doc_ids), np.int64)
    kind = np.dtype([("there", "<i8"), ("d", "<i8"), ("h", "<i8")])
    own = np.empty(len(doc_ids), kind)
    own["there"], own["d"], own["h"] = [d is not None for d in doc_ids], [d or 0 for d in doc_ids], hashes
    edge = np.array([tuple(b) for b in bounds.tolist()], kind)
    return np.searchsorted(edge, own, side="right")


def token_frames(docs: DataFrame, tokenizer: str, kind: str, end_id: int, bounds: np.ndarray, level: int = 1) -> DataFrame:
    """A row for each row of docs (doc_id, h, text): shard (number of the range), doc_id, h, chars, n_ids, crc32, flags, frame. A null text is empty."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        enc, pack = encoder(tokenizer, kind), zstandard.ZstdCompressor(level=level, write_checksum=True)
        for batch in batches:
            docs_, texts, hashes = column(batch, "doc_id"), [t or "" for t in column(batch, "text")], np.array(column(batch, "h"), np.int64)
            rows = []
            for d, h, text, shard, ids in zip(docs_, hashes.tolist(), texts, shards_of(docs_, hashes, bounds).tolist(), enc.ids(texts), strict=True):
                ids = np.append(ids, np.uint32(end_id))
                narrow = int(ids.max()) < 1 << 16
                rows.append((shard, d, h, len(text), len(ids), zlib.crc32(ids.astype("<u4").tobytes()), NARROW * narrow + NULL_ID * (d is None), pack.compress(ids.astype("<u2" if narrow else "<u4").tobytes())))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["shard", "doc_id", "h", "chars", "n_ids", "crc32", "flags", "frame"])

    return docs.mapInArrow(encode, "shard int, doc_id long, h long, chars long, n_ids long, crc32 long, flags int, frame binary")


def write_token_files(docs: DataFrame, path: str, tokenizer: str, kind: str, end_id: int = 1, shard_chars: int = 32 << 20) -> DataFrame:
    """Write docs (doc_id, text) to path and return the manifest (shard, file, n_docs, n_ids, first_id, last_id), which is saved beside the files.

    Ids are those of the tokenizers library without special tokens, then end_id. Documents lie in ascending order of doc_id
    (null first; equal ids by a hash of the text), null texts as empty ones. A file holds about shard_chars characters, and
    half as many more at the most, or one document. Other columns are ignored; an empty table gives an empty manifest.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("h", F.xxhash64("text"))
    size = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    ranges = max(1, min(MOST_RANGES, -(-size // shard_chars)))
    frames = token_frames(rows, tokenizer, kind, end_id, bounds_of(rows, ranges))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        done, sink, range_, number = [], None, None, 0

        def close() -> None:
            shard = range_ * MOST_FILES + number
            index = np.array(entries, ENTRY).tobytes()
            sink.write(index + struct.pack(TRAILER, MAGIC, VERSION, len(entries), len(index), zlib.crc32(index)))
            sink.close()
            name = f"shard-{shard:010d}.ztok"
            store.move(draft, f"{root}/{name}")
            known = [e[0] for e in entries if not e[5] & NULL_ID]
            done.append((shard, name, len(entries), sum(e[3] for e in entries), known[0] if known else None, known[-1] if known else None))

        for batch in batches:
            for s, d, chars, n, crc, flags, frame in zip(*(column(batch, c) for c in ("shard", "doc_id", "chars", "n_ids", "crc32", "flags", "frame")), strict=True):
                if s != range_ or (entries and held + chars > 1.5 * shard_chars):
                    if sink:
                        close()
                    store.create_dir(root, recursive=True)
                    number = number + 1 if s == range_ else 0
                    if number >= MOST_FILES:
                        raise ValueError(f"a range needs over {MOST_FILES} files; raise shard_chars")
                    draft, range_, entries, at, held = f"{root}/.draft-{uuid.uuid4().hex}", s, [], 0, 0
                    sink = store.open_output_stream(draft)
                held += chars
                sink.write(frame)
                entries.append((d or 0, at, len(frame), n, crc, flags))
                at += len(frame)
        if sink:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int32(), pa.string(), *[pa.int64()] * 4), strict=True)], names=["shard", "file", "n_docs", "n_ids", "first_id", "last_id"])

    own = frames.repartitionById(int(ranges), "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "h", "n_ids", "crc32")
    manifest = own.drop("h").mapInArrow(write, MANIFEST)
    manifest.write.parquet(f"{path}/manifest")
    return docs.sparkSession.read.schema(manifest.schema).parquet(f"{path}/manifest")


def read_frames(store, file: str, wanted: set[int] | None = None) -> Iterator[tuple[int | None, int, bytes]]:
    """(doc_id, ids of the file's documents before it, its ids as little-endian unsigned 32-bit integers) of one file, or of the documents wanted."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    with store.open_input_file(file) as f:
        size, end = f.size(), struct.calcsize(TRAILER)
        magic, version, entries, table, crc = struct.unpack(TRAILER, f.read_at(end, size - end))
        raw = f.read_at(table, size - end - table)
        if magic != MAGIC or version != VERSION or zlib.crc32(raw) != crc:
            raise ValueError(f"{file}: not a token file of version {VERSION}, or its seek table is damaged")
        index = np.frombuffer(raw, ENTRY)
        if len(index) != entries:
            raise ValueError(f"{file}: the seek table is cut")
        before = np.cumsum(index["ids"]) - index["ids"]
        take = np.arange(len(index))
        if wanted is not None:
            take = take[np.isin(index["doc_id"], np.fromiter(wanted, np.int64, len(wanted))) & (index["flags"] & NULL_ID == 0)]
        i = 0
        while i < len(take):  # frames side by side are read together
            j = i + 1
            while j < len(take) and take[j] == take[j - 1] + 1 and index["offset"][take[j]] + index["size"][take[j]] - index["offset"][take[i]] <= READ:
                j += 1
            base = int(index["offset"][take[i]])
            block = f.read_at(int(index["offset"][take[j - 1]] + index["size"][take[j - 1]]) - base, base)
            for k in take[i:j].tolist():
                e = index[k]
                doc = None if e["flags"] & NULL_ID else int(e["doc_id"])
                at = int(e["offset"]) - base
                ids = np.frombuffer(unpack.decompress(block[at : at + int(e["size"])]), "<u2" if e["flags"] & NARROW else "<u4").astype("<u4").tobytes()
                if len(ids) != 4 * e["ids"] or zlib.crc32(ids) != e["crc32"]:
                    raise ValueError(f"{file}: document {doc} is damaged")
                yield doc, int(before[k]), ids
            i = j


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids) of the files in path, or of some documents; ids: little-endian unsigned 32-bit integers.

    Of the documents asked for, only files whose range of doc_id can hold one are opened. The manifest has a row for each
    file; its running sum goes by thousands of files, so no task holds all of it.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").withColumn("k", F.floor(F.col("shard") / 1024))
    earlier = lambda *by: Window.partitionBy(*by).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    thousands = manifest.groupBy("k").agg(F.sum("n_ids").alias("n"))
    base = F.coalesce(F.sum("n").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(earlier("k")), F.lit(0))).join(thousands.select("k", base.alias("base")), "k")
    if doc_ids is not None:
        asked = F.array(*(F.lit(int(d)) for d in doc_ids)).cast("array<long>")
        files = files.where(F.exists(asked, lambda d: d.between(F.col("first_id"), F.col("last_id"))))
    files = files.select("file", (F.col("base") + F.col("before")).alias("base"))
    wanted = None if doc_ids is None else set(doc_ids)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        names = ["doc_id", "start", "n_tokens", "ids"]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        for batch in batches:
            for file, base in zip(column(batch, "file"), column(batch, "base"), strict=True):
                rows, size = [], 0
                for doc, start, ids in read_frames(store, f"{root}/{file}", wanted):
                    rows.append((doc, base + start, len(ids) // 4, ids))
                    size += len(ids)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    tasks = max(1, 4 * spark.sparkContext.defaultParallelism)
    return files.repartition(tasks, "file").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the file format: doc_id, start, n_tokens, ids_crc32, from the files."""
    import public_tokenizers

    from .common import table

    prepared(spark)
    path = fresh_dir(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), "word")
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
