"""Token ids as binary files of directly addressable codes.

An id is cut into 8-bit chunks, lowest first; level k holds the k-th chunks of all ids that
have one. A bitmap per level says which ids continue, and a directory has the number of
continuing ids before each 64: so the place of an id's next chunk is a rank, and any id is
read without decoding its neighbours.

A shard (``SHARD_IDS`` ids or a little more, whole documents) is one payload:
``DAC1``, number of levels (u32), then for each level: number of chunks (u32), the chunks (one
byte each), the bitmap (u64 words), the directory (u32 per word); all little-endian. Shards
are written as rows of Parquet files (``part``, ``shard``, ids before it in the part, document ids and lengths, payload),
which Spark commits and repeats when an executor is lost and which any store can hold. Shard
order is that of the range partitions, so documents are in ascending id order.

Defined results: a null or empty text is the end id alone; null ids come first; rows with the
same id are ordered by a hash of their text; repeated rows are all written; an empty table
gives an empty folder of shards.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.tokens import TOKENIZER, task_encoder
from riskloom.session import work_path

SHARD_IDS = 1 << 17


def encode_codes(ids) -> bytes:
    """The payload of one shard."""
    import numpy as np

    levels, rest = [], np.asarray(ids, "<u4")
    while len(rest):
        more = rest >> 8
        goes_on = more > 0
        words = np.zeros((len(rest) + 63) // 64 * 8, "u1")
        packed = np.packbits(goes_on, bitorder="little")
        words[:len(packed)] = packed
        words = words.view("<u8")
        before = np.cumsum(np.bitwise_count(words), dtype="<u4") - np.bitwise_count(words)
        levels.append(struct.pack("<I", len(rest)) + (rest & 255).astype("u1").tobytes() + words.tobytes() + before.astype("<u4").tobytes())
        rest = more[goes_on]
    return b"DAC1" + struct.pack("<I", len(levels)) + b"".join(levels)


class Codes:
    """Random access to the ids of a payload."""

    def __init__(self, payload: bytes):
        import numpy as np

        if payload[:4] != b"DAC1":
            raise ValueError("not a payload of this format")
        self.levels, at = [], 8
        for _ in range(struct.unpack_from("<I", payload, 4)[0]):
            n = struct.unpack_from("<I", payload, at)[0]
            words = (n + 63) // 64
            chunks = np.frombuffer(payload, "u1", n, at + 4)
            bits = np.frombuffer(payload, "<u8", words, at + 4 + n)
            before = np.frombuffer(payload, "<u4", words, at + 4 + n + 8 * words)
            self.levels.append((chunks, bits, before))
            at += 4 + n + 12 * words

    def __len__(self) -> int:
        return len(self.levels[0][0]) if self.levels else 0

    def get(self, places):
        """Ids at any places, in any order."""
        import numpy as np

        places = np.asarray(places, "i8")
        out, which = np.zeros(len(places), "<u4"), np.arange(len(places))
        for k, (chunks, bits, before) in enumerate(self.levels):
            out[which] |= chunks[places].astype("<u4") << np.uint32(8 * k)
            word, bit = bits[places >> 6], (places & 63).astype("u8")
            on = ((word >> bit) & np.uint64(1)).astype(bool)
            which, places = which[on], places[on]
            if not len(which):
                break
            below = word[on] & ((np.uint64(1) << bit[on]) - np.uint64(1))
            places = before[places >> 6].astype("i8") + np.bitwise_count(below)
        return out


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                      tokenizer: str = TOKENIZER, end_id: int = 1, shard_ids: int = SHARD_IDS) -> None:
    """Tokenises ``docs`` and writes shards below ``path``. Tasks hold one shard and one document at a time."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def shards(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, shard, offset = TaskContext.get().partitionId(), 0, 0
        encoder, keys, parts, held = task_encoder(tokenizer, end_id), [], [], 0

        def flush():
            ids = np.frombuffer(b"".join(parts), "<u4")
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([keys], pa.list_(id_kind)),
                 pa.array([[len(x) // 4 for x in parts]], pa.list_(pa.int64())), pa.array([offset]), pa.array([len(ids)]),
                 pa.array([encode_codes(ids)], pa.binary())],
                ["part", "shard", "doc_ids", "n_tokens", "part_offset", "shard_tokens", "payload"])

        for batch in batches:
            id_kind = batch.column(0).type
            for key, data in zip(batch.column(0).to_pylist(), encoder.encode(t.as_py() for t in batch.column(1)), strict=True):
                keys.append(key)
                parts.append(data)
                held += len(data) // 4
                if held >= shard_ids:
                    yield flush()
                    keys, parts, held, shard, offset = [], [], 0, shard + 1, offset + held
        if keys:
            yield flush()

    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 2)  # longer tasks meet fewer new words
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    sorted_ = slim.repartitionByRange(n, *order).sortWithinPartitions(*order)
    schema = f"part int, shard int, doc_ids array<{id_type}>, n_tokens array<bigint>, part_offset long, shard_tokens long, payload binary"
    sorted_.mapInArrow(shards, schema).write.option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Shards with ``shard_start``, the number of ids in all shards before. Payloads are not moved."""
    df = spark.read.parquet(path)
    sums = df.groupBy("part").agg(F.sum("shard_tokens").alias("part_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range partition
    starts = sums.select("part", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("part_start"))
    return df.join(F.broadcast(starts), "part").withColumn("shard_start", F.col("part_start") + F.col("part_offset")).drop("part_start")


def token_digests(files: DataFrame) -> DataFrame:
    """Per document of the files: ``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32``, from ids read by place."""
    id_type = files.schema["doc_ids"].dataType.elementType.simpleString()

    def digests(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for keys, lengths, start, payload in zip(*batch.columns, strict=True):
                codes, at, out = Codes(payload.as_py()), start.as_py(), []
                ids = memoryview(codes.get(np.arange(len(codes))).tobytes())
                for n in lengths.as_py():
                    first = 4 * (at - start.as_py())
                    out.append((at, n, zlib.crc32(ids[first:first + 4 * n])))
                    at += n
                yield pa.RecordBatch.from_arrays([keys.values, *[pa.array(c, pa.int64()) for c in zip(*out, strict=True)]],
                                                 ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("doc_ids", "n_tokens", "shard_start", "payload").mapInArrow(
        digests, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def write_and_digest(docs: DataFrame, **options) -> DataFrame:
    """Writes ``docs`` to a fresh shared folder, reads the files back and digests each document."""
    path = work_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, **options)
    return token_digests(read_token_files(docs.sparkSession, path))
