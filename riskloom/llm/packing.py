"""Bounded-space online best-fit packing of token pieces.

Each task keeps a fixed number of open sequences. A bitset has a bit for each amount of free
space that some open sequence has; the lowest bit at or above a piece's length names the best
fit. When nothing fits and the number is reached, the fullest open sequence closes first.
Pieces are dealt evenly and at random over tasks, so no key decides a task's load. What is
still open when a task ends is unpacked and goes to a next round of a sixteenth of the tasks,
until one task is left; so the half-filled rest doesn't grow with the number of tasks.

Defined results: a null or empty text is a document of the end id alone (one piece of length
1); repeated rows and null ids are packed like any other row; only longer documents are cut;
an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import parts_for
from riskloom.llm.tokens import TOKENIZER, task_encoder
from riskloom.session import materialize

PIECE_FIELDS = "piece int, start long, length long, ids_crc32 long"


class BestFit:
    """Open sequences by free space; ``place`` returns (sequence, offset, sequences closed by it)."""

    def __init__(self, capacity: int, open_limit: int):
        self.capacity, self.open_limit = capacity, open_limit
        self.bits, self.by_free, self.n_open, self.made = 0, {}, 0, 0

    def _take(self, free: int) -> int:
        held = self.by_free[free]
        found = held.pop()
        if not held:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return found

    def place(self, length: int) -> tuple[int, int, list[int]]:
        closed = []
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            found = self._take(free)
        else:
            if self.n_open == self.open_limit and length < self.capacity:
                closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
            found, free = self.made, self.capacity
            self.made += 1
        left = free - length
        if left:
            self.by_free.setdefault(left, []).append(found)
            self.bits |= 1 << left
            self.n_open += 1
        else:
            closed.append(found)
        return found, self.capacity - free, closed


def cut_documents(docs: DataFrame, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text",
                  tokenizer: str = TOKENIZER, end_id: int = 1) -> DataFrame:
    """Tokenised pieces of at most ``capacity`` ids: ``doc_id`` and PIECE_FIELDS."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut(batches):
        import zlib

        import pyarrow as pa

        encoder = task_encoder(tokenizer, end_id)
        for batch in batches:
            rows, out = [], []
            for row, data in enumerate(encoder.encode(t.as_py() for t in batch.column(1))):
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    piece = data[at:at + 4 * capacity]
                    rows.append(row)
                    out.append((k, at // 4, len(piece) // 4, zlib.crc32(piece)))
            columns = zip(list(zip(*out, strict=True)) or [()] * 4, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(c, t) for c, t in columns]],
                                             ["doc_id", "piece", "start", "length", "ids_crc32"])

    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return slim.mapInArrow(cut, f"doc_id {id_type}, {PIECE_FIELDS}")


def pack_pieces(pieces: DataFrame, capacity: int = 4096, open_limit: int = 256, per_task: int = 20_000, merge: int = 16) -> DataFrame:
    """``pieces`` plus ``sequence_id`` (any number) and ``offset`` in it. Reads ``length``; other columns stay.

    ``pieces`` is read more than once: pass a written table.
    """
    fields = pieces.columns

    def packer(level):
        def pack(batches):
            import pyarrow as pa
            from pyspark import TaskContext

            base = (level << 56) + (TaskContext.get().partitionId() << 32)
            bins, held = BestFit(capacity, open_limit), {}

            def told(rows, still_open):
                columns = list(zip(*rows, strict=True)) or [()] * (len(fields) + 2)
                return pa.RecordBatch.from_arrays(
                    [*[pa.array(c, t) for c, t in zip(columns, types, strict=True)], pa.array([still_open] * len(rows), pa.bool_())],
                    [*fields, "sequence_id", "offset", "_open"])

            types = None
            for batch in batches:
                types, out = [*batch.schema.types, pa.int64(), pa.int64()], []
                for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    found, offset, closed = bins.place(row[at])
                    held.setdefault(found, []).append((*row, base + found, offset))
                    for x in closed:
                        out += held.pop(x)
                yield told(out, False)
            if held:
                yield told([r for rows in held.values() for r in rows], True)
        at = fields.index("length")
        return pack

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long, _open boolean"
    parts, left, done, level = parts_for(pieces.count(), per_task), pieces, [], 0
    while True:
        # dealt round-robin: the same number of pieces for every task, whatever the keys
        dealt = left.repartition(parts).sortWithinPartitions(F.xxhash64(*[F.col(f"`{c}`") for c in fields]))
        packed = materialize(dealt.mapInArrow(packer(level), schema), "packed")
        if parts == 1:
            done.append(packed)
            break
        done.append(packed.where("NOT _open"))
        left = packed.where("_open").select(*[f"`{c}`" for c in fields])
        parts, level = math.ceil(parts / merge), level + 1
    return reduce(DataFrame.unionByName, done).drop("_open")


def pack_documents(docs: DataFrame, capacity: int = 4096, open_limit: int = 256, id_col: str = "doc_id",
                   text_col: str = "text", tokenizer: str = TOKENIZER, end_id: int = 1) -> DataFrame:
    """One row per piece: ``doc_id``, PIECE_FIELDS, ``sequence_id`` and ``offset``."""
    pieces = materialize(cut_documents(docs, capacity, id_col, text_col, tokenizer, end_id), "pieces")
    return pack_pieces(pieces, capacity, open_limit)
