"""Repeated passages by super-k-mers, shared by substring dedup (words) and suffix dedup (bytes).

A text is a row of symbols (words or bytes). Of each window of ``window`` symbols the minimiser
is the k-mer with the least hash (the leftmost of equal ones); consecutive windows with the
same minimiser form a piece, which travels as one packed string of fewer than
``2 * window - k + 1`` symbols. Equal windows have equal minimisers, so they meet:

1. Pieces of every whole text are cut in Arrow batches: minimiser, hash of the packed string, place.
2. Only pieces whose minimiser occurs more than once go on. Occurrences are counted with
   aggregation before the shuffle, so a minimiser of a third of all pieces is a row per task.
3. Equal packed strings become one row with their first place. Any later one repeats it whole.
4. The packed strings of minimisers that have several different strings are fetched and dealt
   by minimiser to buckets, where a caller's function finds equal windows in chunks of bounded
   size. A minimiser with more than ``BUCKET_STRINGS`` different strings is compared window by
   window instead, by 128-bit hashes aggregated before the shuffle: no bucket grows unbounded.
5. Each text gets the places at which windows repeat earlier ones.

Documents are ordered by ``key``: the id itself where ids are whole numbers, not null and not
repeated, else the rank of (id, hash of the text), nulls first. Equal rows are then one
document: both get its result.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import parts_for, running_totals, stored
from riskloom.session import materialize

BLOCK_BYTES = 1 << 19
CHUNK_BYTES = 1 << 19
BUCKET_STRINGS = 20_000
FACTOR = 0xD6E8FEB86659FD93
SPACE = re.compile(rb"[\x20\x09-\x0d]")


# ---------------------------------------------------------------- in tasks

def mixed(h):
    import numpy as np

    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def symbol_table():
    import numpy as np

    return np.random.default_rng(7).integers(0, 1 << 64, 256, "u8", endpoint=False)


def rolled(h, k: int):
    """Hash of each run of ``k`` symbols from the symbols' hashes, by doubling."""
    import numpy as np

    count, out, at, size, power = len(h) - k + 1, None, 0, 1, np.uint64(FACTOR)
    while True:
        if k & size:
            part = h[at:at + count]
            out = part if out is None else out * power + part
            at += size
        if size * 2 > k:
            return mixed(out)
        h = h[:-size] * power + h[size:]
        power, size = power * power, size * 2


def least(values, width: int):
    """Least of each ``width`` consecutive values, by doubling."""
    import numpy as np

    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


def cut_pieces(hashes, ends, window: int, k: int, step: int = 1 << 20):
    """(first window, windows, minimiser) of each piece; ``ends`` closes each text."""
    import numpy as np

    starts, counts, minis = [np.zeros(0, "i8")], [np.zeros(0, "i8")], [np.zeros(0, "i8")]
    place = np.uint64((1 << 21) - 1)
    with np.errstate(over="ignore"):
        for base in range(0, len(hashes) - window + 1, step):
            mers = rolled(hashes[base:base + step + window - 1], k)
            at = (least((mers & ~place) | np.arange(len(mers), dtype="u8"), window - k + 1) & place).astype("i8")
            for e in ends[:-1] - base:  # windows that would cross into the next text
                if 0 < e < len(at) + window:
                    at[max(0, e - window + 1):e] = -1
            first = np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1))
            n = np.diff(np.append(first, len(at)))
            real = at[first] >= 0
            first, n = first[real], n[real]
            starts.append(first + base)
            counts.append(n)
            minis.append(mers[at[first]].view("i8"))
    return np.concatenate(starts), np.concatenate(counts), np.concatenate(minis)


def minimiser_places(strings, window: int, k: int):
    """Place of the minimiser in each packed string of bytes (one piece each): that of its first window."""
    import numpy as np

    out, block, size = [], [], 0
    place = np.uint64((1 << 21) - 1)

    def close(some):
        data = np.frombuffer(b"".join(some), "u1")
        heads = np.concatenate(([0], np.cumsum([len(s) for s in some])[:-1]))
        with np.errstate(over="ignore"):
            mers = rolled(symbol_table()[data], k)
        at = least((mers & ~place) | np.arange(len(mers), dtype="u8"), window - k + 1) & place
        return at[heads].astype("i8") - heads

    for s in strings:
        block.append(s)
        size += len(s)
        if size >= 1 << 20:
            out.append(close(block))
            block, size = [], 0
    if block:
        out.append(close(block))
    return np.concatenate(out)


class Bytes:
    """Texts as bytes."""

    window, k = 100, 24

    @classmethod
    def parts(cls, raw: bytes):
        """(number of the first symbol, bytes) of parts that hold each window once."""
        more = cls.window - 1
        return [(at, raw[at:at + BLOCK_BYTES + more]) for at in range(0, max(1, len(raw) - more), BLOCK_BYTES)]

    @staticmethod
    def symbols(data, offsets):
        """Hash, first byte and end of each symbol; ends of the texts in symbols."""
        import numpy as np

        at = np.arange(len(data), dtype="i8")
        return symbol_table()[data], at, at + 1, offsets[1:]

    @staticmethod
    def packed(raw: bytes) -> bytes:
        return raw

    @classmethod
    def cutter(cls, raw: bytes):
        return lambda at, n: raw[at:at + n + cls.window - 1]


class Words:
    """Texts as words; a packed string has single spaces."""

    window, k = 13, 4

    @classmethod
    def parts(cls, raw: bytes):
        out, tail, at, first = [], [], 0, 0
        # as many new bytes as the tail has, at least, so that long words aren't copied into many parts
        while (more := max(BLOCK_BYTES, sum(map(len, tail)))) < len(raw) - at and (cut := SPACE.search(raw, at + more)):
            part = b" ".join([*tail, raw[at:cut.start()]])
            words = part.split()
            if len(words) > len(tail):  # else white space only
                out.append((first, part))
            tail = words[1 - cls.window:]  # the next part begins with them
            first += len(words) - len(tail)
            at = cut.start()
        return [*out, (first, b" ".join([*tail, raw[at:]]))]

    @staticmethod
    def symbols(data, offsets):
        import numpy as np

        space = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        starts = np.flatnonzero(~space & (np.concatenate(([True], space[:-1])) | edge[:-1]))
        ends = np.flatnonzero(~space & (np.concatenate((space[1:], [True])) | edge[1:])) + 1
        if not len(starts):
            return np.zeros(0, "u8"), starts, ends, np.zeros(len(offsets) - 1, "i8")
        lengths = ends - starts
        heads = np.cumsum(lengths) - lengths
        inside = np.arange(int(lengths.sum())) - np.repeat(heads, lengths)
        with np.errstate(over="ignore"):
            powers = np.multiply.accumulate(np.concatenate((np.ones(1, "u8"), np.full(1023, FACTOR, "u8"))))
            hashes = mixed(np.add.reduceat(symbol_table()[data[~space]] * powers[inside & 1023], heads))
        return hashes, starts, ends, np.searchsorted(starts, offsets[1:])

    @staticmethod
    def packed(raw: bytes) -> bytes:
        return b" ".join(raw.split())

    @classmethod
    def cutter(cls, raw: bytes):
        words = raw.split()
        return lambda at, n: b" ".join(words[at:at + n + cls.window - 1])


def piece_batches(unit):
    """Function for mapInArrow: (key, text) to PIECES."""

    def cut(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        digest = xxhash.xxh3_64_intdigest

        def block(names, firsts, held):
            data, offsets = b"".join(held), np.cumsum([0, *map(len, held)])
            hashes, begin, end, ends = unit.symbols(np.frombuffer(data, "u1"), offsets)
            start, n, mini = cut_pieces(hashes, ends, unit.window, unit.k)
            if not len(start):
                return None
            text = np.searchsorted(ends, start, side="right")
            heads = np.concatenate(([0], ends[:-1]))
            a, b = begin[start].tolist(), end[start + n + unit.window - 2].tolist()
            packed = np.array([digest(unit.packed(data[x:y])) for x, y in zip(a, b, strict=True)], "u8").view("i8")
            at = start - heads[text] + np.array(firsts, "i8")[text]
            return pa.RecordBatch.from_arrays(
                [pa.array(mini), pa.array(packed), pa.array(np.array(names, "i8")[text]), pa.array(at), pa.array(n.astype("i4"))],
                ["mini", "packed_hash", "key", "at", "n"])

        names, firsts, held, size = [], [], [], 0
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                for first, part in unit.parts(raw):
                    if size and size + len(part) > BLOCK_BYTES:
                        if (out := block(names, firsts, held)) is not None:
                            yield out
                        names, firsts, held, size = [], [], [], 0
                    names.append(key)
                    firsts.append(first)
                    held.append(part)
                    size += len(part)
        if size and (out := block(names, firsts, held)) is not None:
            yield out

    return cut


def fetch_batches(unit):
    """Function for mapInArrow: texts with lists of pieces to the pieces' packed strings."""

    def fetch(batches):
        import pyarrow as pa

        for batch in batches:
            counts, wanted = batch.column("wanted").value_lengths().to_pylist(), batch.column("wanted").flatten()
            lo = 0
            for key, text, count in zip(batch.column("key").to_pylist(), batch.column("text"), counts, strict=True):
                cut = unit.cutter(text.as_buffer().to_pybytes() if text.is_valid else b"")
                some = wanted.slice(lo, count)
                at, n = some.field("at"), some.field("n")
                packed = [cut(a, m) for a, m in zip(at.to_pylist(), n.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [some.field("mini"), some.field("packed_hash"), pa.array([key] * count, pa.int64()), at, n, some.field("hot"), pa.array(packed, pa.binary())],
                    ["mini", "packed_hash", "key", "at", "n", "hot", "packed"])
                lo += count

    return fetch


def bucket_batches(find: Callable):
    """Function for mapInArrow over strings sorted by minimiser: runs of repeated windows.

    ``find(keys, places, strings)`` returns (string, window) of each window that repeats an earlier one.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def close(rows):
            which, window = find([r[2] for r in rows], [r[3] for r in rows], [r[4] for r in rows])
            if not len(which):
                return None
            order = np.lexsort((window, which))
            which, window = np.asarray(which)[order], np.asarray(window)[order]
            cut = np.flatnonzero(np.concatenate(([True], (np.diff(which) != 0) | (np.diff(window) != 1))))
            n = np.diff(np.append(cut, len(which)))
            own = [rows[i] for i in which[cut].tolist()]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in own], pa.int64()), pa.array([r[1] for r in own], pa.int64()), pa.array([r[2] for r in own], pa.int64()),
                 pa.array([r[3] for r in own], pa.int64()), pa.array(window[cut], pa.int32()), pa.array(n, pa.int32())],
                ["mini", "packed_hash", "key", "at", "off", "n"])

        rows, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("mini", "packed_hash", "key", "at", "packed")), strict=True):
                if size >= CHUNK_BYTES and row[0] != last:
                    if (out := close(rows)) is not None:
                        yield out
                    rows, size = [], 0
                rows.append(row)
                size += len(row[4])
                last = row[0]
        if rows and (out := close(rows)) is not None:
            yield out

    return run


def window_batches(unit):
    """Function for mapInArrow: packed strings to a 128-bit hash of each of their windows."""

    def windows(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        digest = xxhash.xxh3_128_digest
        for batch in batches:
            n = batch.column("n").to_numpy()
            cuts = map(unit.cutter, batch.column("packed").to_pylist())
            hashes = np.frombuffer(b"".join([digest(cut(i, 1)) for cut, m in zip(cuts, n.tolist(), strict=True) for i in range(m)]), "i8").reshape(-1, 2)
            off = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            own = [pa.array(np.repeat(batch.column(c).to_numpy(), n)) for c in ("mini", "packed_hash", "key", "at")]
            yield pa.RecordBatch.from_arrays([pa.array(hashes[:, 0].copy()), pa.array(hashes[:, 1].copy()), *own, pa.array(off.astype("i8"))],
                                             ["w1", "w2", "mini", "packed_hash", "key", "at", "off"])

    return windows


def span_arrays(column):
    """For each row of an Arrow list of (at, n), its two arrays (None for a null list)."""
    import numpy as np

    lengths, flat = column.value_lengths().to_pylist(), column.flatten()
    at, n, lo, out = flat.field("at").to_numpy(), flat.field("n").to_numpy(), 0, []
    for m in lengths:
        out.append(None if m is None else (at[lo:lo + m].astype(np.int64), n[lo:lo + m].astype(np.int64)))
        lo += m or 0
    return out


def keep_mask(n: int, spans, window: int):
    """Which of ``n`` symbols no span of windows (arrays of first window and number) covers."""
    import numpy as np

    edge = np.zeros(n + 1, "i8")
    if spans is not None:
        np.add.at(edge, spans[0], 1)
        np.add.at(edge, spans[0] + spans[1] + window - 1, -1)
    return np.cumsum(edge[:-1]) == 0


# ---------------------------------------------------------------- on the cluster

def document_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with a whole-number ``key`` in id order, one for each different (id, text)."""
    key = F.col(f"`{id_col}`")
    if docs.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        ids = docs.select(key.alias("id"))
        plain = not ids.groupBy("id").count().where("id IS NULL OR count > 1").head(1)
        if plain:
            return docs.withColumn("key", key.cast("long")).where("key IS NOT NULL")
    own = docs.select(key.alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_key")).distinct().withColumn("one", F.lit(1))
    own = own.withColumn("known", F.col("id").isNotNull())
    own = materialize(own, "ids")
    ranks = running_totals(own, ["known", "id", "text_key"], "one", "key", parts_for(own.count(), 1_000_000))
    ranks = materialize(ranks.select("id", "text_key", F.col("key").cast("long").alias("key")), "keys")
    return docs.join(ranks, key.eqNullSafe(F.col("id")) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col("text_key"))).drop("id", "text_key").where("key IS NOT NULL")


def _shared_pieces(texts: DataFrame, unit, same_document: bool) -> DataFrame:
    pieces = texts.mapInArrow(piece_batches(unit), "mini long, packed_hash long, key long, at long, n int")
    again = F.count("*") > 1 if same_document else F.min("key") < F.max("key")
    # stored before the join, so that adaptive execution can split a frequent minimiser's pieces
    minis = stored(pieces.groupBy("mini").agg(again.alias("again")).where("again").select("mini"), "minimisers")
    return stored(pieces.join(minis, "mini"), "pieces")


def _strings(shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per different packed string with its first place; those whose minimiser has several, with their number."""
    first = shared.groupBy("mini", "packed_hash").agg(F.min(F.struct("key", "at", "n")).alias("first"))
    first = stored(first.select("mini", "packed_hash", "first.key", "first.at", "first.n"), "first-places")
    counts = stored(first.groupBy("mini").agg(F.count("*").alias("strings")).where("strings > 1"), "string-counts")
    return first, first.join(counts, "mini")


def _fetched(texts: DataFrame, unit, several: DataFrame) -> DataFrame:
    """Packed strings of the pieces; ``hot`` tells those of minimisers with too many."""
    wanted = several.groupBy("key").agg(F.collect_list(F.struct(
        "mini", "packed_hash", "at", "n", (F.col("strings") > BUCKET_STRINGS).alias("hot"))).alias("wanted"))
    return stored(texts.join(wanted, "key").mapInArrow(
        fetch_batches(unit), "mini long, packed_hash long, key long, at long, n int, hot boolean, packed binary"), "packed")


def _marks(fetched: DataFrame, unit, find: Callable, same_document: bool) -> DataFrame:
    """Runs of windows of first places that repeat earlier ones."""
    parts = int(fetched.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = fetched.where("NOT hot").select("mini", "packed_hash", "key", "at", "packed")
    dealt = dealt.repartition(parts, "mini").sortWithinPartitions("mini")
    marks = dealt.mapInArrow(bucket_batches(find), "mini long, packed_hash long, key long, at long, off int, n int")
    hot = fetched.where("hot")
    if hot.head(1):
        windows = stored(hot.mapInArrow(window_batches(unit), "w1 long, w2 long, mini long, packed_hash long, key long, at long, off long"), "windows")
        place = F.struct("key", (F.col("at") + F.col("off")).alias("p"))
        earliest = windows.groupBy("w1", "w2").agg(F.min(place).alias("e"))
        late = (place > F.col("e")) if same_document else (F.col("key") > F.col("e.key"))
        marks = marks.unionByName(windows.join(earliest, ["w1", "w2"]).where(late).select(
            "mini", "packed_hash", "key", "at", F.col("off").cast("int"), F.lit(1).alias("n")))
    return stored(marks, "marks")


def repeated_spans(texts: DataFrame, unit, find: Callable, same_document: bool) -> DataFrame:
    """``key`` and ``spans``: runs (``at``, ``n``) of windows of the text that repeat an earlier
    document's (with ``same_document`` also an earlier window of its own). ``texts``: ``key``, ``text``."""
    shared = _shared_pieces(texts, unit, same_document)
    strings, several = _strings(shared)
    marks = _marks(_fetched(texts, unit, several), unit, find, same_document)

    firsts = strings.select("mini", "packed_hash", F.col("key").alias("key0"), F.col("at").alias("at0"))
    placed = shared.join(firsts, ["mini", "packed_hash"])
    later = F.struct("key", "at") > F.struct(F.col("key0").alias("key"), F.col("at0").alias("at")) if same_document else F.col("key") > F.col("key0")
    spans = placed.where(later).select("key", "at", "n")
    spans = spans.unionByName(marks.select("key", (F.col("at") + F.col("off")).alias("at"), "n"))
    if not same_document:  # a string's other places in its first document share its repeated windows
        twins = placed.where("key = key0 AND at <> at0").select("mini", "packed_hash", "key", "at")
        found = marks.select("mini", "packed_hash", "off", F.col("n").alias("m"))
        spans = spans.unionByName(twins.join(found, ["mini", "packed_hash"]).select("key", (F.col("at") + F.col("off")).alias("at"), F.col("m").alias("n")))
    return stored(spans.groupBy("key").agg(F.collect_list(F.struct("at", "n")).alias("spans")), "spans")
