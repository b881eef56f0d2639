"""SimHash near duplicates by a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes. Two fingerprints that differ in at most ``d``
bits differ in at most ``d`` bytes, so they share at least ``8 - d`` positional bytes: the
guaranteed minimum of matches. A list for each single (position, byte) would hold 1/256 of all
fingerprints, so a posting joins several positional bytes: for ``d`` up to 3 the four
positions whose numbers XOR to zero (14 such planes; any three positions leave one plane
untouched), else every choice of ``8 - d`` positions. Pairs that meet in a list are tallied on
all eight bytes; those below the minimum go, the rest are verified by their differing bits.
A pair that meets in several lists counts in the first only.

A list of more than ``LONG`` fingerprints (a family of near but different texts) is not joined with
itself. Inside it only the bytes beyond the plane can differ, in at most ``d`` of their half-bytes, so
its members go to one finer list for each choice of half-bytes that ``d`` bits can leave untouched.
For ``d`` up to 3 a finer list leaves 12 bits open, so it holds at most 4,096 fingerprints,
however large the family: the work grows with its members, not with their square.

Rows are collapsed to distinct fingerprints before the index, so copies cost nothing there,
and classes come from the links of fingerprints by ``components``.

Defined results: a null or blank text has fingerprint zero, linked like any other; repeated
rows and equal ids get the same class; rows with a null id take part and get the class's
smallest id that is not null; other columns are not read; an empty table gives an empty one.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import boxed, unboxed
from riskloom.llm.components import components
from riskloom.session import materialize

BLOCK = 1 << 16
LONG = 1_024  # fingerprints of a posting list that is still joined with itself


def fingerprint_column(text: Column, shingle: int) -> Column:
    """Signed 64-bit SimHash of a text's word shingles (XXH64, seed 42)."""

    @F.pandas_udf("long")
    def fingerprints(texts):
        import numpy as np
        import pandas as pd
        import xxhash

        digest = xxhash.xxh64_digest

        def one(text):
            words = (text or "").encode().lower().split()
            if not words:
                return 0
            line = b" ".join(words)
            lengths = np.fromiter(map(len, words), "i8", len(words))
            ends = np.cumsum(lengths + 1) - 1
            starts = ends - lengths
            k = min(shingle, len(words))
            starts, ends = starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist()
            counts = np.zeros(64, "i8")
            for at in range(0, len(starts), BLOCK):
                data = b"".join([digest(line[a:b], 42) for a, b in zip(starts[at:at + BLOCK], ends[at:at + BLOCK])])
                counts += np.unpackbits(np.frombuffer(data, "u1").reshape(-1, 8), axis=1).sum(axis=0, dtype="i8")
            return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big", signed=True)

        return pd.Series([one(t) for t in texts], dtype="int64")

    return fingerprints(text)


def planes(max_bits: int) -> list[tuple[int, ...]]:
    """Choices of byte positions such that any ``max_bits`` positions leave one of them untouched."""
    if not 0 <= max_bits <= 7:
        raise ValueError("fingerprints that differ in 8 bits or more need not share a byte: max_bits is 0 to 7")
    if max_bits <= 3:
        return [p for p in combinations(range(8), 4) if reduce(int.__xor__, p) == 0]
    return list(combinations(range(8), 8 - max_bits))


def _byte(value: Column, position: int) -> Column:
    return F.shiftrightunsigned(value, 8 * position).bitwiseAND(F.lit(255))


def finer_masks(plane: tuple[int, ...], max_bits: int) -> list[int]:
    """Bits that members of a finer list share: the plane, and a choice of the other half-bytes such
    that any ``max_bits`` half-bytes leave one choice untouched."""
    free = [h for p in range(8) if p not in plane for h in (2 * p, 2 * p + 1)]
    masks = ((1 << 64) - 1 - sum(15 << 4 * h for h in open_) for open_ in combinations(free, max_bits))
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _met(postings: DataFrame, keys: list[str], chosen: list[tuple[int, ...]], max_bits: int) -> DataFrame:
    """Pairs ``a`` < ``b`` of the same list that pass the tally and the bit check, in the pair's first plane."""
    left, right = postings.withColumnRenamed("fp", "a"), postings.withColumnRenamed("fp", "b")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    same = [_byte(differ, p) == 0 for p in range(8)]
    tally = reduce(lambda x, y: x + y, [s.cast("int") for s in same])
    first = F.coalesce(*[F.when(reduce(lambda x, y: x & y, [same[p] for p in plane]), k) for k, plane in enumerate(chosen)])
    pairs = left.join(right, keys).where(
        (F.col("a") < F.col("b")) & (tally >= 8 - max_bits) & (F.bit_count(differ) <= max_bits) & (F.col("plane") == first))
    return pairs.select("a", "b")


def fingerprint_links(prints: DataFrame, max_bits: int, long: int = LONG) -> DataFrame:
    """Pairs ``a`` < ``b`` of the distinct fingerprints ``fp`` that differ in at most ``max_bits`` bits."""
    chosen = planes(max_bits)

    def key(k, plane):
        packed = [F.shiftleft(_byte(F.col("fp"), p), 8 * i) for i, p in enumerate(plane)]
        return F.struct(F.lit(k).cast("long").alias("plane"), reduce(lambda a, b: a.bitwiseOR(b), packed).alias("bytes"))

    postings = prints.select("fp", F.explode(F.array(*[key(k, p) for k, p in enumerate(chosen)])).alias("k")).select("fp", "k.plane", "k.bytes")
    lists = postings.groupBy("plane", "bytes").agg(F.count("*").alias("members")).where(F.col("members") > long)
    lists = materialize(lists.select("plane", "bytes"), "long-lists")
    short = _met(postings.join(lists, ["plane", "bytes"], "left_anti"), ["plane", "bytes"], chosen, max_bits)
    if lists.isEmpty():
        return short
    masks = [(k, m) for k, p in enumerate(chosen) for m in finer_masks(p, max_bits)]  # 784 for 3 bits
    masks = F.broadcast(prints.sparkSession.createDataFrame(masks, "plane long, mask long"))
    dense = postings.join(lists, ["plane", "bytes"], "left_semi").join(masks, "plane")
    dense = dense.select("fp", "plane", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("shared"))
    dense = _met(dense, ["plane", "mask", "shared"], chosen, max_bits)
    return short.unionByName(dense.distinct())  # a pair may meet in several finer lists


def _classed(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int) -> DataFrame:
    """``doc_id``, ``text_key`` (a hash of the text), ``fp``, ``component`` (smallest fingerprint of the class) and ``component_id``."""
    text = F.col(f"`{text_col}`")
    prints = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("text_key"), fingerprint_column(text, shingle).alias("fp"))
    prints = materialize(prints, "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    joined = components(fingerprint_links(distinct, max_bits))
    classes = distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = materialize(classes.select("fp", "component").join(ids, "component"), "classes")
    return prints.join(classes, "fp")


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` (smallest id of its class) per row."""
    rows = _classed(docs, id_col, text_col, shingle, max_bits)
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """``docs`` with one row of each class: the smallest id's (nulls last; ties by a hash of the text; of equal rows any one)."""
    rows = _classed(docs, id_col, text_col, shingle, max_bits)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
    kept = rows.groupBy("component").agg(first.alias("k")).select("k.doc_id", "k.text_key")
    df = boxed(docs).withColumn("id_", F.col(f"row_in.`{id_col}`")).withColumn("key_", F.xxhash64(F.col(f"row_in.`{text_col}`")))
    df = df.join(kept, F.col("id_").eqNullSafe(F.col("doc_id")) & (F.col("key_") == F.col("text_key")), "left_semi")
    return unboxed(df.dropDuplicates(["id_", "key_"]), [])
