"""Suffix-array dedup on bytes by column-wise multi-document construction.

Texts are cut into pieces of consecutive 100-byte windows with one minimiser (see
``superkmers``), equal pieces are collapsed, and the different pieces of a minimiser meet in a
bucket. There the collection of packed strings is indexed column by column from the right:
each round puts one more symbol in front of every string, and the order of all suffixes, the
Burrows-Wheeler transform (their preceding symbols in this order) and their common prefixes
are updated from the last round's by one sequential pass (a stable sort of the transform).

All windows of a piece hold its minimiser at one place, so strings are set with their
minimisers in one column, and equal windows then begin in one column: a round needs the
suffixes that begin in its column only (the positional form of the transform), and its work is
the number of strings, not of all their suffixes. A string has fewer than 180 bytes and a
chunk is bounded, so the sequential files of the method are arrays here, and Spark's shuffle
files are the external ones. Neighbours with a common prefix of 100 bytes or more hold the
same window; all but its earliest place are removed.

Defined results: a null text is empty; a text shorter than 100 bytes loses nothing; windows
never cross texts; bytes are judged on the input; rows with the same id are ordered by a hash
of their text, and equal rows are one document (both get the same result); null ids come
first; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import SPACE_CLASS, boxed, unboxed
from riskloom.llm.superkmers import Bytes, document_keys, keep_mask, minimiser_places, repeated_spans, span_arrays

def shared_windows(strings, starts_at, window: int):
    """Groups of equal windows that begin in one column: arrays (group, string, window of the string).

    ``starts_at`` is the column of each string's first symbol. Round by round, from the last
    column to the first: ``order`` has the strings with a symbol in the column, sorted by what
    follows from there, and ``common`` the prefix that each shares with the one before.
    """
    import numpy as np

    flat = np.frombuffer(b"".join(strings), "u1")
    lengths = np.array([len(s) for s in strings], "i8")
    begin = np.cumsum(lengths) - lengths
    column = np.asarray(starts_at, "i8")
    last = column + lengths - 1
    entering = np.argsort(last, kind="stable")[::-1]
    at_last, entered = last[entering], 0
    order, common = np.zeros(0, "i8"), np.zeros(0, "i2")
    out = [(np.zeros(0, "i8"),) * 3]
    groups = 0
    for c in range(int(last.max()), int(column.min()) - 1, -1):
        stays = column[order] <= c
        if not stays.all():  # strings that began in the column before leave; their neighbours share the least between them
            kept = np.flatnonzero(stays)
            if len(kept):
                common = np.minimum.reduceat(common[:kept[-1] + 1], np.concatenate(([0], kept[:-1] + 1)))
            order, common = order[kept], common[:len(kept)]
        new = entering[entered:entered + int(np.count_nonzero(at_last[entered:] == c))]
        entered += len(new)
        if len(new):  # nothing follows their symbol: they sort first
            order = np.concatenate((new, order))
            common = np.concatenate((np.zeros(len(new), "i2"), common))
            if len(common) > len(new):
                common[len(new)] = 0
        if not len(order):
            continue
        transform = flat[begin[order] + (c - column[order])]
        sort = np.argsort(transform, kind="stable")
        transform = transform[sort]
        same = np.flatnonzero(transform[1:] == transform[:-1])
        longer = np.zeros(len(sort), "i2")
        if len(same):
            longer[same + 1] = _least_between(common, sort[same], sort[same + 1]) + 1
        order, common = order[sort], longer
        follows = common >= window
        if follows.any():
            shared = follows | np.append(follows[1:], False)
            group = np.cumsum(~follows)[shared] + groups
            groups = int(group[-1]) + 1
            out.append((group, order[shared], c - column[order[shared]]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _least_between(values, left, right):
    """Least of values[left + 1 .. right] for each pair, by tables of doubled widths."""
    import numpy as np

    level = np.log2(right - left).astype("i8")  # exact for these small widths
    out, table = np.empty(len(left), values.dtype), values
    for k in range(int(level.max()) + 1):
        if k:
            table = np.minimum(table[:-(1 << (k - 1))], table[1 << (k - 1):])
        here = np.flatnonzero(level == k)
        if len(here):
            out[here] = np.minimum(table[left[here] + 1], table[right[here] - (1 << k) + 1])
    return out


def repeated_windows(keys, places, strings):
    """(string, window) of each 100-byte window whose earliest place is another."""
    import numpy as np

    column = -minimiser_places(strings, Bytes.window, Bytes.k)
    group, owner, inside = shared_windows(strings, column, Bytes.window)
    key, place = np.asarray(keys, "i8")[owner], np.asarray(places, "i8")[owner] + inside
    order = np.lexsort((place, key, group))
    owner, inside, group, key, place = (x[order] for x in (owner, inside, group, key, place))
    head = np.searchsorted(group, group)
    late = (key != key[head]) | (place != place[head])  # a repeated row has the earliest place more than once
    return owner[late], inside[late]


def _spans(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    keyed = document_keys(docs, id_col, text_col)
    return keyed, repeated_spans(keyed.selectExpr("key", f"`{text_col}` AS text"), Bytes, repeated_windows, same_document=True)


def removed_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document ``doc_id``, ``n_bytes``, ``removed`` (maximal runs as ``start`` and ``length``) and ``kept`` (the other bytes)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    docs = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    keyed, spans = _spans(docs, "doc_id", "text")

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        runs_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        for batch in batches:
            out = []
            for key, text, found in zip(batch.column("doc_id").to_pylist(), batch.column("text"), span_arrays(batch.column("spans")), strict=True):
                raw, runs = text.as_buffer().to_pybytes() if text.is_valid else b"", []
                kept = raw
                if found:
                    keep = keep_mask(len(raw), found, Bytes.window)
                    kept = np.frombuffer(raw, "u1")[keep].tobytes()
                    edge = np.flatnonzero(np.diff(np.concatenate(([True], keep, [True])).astype("i1")))
                    runs = [{"start": a, "length": b - a} for a, b in edge.reshape(-1, 2).tolist()]
                out.append((key, len(raw), runs, kept))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field("doc_id").type), pa.array(columns[1], pa.int64()),
                                              pa.array(columns[2], runs_type), pa.array(columns[3], pa.binary())],
                                             ["doc_id", "n_bytes", "removed", "kept"])

    joined = keyed.select("key", "doc_id", "text").join(spans, "key", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(cut, f"doc_id {id_type}, n_bytes long, removed array<struct<start:bigint,length:bigint>>, kept binary")


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages taken out of the text column; a character goes only if all
    its bytes do. Other columns stay; a text that had words and has none left is dropped."""
    keyed, spans = _spans(boxed(docs).selectExpr("row_in", f"row_in.`{id_col}` AS id_", f"row_in.`{text_col}` AS text_"), "id_", "text_")

    @F.pandas_udf("string")
    def cut(texts, at, n):
        import numpy as np
        import pandas as pd

        out = []
        for text, *spans in zip(texts, at, n, strict=True):
            if text is None or spans[0] is None:
                out.append(text)
                continue
            raw = np.frombuffer(text.encode(), "u1")
            keep = keep_mask(len(raw), [np.asarray(x, "i8") for x in spans], Bytes.window)
            begins = np.flatnonzero((raw & 0xC0) != 0x80)
            keep = np.repeat(np.logical_or.reduceat(keep, begins), np.diff(np.append(begins, len(raw))))
            out.append(raw[keep].tobytes().decode())
        return pd.Series(out, dtype=object)

    cut = cut.asNondeterministic()  # or the filter below would run it a second time, beside the first in another worker
    df = keyed.join(spans, "key", "left").withColumn("cut_", F.when(F.col("spans").isNull(), F.col("text_")).otherwise(cut("text_", "spans.at", "spans.n")))
    word = f"[^{SPACE_CLASS}]"
    df = df.where(F.col("cut_").rlike(word) | ~F.coalesce(F.col("text_").rlike(word), F.lit(False)))
    df = df.withColumn("row_in", F.col("row_in").withField(text_col, F.col("cut_")))
    return unboxed(df, [])
