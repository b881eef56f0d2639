"""Substring dedup on words by super-k-mer partitioning.

Windows of 13 words that share a minimiser travel as one packed string to its bucket (see
``superkmers``); there the windows are written as rows of word numbers and sorted, and equal
neighbours are counted exactly. A word is removed if a window over it also starts in a
document with a smaller id.

Defined results: a null or blank text has no words; a text of fewer than 13 words loses none;
repeats inside one document are no reason to remove; rows with the same id are ordered by a
hash of their text, and equal rows are one document (both get the same result); null ids come
first; other columns are not read; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from riskloom.llm.superkmers import Words, document_keys, keep_mask, repeated_spans, span_arrays


def equal_windows(keys, places, strings):
    """(string, window) of each window that also occurs in a string of a smaller key."""
    import numpy as np

    w = Words.window
    split = [s.split(b" ") for s in strings]
    lengths = np.array([len(x) for x in split], "i8")
    every = [x for words in split for x in words]
    numbers = {x: i for i, x in enumerate(dict.fromkeys(every))}
    ids = np.array([numbers[x] for x in every], "i4")
    n = lengths - w + 1
    owner = np.repeat(np.arange(len(strings)), n)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    rows = np.lib.stride_tricks.sliding_window_view(ids, w)[(np.cumsum(lengths) - lengths)[owner] + inside]
    key = np.asarray(keys, "i8")[owner]
    order = np.lexsort((key, *rows.T))  # by window, then by document
    same = (rows[order][1:] == rows[order][:-1]).all(axis=1)
    group = np.concatenate(([0], np.cumsum(~same)))
    head = np.concatenate(([0], np.flatnonzero(~same) + 1))
    late = key[order] > key[order][head][group]
    return owner[order][late], inside[order][late]


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``docs`` with a ``key``, and per key the ``spans`` of windows that start in an earlier document too."""
    keyed = document_keys(docs, id_col, text_col)
    texts = keyed.selectExpr("key", f"`{text_col}` AS text")
    return keyed, repeated_spans(texts, Words, equal_windows, same_document=False)


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document ``doc_id``, ``n_words``, ``n_removed`` and ``kept`` (the kept words, one space between)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    docs = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    keyed, spans = repeated_words(docs, "doc_id", "text")

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for key, text, found in zip(batch.column("doc_id").to_pylist(), batch.column("text"), span_arrays(batch.column("spans")), strict=True):
                words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
                keep = keep_mask(len(words), found, Words.window)
                kept = b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k]) if found else b" ".join(words)
                out.append((key, len(words), int(len(words) - keep.sum()), kept.decode()))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field("doc_id").type), pa.array(columns[1], pa.int64()),
                                              pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())],
                                             ["doc_id", "n_words", "n_removed", "kept"])

    joined = keyed.select("key", "doc_id", "text").join(spans, "key", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(cut, f"doc_id {id_type}, n_words long, n_removed long, kept string")
