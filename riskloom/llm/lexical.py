"""Ranked lexical search by pipelined term partitioning.

The items of a round are known before any document is read, so only their terms are indexed.

1. Documents are dealt into blocks as they are read and every block is inverted: postings
   (term, document, occurrences) beside the documents' lengths.
2. Document frequencies give each term its weight and its owner. Owners follow one another in
   a pipeline from the rarest terms to the most frequent ones; an owner's postings stay spread
   over the blocks, so the list of a term in every document is nowhere whole.
3. A bundle is an item with its sparse accumulators (document, score so far) in one block. A
   stage cogroups the bundles with its owner's postings, adds the integer contributions and
   sends the bundles on.
4. A last cogroup with the blocks' document ids gives each block's best, and one window with a
   group limit the best of all.

What a bundle carries is cut exactly: the k-th best score that any documents have so far is a
floor for the final k-th best, and a document whose score plus all that the later owners can
still add (from the highest contribution of each of their terms) is below the floor cannot
come back. Documents that reach the floor are kept, so ties are decided by id at the end.

Items are read in rounds of at most ``ROUND_TERMS`` different terms or items (an item with
more is a round of its own); a round's terms and weights travel with the tasks, and every round
searches all documents.

Defined results: null and blank texts have no terms; an item without terms, or whose terms no
document holds, has no rows; every row is a document of its own, so repeated rows and ids take
a rank each; a null document id comes after all others among equal scores; repeated or null
item ids keep their rows; other columns are not read; without documents there are no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import stored
from riskloom.session import materialize, work_path

ROUND_TERMS = 100_000
ROUND_ITEMS = 1_000
BLOCK_DOCS = 2_048
BLOCK_BYTES = 16 << 20
#: A term belongs to as many owners down the pipeline as it passes shares of the documents: one in 256, 32, 4.
SHARES = (256, 32, 4)

BUNDLE = "block long, item int, at binary, score binary, best array<long>"


def splitter():
    """Function from UTF-8 bytes to terms: runs of ASCII letters, digits and all beyond ASCII, A-Z lower-cased."""
    table = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
    return lambda raw: raw.translate(table).split()


def item_rounds(items: DataFrame, item_id: str, text: str):
    """Lists of (item id, different terms), a round at a time; the driver holds one round."""
    terms, held, known = splitter(), [], set()
    for row in items.select(F.col(f"`{item_id}`"), F.col(f"`{text}`")).toLocalIterator():
        own = set(terms((row[1] or "").encode()))
        if held and (len(held) >= ROUND_ITEMS or len(known | own) > ROUND_TERMS):
            yield held
            held, known = [], set()
        held.append((row[0], own))
        known |= own
    if held:
        yield held


def invert(docs: DataFrame, doc_id: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """One row per block: its ids and lengths, and postings sorted by term and document."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def blocks(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        terms, get = splitter(), vocabulary.get
        block = TaskContext.get().partitionId() << 32

        def close():
            lengths = np.array([n for n, _ in held], "i4")
            found = np.array([len(x) for _, x in held], "i8")
            numbers = np.fromiter((t for _, x in held for t in x), "i8", int(found.sum()))
            pairs, tf = np.unique(numbers * len(held) + np.repeat(np.arange(len(held)), found), return_counts=True)
            own = (pairs // len(held)).astype("i4")
            term, start = np.unique(own, return_index=True)
            return pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.array([ids], pa.list_(id_type)), *[pa.array([x.tobytes()], pa.binary()) for x in (
                    lengths, term, start.astype("i4"), (pairs % len(held)).astype("i4"), tf.astype("i4"))],
                 pa.array([int(np.count_nonzero(lengths))]), pa.array([int(lengths.sum(dtype="i8"))])],
                ["block", "ids", "lengths", "term", "start", "at", "tf", "n_docs", "n_terms"])

        held, ids, size = [], [], 0
        for batch in batches:
            id_type = batch.column(0).type
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words = terms(raw or b"")
                held.append((len(words), [t for w in words if (t := get(w)) is not None]))
                ids.append(key)
                size += len(raw or b"")
                if len(held) >= BLOCK_DOCS or size >= BLOCK_BYTES:
                    yield close()
                    held, ids, size, block = [], [], 0, block + 1
        if held:
            yield close()

    return docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`").cast("string")).mapInArrow(
        blocks, f"block long, ids array<{kind}>, lengths binary, term binary, start binary, at binary, tf binary, n_docs long, n_terms long")


def _per_term(blocks: DataFrame, value, gather, size: int) -> dict[int, int]:
    """``gather`` (F.sum or F.max) of ``value(row)``, an array beside ``row["term"]``, over all blocks. A task
    keeps one number per term of the round, so its rows do not grow with its blocks."""
    add = gather is F.sum

    def partial(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros(size, "i8")
        for batch in batches:
            for row in batch.to_pylist():
                term, x = np.frombuffer(row["term"], "i4"), value(row)
                total[term] = total[term] + x if add else np.maximum(total[term], x)
        term = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(term.astype("i4")), pa.array(total[term])], ["term", "x"])

    rows = blocks.mapInArrow(partial, "term int, x long").groupBy("term").agg(gather("x").alias("x")).collect()
    return {r["term"]: r["x"] for r in rows}  # at most one per term of the round


def _frequency(row):
    import numpy as np

    return np.diff(np.frombuffer(row["start"], "i4"), append=len(row["at"]) // 4)


def _highest(row):
    import numpy as np

    ratio, start = np.frombuffer(row["ratio"], "i4"), np.frombuffer(row["start"], "i4")
    return np.maximum.reduceat(ratio, start) if len(start) else ratio


def deal(blocks: DataFrame, owner_of, n_docs: int, n_terms: int, owners: int) -> str:
    """Postings by owner, with the part of a contribution that the term's weight multiplies; returns the folder."""
    def dealt(batches):
        import numpy as np
        import pyarrow as pa

        owner = np.array(owner_of, "i4")
        for batch in batches:
            for row in batch.to_pylist():
                term, at, tf = (np.frombuffer(row[c], "i4") for c in ("term", "at", "tf"))
                count = _frequency(row)
                m = 10 + (90 * np.frombuffer(row["lengths"], "i4").astype("i8") * n_docs) // n_terms
                ratio = ((1_000_000_000 * tf.astype("i8")) // (1000 * tf.astype("i8") + 8 * m[at])).astype("i4")
                of = np.repeat(owner[term], count)
                for o in range(owners):
                    mine, some = owner[term] == o, of == o
                    if mine.any():
                        start = np.cumsum(count[mine]) - count[mine]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([row["block"]]), pa.array([len(m)], pa.int32()), *[pa.array([x.astype("i4").tobytes()], pa.binary()) for x in (
                                term[mine], start, at[some], ratio[some])], pa.array([o], pa.int32())],
                            ["block", "docs", "term", "start", "at", "ratio", "owner"])

    path = work_path(blocks.sparkSession, "postings")
    (blocks.select("block", "lengths", "term", "start", "at", "tf")
     .mapInArrow(dealt, "block long, docs int, term binary, start binary, at binary, ratio binary, owner int")
     .write.partitionBy("owner").parquet(path))
    return path


def run_stage(bundles: DataFrame, postings: DataFrame, terms_of: dict[int, list[int]], weight: list[int], floor: list[int],
              rest: list[int], k: int) -> DataFrame:
    """The bundles after one owner. ``terms_of``: the owner's terms of each item; ``floor``: a score that the
    item's k-th best reaches; ``rest``: what all later owners can add at most."""
    def stage(left, right):
        import numpy as np
        import pyarrow as pa

        came = {r["item"]: (np.frombuffer(r["at"], "i4"), np.frombuffer(r["score"], "i8")) for r in left.to_pylist()}
        owned, docs, block = {}, 0, None
        for r in right.to_pylist():
            term, start, at, ratio = (np.frombuffer(r[c], "i4") for c in ("term", "start", "at", "ratio"))
            end, docs, block = np.append(start[1:], len(at)), r["docs"], r["block"]
            owned |= {int(t): (at[a:b], ratio[a:b]) for t, a, b in zip(term, start, end, strict=True)}
        if block is None:
            block = left.column("block")[0].as_py()
        rows = []
        for item in sorted(came.keys() | (terms_of.keys() if owned else ())):
            mine = [t for t in terms_of.get(item, ()) if t in owned]
            if not mine and item not in came:
                continue
            if mine:
                total = np.zeros(docs, "i8")
                if item in came:
                    total[came[item][0]] = came[item][1]
                for t in mine:
                    at, ratio = owned[t]
                    total[at] += weight[t] * ratio.astype("i8")
                at = np.flatnonzero(total)
                score = total[at]
            else:
                at, score = came[item]
            best = np.sort(score)[-k:] if len(score) <= k else np.sort(np.partition(score, -k)[-k:])
            least = max(floor[item], int(best[0]) if len(best) == k else 0)
            on = score + rest[item] >= least
            rows.append((block, item, at[on].astype("i4").tobytes(), score[on].tobytes(), best.tolist()))
        return pa.Table.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, types, strict=True)],
            ["block", "item", "at", "score", "best"])

    import pyarrow as pa

    types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    return bundles.groupBy("block").cogroup(postings.groupBy("block")).applyInArrow(stage, BUNDLE)


def _floors(bundles: DataFrame, items: int, k: int) -> list[int]:
    """The k-th best score so far of every item, 0 for items with fewer documents."""
    best = Window.partitionBy("item").orderBy(F.col("s").desc())
    top = bundles.select("item", F.explode("best").alias("s")).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)
    rows = top.groupBy("item").agg(F.min("s").alias("s"), F.count("*").alias("n")).where(F.col("n") == k).collect()
    out = [0] * items
    for r in rows:  # at most one per item of the round
        out[r["item"]] = r["s"]
    return out


def _final(bundles: DataFrame, blocks: DataFrame, kind: str, k: int) -> DataFrame:
    """Each block's k best documents of every item: (item, doc, score)."""
    def pick(left, right):
        import numpy as np
        import pyarrow as pa

        ids_column = right.column("ids").combine_chunks() if right.num_rows else None
        out = [], [], []
        for r in left.to_pylist():
            at, score = np.frombuffer(r["at"], "i4"), np.frombuffer(r["score"], "i8")
            if len(at):
                ids = ids_column.values
                some = np.flatnonzero(score >= (np.partition(score, -k)[-k] if len(score) > k else 1))
                named = [(-int(score[i]), (x := ids[int(at[i])].as_py()) is None, x) for i in some]
                for s, _, x in sorted(named, key=lambda n: n if not n[1] else n[:2])[:k]:
                    for column, v in zip(out, (r["item"], x, -s), strict=True):
                        column.append(v)
        kind = right.column("ids").type.value_type
        return pa.Table.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], kind), pa.array(out[2], pa.int64())], ["item", "doc", "score"])

    picked = bundles.groupBy("block").cogroup(blocks.select("block", "ids").groupBy("block")).applyInArrow(pick, f"item int, doc {kind}, score long")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    return picked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search(docs: DataFrame, held: list, doc_id: str, text: str, k: int, item_type, item_name: str) -> DataFrame | None:
    spark = docs.sparkSession
    terms = sorted(set().union(*(own for _, own in held)))
    vocabulary = {t: i for i, t in enumerate(terms)}
    blocks = stored(invert(docs, doc_id, text, vocabulary), "blocks")
    n_docs, n_terms = blocks.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    if not n_docs:
        return None
    df = _per_term(blocks.select("term", "start", "at"), _frequency, F.sum, len(terms))
    df = [df.get(t, 0) for t in range(len(terms))]
    weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df]
    owner = [sum(d * share > n_docs for share in SHARES) for d in df]
    owners = len(SHARES) + 1
    path = deal(blocks, owner, n_docs, n_terms, owners)
    postings = spark.read.schema("block long, docs int, term binary, start binary, at binary, ratio binary, owner int").parquet(path)
    highest = _per_term(postings.select("term", "start", "ratio"), _highest, F.max, len(terms))
    numbered = [[vocabulary[t] for t in sorted(own) if df[vocabulary[t]] and weight[vocabulary[t]]] for _, own in held]
    floor, bundles = [0] * len(held), spark.createDataFrame([], BUNDLE)
    for o in range(owners):
        terms_of = {i: mine for i, own in enumerate(numbered) if (mine := [t for t in own if owner[t] == o])}
        if not terms_of:
            continue
        rest = [sum(weight[t] * highest.get(t, 0) for t in own if owner[t] > o) for own in numbered]
        bundles = run_stage(bundles, postings.where(F.col("owner") == o).drop("owner"), terms_of, weight, floor, rest, k)
        bundles = materialize(bundles, "bundles")
        floor = [max(x) for x in zip(floor, _floors(bundles, len(held), k), strict=True)]
    best = _final(bundles, blocks, docs.schema[doc_id].dataType.simpleString(), k)
    names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(held)], f"item int, `{item_name}` {item_type}")
    return materialize(best.join(F.broadcast(names), "item")  # one row per item of the round
                       .select(F.col(f"`{item_name}`"), "rank", F.col("doc").alias(doc_id), "score"), "ranked")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text",
                   item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The ``k`` best documents of every item: item id, ``rank`` from 1, document id, ``score``."""
    spark = docs.sparkSession
    item_type = items.schema[item_id].dataType.simpleString()
    out = None
    for held in item_rounds(items, item_id, item_text):
        found = _search(docs, held, doc_id, text, k, item_type, item_id)
        if found is not None:
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], f"`{item_id}` {item_type}, rank int, `{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, score long")
    return out
