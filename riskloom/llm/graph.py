"""Near duplicates of embeddings by robust-pruned flat graphs on overlapping shards.

1. Equal vectors are collapsed. Centroids are fitted on a sample of at most ``SAMPLE`` vectors
   (by hash order); every vector joins the shards of its ``overlap`` nearest centroids. A
   shard of more than ``UNIT`` vectors is dealt at random into blocks.
2. Each block builds a graph: candidates are a vector's nearest ones and random others, thinned
   by robust pruning (a candidate goes if a kept one is nearer to it by the factor ``ALPHA``),
   with edges in both directions. The adjacency lists of a vector's shards are united.
3. All vectors of a shard are queries to each of its blocks, a block of queries to a block of
   vectors at a time. A greedy beam search starts at
   medoids; once it stands among vectors in range, every vector in range is expanded, too, so
   the result isn't limited by the beam. Only pairs whose cosine in double precision reaches
   the threshold are links. A pair that shares several shards counts in the first.
4. Recall is audited against brute force on ``AUDIT`` vectors (by hash order): the share of all
   their links, and the mean of each vector's own share, which a large group can't outweigh.
   While either is below the target the work is repeated with twice the beam and one more shard
   per vector, and after the last round all pairs are compared, block by block.

No group, sample or broadcast grows with the data. Tasks emit counts and, for the components,
one edge per vector and block, not pairs. Vectors of different lengths are searched apart.

Defined results: a vector that is null, zero or holds null or non-finite components links with
nothing, and none links with one of another length; equal vectors link with each other;
repeated and null ids are separate rows (a component's id is its smallest id that is not null,
null if it has none); other columns are not read; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.components import components
from riskloom.session import materialize

SAMPLE = 20_000
CENTROIDS = 4_096
UNIT = 4_000
SHARD = 2_000
DEGREE, CANDIDATES, BEAM, ALPHA = 24, 64, 48, 1.2
AUDIT = 1_000
#: Rows that are compared with all centroids at once.
ROWS = 1_024


# ---------------------------------------------------------------- numeric helpers, in tasks

def fit_centroids(x, k: int, rounds: int = 8):
    """Spherical k-means on a bounded sample."""
    import numpy as np

    c = x[np.random.default_rng(1).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([np.argmax(x[at:at + ROWS] @ c.T, axis=1) for at in range(0, len(x), ROWS)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), c)
    return c


def robust_prune(x, own, cand, degree: int = DEGREE, alpha: float = ALPHA):
    """Neighbours (-1: none) of the vectors ``own`` among their candidates ``cand`` (rows of numbers, nearest first)."""
    import numpy as np

    out = np.full((len(own), degree), -1, "i8")
    for at in range(0, len(own), 256):
        c = cand[at:at + 256]
        v = x[c]
        far = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("bld,bd->bl", v, x[own[at:at + 256]])))
        alive, rows = c != own[at:at + 256, None], np.arange(len(c))
        for j in range(degree):
            pick = np.where(alive, far, np.inf).argmin(axis=1)
            ok = alive[rows, pick]
            if not ok.any():
                break
            out[at:at + 256, j][ok] = c[rows, pick][ok]
            between = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("bld,bd->bl", v, v[rows, pick])))
            alive &= ~(alpha * between <= far) & ok[:, None]
            alive[rows, pick] = False
    return out


def build_graph(x):
    """Adjacency rows (-1: none) of a flat graph on the unit vectors ``x``."""
    import numpy as np

    n, rng = len(x), np.random.default_rng(2)
    near = min(CANDIDATES, n)
    cand = np.empty((n, near + min(n, CANDIDATES // 2)), "i8")
    for at in range(0, n, 512):
        sims = x[at:at + 512] @ x.T
        cand[at:at + 512, :near] = np.argpartition(-sims, near - 1, axis=1)[:, :near]
    cand[:, near:] = rng.integers(0, n, (n, cand.shape[1] - near))
    out = robust_prune(x, np.arange(n), cand)
    a, b = np.repeat(np.arange(n), out.shape[1]), out.ravel()
    a, b = a[b >= 0], b[b >= 0]
    both = np.unique(np.concatenate((a * n + b, b * n + a)))  # edges in both directions
    return both // n, both % n


def search(x, adjacency, queries, entries, threshold: float, beam: int):
    """(query, found) pairs with cosine at least ``threshold``; ``adjacency`` has padded rows (-1: none)."""
    import numpy as np

    n, hits = len(x), []
    for at in range(0, len(queries), 256):
        q = queries[at:at + 256]
        rows = np.arange(len(q))[:, None]
        seen = np.zeros((len(q), n + 1), bool)  # the last column is for padding
        seen[:, n] = True
        ids = np.tile(entries, (len(q), 1))
        seen[rows, ids] = True
        sims = q @ x[entries].T
        done = np.zeros_like(ids, bool)
        found = [[] for _ in q]
        while True:
            open_ = np.where(done | (ids == n), -2.0, sims)
            pick = np.argpartition(-open_, 3, axis=1)[:, :4] if open_.shape[1] > 4 else np.tile(np.arange(open_.shape[1]), (len(q), 1))
            real = open_[rows, pick] > -2
            if not real.any():
                break
            step = np.where(real, ids[rows, pick], n)
            done[rows, pick] |= real
            new = adjacency[step].reshape(len(q), -1)
            new = np.where(seen[rows, new], n, new)
            new = np.sort(new, axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = n
            seen[rows, new] = True
            r, c = np.nonzero(new < n)
            s = np.full(new.shape, -2.0)
            s[r, c] = np.einsum("ij,ij->i", x[new[r, c]], q[r])
            ids, sims = np.concatenate((ids, new), axis=1), np.concatenate((sims, s), axis=1)
            done = np.concatenate((done, np.zeros_like(new, bool)), axis=1)
            if ids.shape[1] > beam:
                keep = np.argpartition(-sims, beam - 1, axis=1)
                # vectors in range that leave the beam wait for the second phase
                r, c = np.nonzero(sims[rows, keep[:, beam:]] >= threshold)
                for i, v in zip(r.tolist(), ids[rows, keep[:, beam:]][r, c].tolist(), strict=True):
                    found[i].append(v)
                keep = keep[:, :beam]
                ids, sims, done = ids[rows, keep], sims[rows, keep], done[rows, keep]
        for i in range(len(q)):
            got = np.unique(np.concatenate((ids[i][(sims[i] >= threshold) & (ids[i] < n)], np.array(found[i], "i8"))))
            fringe = got
            while len(fringe):  # expand everything in range
                new = np.unique(adjacency[fringe])
                new = new[~seen[i, new]]
                seen[i, new] = True
                fringe = new[x[new] @ q[i] >= threshold]
                got = np.concatenate((got, fringe))
            if len(got):
                hits.append((np.full(len(got), at + i), got))
    if not hits:
        return np.zeros(0, "i8"), np.zeros(0, "i8")
    return np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])


def least_labels(n: int, a, b):
    """Smallest number reachable from each of ``n`` by the pairs ``a``, ``b``."""
    import numpy as np

    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


# ---------------------------------------------------------------- on the cluster

def distinct_vectors(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame, dict[int, int]]:
    """All rows with the ``node`` of their vector (null if it can't link); the nodes (``node``, unit ``vec``,
    ``copies``, ``low``, ``dim``); the number of nodes of each length."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = df.select(F.col(f"`{id_col}`").alias("vec_id"), v.alias("raw"))
    fine = F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    top = F.aggregate("raw", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    rows = rows.withColumn("raw", F.when(F.coalesce(fine & (F.size("raw") > 0), F.lit(False)), F.col("raw")))
    rows = rows.withColumn("top", top).withColumn("raw", F.when(F.col("top") > 0, F.col("raw")))
    scaled = F.transform("raw", lambda x: x / F.col("top"))  # so that squares neither overflow nor vanish
    rows = rows.withColumn("raw", scaled)
    norm = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda a, x: a + x * x))
    nodes = rows.where("raw IS NOT NULL").groupBy("raw").agg(F.count("*").alias("copies"), F.min("vec_id").alias("low"))
    nodes = nodes.withColumn("norm", norm).withColumn("node", F.monotonically_increasing_id())
    nodes = materialize(nodes.select("node", "raw", "copies", "low", F.size("raw").alias("dim"), F.transform("raw", lambda x: x / F.col("norm")).alias("vec")), "vectors")
    rows = rows.join(nodes.select("raw", "node"), "raw", "left").select("vec_id", "node")
    sizes = {r["dim"]: r["count"] for r in nodes.groupBy("dim").count().collect()}  # one row per length
    return materialize(rows, "rows"), nodes.drop("raw"), sizes


def _matrix(column):
    import numpy as np

    return np.array(column.tolist(), "f8") if len(column) else np.zeros((0, 1))


def _search_links(nodes: DataFrame, total: int, threshold: float, overlap: int, beam: int) -> tuple[DataFrame, DataFrame]:
    """(``node``, ``links``) counts of other vectors found, weighted by copies; and edges (``a``, ``b``) that join the components."""
    import numpy as np

    k = min(CENTROIDS, max(1, math.ceil(total / SHARD)))
    sample = nodes.select("vec").orderBy(F.xxhash64("vec"), "node").limit(SAMPLE).toPandas()  # bounded: SAMPLE rows
    sample = _matrix(sample["vec"])
    centroids = fit_centroids(sample, min(k, len(sample)))
    overlap = min(overlap, len(centroids))

    def assign(batches):
        import pandas as pd

        for batch in batches:
            for at in range(0, len(batch), ROWS):
                b = batch.iloc[at:at + ROWS]
                near = np.argpartition(-(_matrix(b["vec"]) @ centroids.T), overlap - 1, axis=1)[:, :overlap]
                yield pd.DataFrame({"node": b["node"], "vec": b["vec"], "copies": b["copies"], "shards": [sorted(r.tolist()) for r in near]})

    placed = materialize(nodes.select("node", "vec", "copies").mapInPandas(assign, "node long, vec array<double>, copies long, shards array<int>"), "placed")
    members = placed.withColumn("shard", F.explode("shards"))
    counts = members.groupBy("shard").count().select("shard", F.ceil(F.col("count") / UNIT).alias("blocks"))  # at most CENTROIDS rows
    members = members.join(F.broadcast(counts), "shard")
    members = members.withColumn("block", F.pmod(F.xxhash64("node", "shard"), F.col("blocks")).cast("int"))

    def build(frame):
        import pandas as pd

        frame = frame.sort_values("node")
        a, b = build_graph(_matrix(frame["vec"]))
        ids = frame["node"].to_numpy()
        return pd.DataFrame({"node": ids[a], "neighbour": ids[b]})

    edges = members.select("shard", "block", "node", "vec").groupBy("shard", "block").applyInPandas(build, "node long, neighbour long")
    united = edges.groupBy("node").agg(F.collect_set("neighbour").alias("neighbours"))  # at most the edges of a vector's few shards
    united = materialize(united, "graph")

    # Every block of vectors meets every block of queries of its shard, in a group of two blocks.
    others = F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")))
    held = members.join(united, "node", "left").select("shard", "block", "node", "vec", "copies", "shards", "neighbours", others.alias("asking"))
    asked = members.select("shard", F.col("block").alias("asking"), "node", "vec", "copies", "shards", others.alias("block"))
    asked = asked.select(*[F.col(c).alias(c) for c in asked.columns])  # columns of its own, to cogroup it with held

    def look(base, query):
        import pandas as pd

        out = {"node": [], "links": [], "a": [], "b": []}
        if len(base) and len(query):
            shard = int(base["shard"].iloc[0])
            base, query = base.sort_values("node"), query.sort_values("node")
            x, q = _matrix(base["vec"]), _matrix(query["vec"])
            ids, asks = base["node"].to_numpy(), query["node"].to_numpy()
            where = {v: i for i, v in enumerate(ids.tolist())}
            lists = [[where[v] for v in (l if l is not None else ()) if v in where] for l in base["neighbours"]]
            width = max(1, *map(len, lists)) if lists else 1
            adjacency = np.full((len(x) + 1, width), len(x), "i8")
            for i, found in enumerate(lists):
                adjacency[i, :len(found)] = found
            # medoids: the vector nearest the mean, of all and of the parts around a few vectors
            pivots = x[np.random.default_rng(3).choice(len(x), min(16, len(x)), replace=False)]
            part = np.argmax(x @ pivots.T, axis=1)
            means = [x.mean(axis=0), *(x[part == i].mean(axis=0) for i in np.unique(part))]
            entries = np.unique([int(np.argmax(x @ m)) for m in means])
            hit, got = search(x, adjacency, q, entries, threshold, beam)
            other = asks[hit] != ids[got]
            hit, got = hit[other], got[other]
            if len(hit):
                mine, theirs = query["shards"].tolist(), base["shards"].tolist()
                first = np.array([min(set(mine[i]) & set(theirs[j])) == shard for i, j in zip(hit.tolist(), got.tolist(), strict=True)])
                links = np.bincount(hit, base["copies"].to_numpy()[got] * first, len(asks)).astype("i8")
                every, inverse = np.unique(np.concatenate((asks, ids)), return_inverse=True)
                label = every[least_labels(len(every), inverse[:len(asks)][hit], inverse[len(asks):][got])]
                keep = np.flatnonzero((links > 0) | (label[inverse[:len(asks)]] != asks))
                tell = label != every
                out = {"node": [*asks[keep], *[-1] * int(tell.sum())], "links": [*links[keep], *[0] * int(tell.sum())],
                       "a": [*[-1] * len(keep), *every[tell]], "b": [*[-1] * len(keep), *label[tell]]}
        return pd.DataFrame(out).astype("int64")

    found = held.groupBy("shard", "block", "asking").cogroup(asked.groupBy("shard", "block", "asking")).applyInPandas(look, "node long, links long, a long, b long")
    found = materialize(found, "found")
    links = found.where("node >= 0").groupBy("node").agg(F.sum("links").alias("links"))
    return links, found.where("a >= 0").select("a", "b")


def _exact_links(nodes: DataFrame, total: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """As ``_search_links``, with all links: each pair of blocks of about ``UNIT`` vectors is compared once."""
    import numpy as np

    blocks = math.ceil(total / UNIT)
    dealt = nodes.select("node", "vec", "copies", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("own"))
    left = dealt.select("node", "vec", "copies", F.col("own").alias("one"), F.explode(F.sequence("own", F.lit(blocks - 1))).alias("two"))
    right = dealt.select("node", "vec", "copies", F.explode(F.sequence(F.lit(0), "own")).alias("one"), F.col("own").alias("two"))

    def compare(base, query):
        import pandas as pd

        x, y = _matrix(base["vec"]), _matrix(query["vec"])
        ids, asks = base["node"].to_numpy(), query["node"].to_numpy()
        every, inverse = np.unique(np.concatenate((ids, asks)), return_inverse=True)
        own, other, label = inverse[:len(ids)], inverse[len(ids):], np.arange(len(every))
        links, twice = np.zeros(len(every), "i8"), len(ids) and len(asks) and base["one"].iloc[0] != base["two"].iloc[0]
        for at in range(0, len(ids) if len(asks) else 0, 256):
            hit = (x[at:at + 256] @ y.T >= threshold) & (ids[at:at + 256, None] != asks)
            links[own[at:at + 256]] += hit @ query["copies"].to_numpy().astype("i8")
            if twice:  # a block with itself has both directions
                links[other] += base["copies"].to_numpy()[at:at + 256].astype("i8") @ hit
            r, c = np.nonzero(hit)
            label = least_labels(len(every), np.concatenate((np.arange(len(every)), own[at + r])), np.concatenate((label, other[c])))
        keep, tell = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(every)))
        return pd.DataFrame({"node": [*every[keep], *[-1] * len(tell)], "links": [*links[keep], *[0] * len(tell)],
                             "a": [*[-1] * len(keep), *every[tell]], "b": [*[-1] * len(keep), *every[label[tell]]]}).astype("int64")

    found = left.groupBy("one", "two").cogroup(right.groupBy("one", "two")).applyInPandas(compare, "node long, links long, a long, b long")
    found = materialize(found, "found")
    links = found.where("node >= 0").groupBy("node").agg(F.sum("links").alias("links"))
    return links, found.where("a >= 0").select("a", "b")


def audit(nodes: DataFrame, links: DataFrame, threshold: float) -> tuple[float, float]:
    """Recall on ``AUDIT`` vectors by brute force over all vectors in blocks: the share of their true
    links that were counted, and the mean of this share over the vectors that have links."""
    import numpy as np

    asked = nodes.select("node", "vec").orderBy(F.xxhash64("node", "vec"), "node").limit(AUDIT).toPandas()  # bounded: AUDIT rows
    q, ids = _matrix(asked["vec"]), asked["node"].to_numpy()

    def count(batches):
        import pandas as pd

        total = np.zeros(len(ids), "i8")
        for b in batches:
            for at in range(0, len(b), 4096):
                part = b.iloc[at:at + 4096]
                hit = (q @ _matrix(part["vec"]).T >= threshold) & (ids[:, None] != part["node"].to_numpy())
                total += hit @ part["copies"].to_numpy().astype("i8")
        yield pd.DataFrame({"node": ids, "true": total})

    true = nodes.select("node", "vec", "copies").mapInPandas(count, "node long, true long").groupBy("node").agg(F.sum("true").alias("true"))
    both = true.where(F.col("true") > 0).join(links, "node", "left").withColumn("found", F.least(F.col("true"), F.coalesce("links", F.lit(0))))
    both = both.agg(F.sum("true").alias("t"), F.sum("found").alias("f"), F.avg(F.col("found") / F.col("true")).alias("each")).first()
    return (both.f / both.t, both.each) if both.t else (1.0, 1.0)


def _audited_links(nodes: DataFrame, total: int, threshold: float, overlap: int, beam: int, recall: float, rounds: int) -> tuple[DataFrame, DataFrame]:
    """Links and edges of the vectors of one length."""
    for _ in range(rounds):
        links, edges = _search_links(nodes, total, threshold, overlap, beam)
        if min(audit(nodes, links, threshold)) >= recall:
            return links, edges
        overlap, beam = overlap + 1, beam * 2
    return _exact_links(nodes, total, threshold)


def embedding_classes(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9,
                      overlap: int = 2, beam: int = BEAM, recall: float = 0.95, rounds: int = 3) -> DataFrame:
    """``vec_id``, ``n_links`` (other vectors linked directly) and ``component_id`` per row. If no
    round's audit reaches ``recall`` in both figures, all pairs are compared."""
    rows, nodes, sizes = distinct_vectors(df, id_col, vector_col)
    if not sizes:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    found = [_audited_links(nodes.where(F.col("dim") == d).drop("dim"), n, threshold, overlap, beam, recall, rounds) for d, n in sorted(sizes.items())]
    links, edges = (reduce(DataFrame.unionByName, parts) for parts in zip(*found, strict=True))
    joined = components(edges)
    classes = nodes.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = classes.groupBy("component").agg(F.min("low").alias("component_id"))
    classes = classes.join(ids, "component").join(links, "node", "left")
    classes = classes.select("node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = rows.join(materialize(classes, "classes"), "node", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
