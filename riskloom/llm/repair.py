"""Conversation structure repair as a shortest path, found by auctions.

A conversation should have the roles ``(s?(ua)+)?``: maybe a system turn, then user and
assistant in turn. Its rows, in order, and the four places in that pattern (nothing yet, after
s, after u, after a) span a lattice; arcs are the edits Keep, Rerole, Delete and Insert with
integer costs. An auction keeps a price for every node, never above an arc's cost plus the
price at its end, and a path from the origin: the path is extended along an arc that is tight
(equal to that sum); where none is, the price of the path's end rises to the least sum and
the path contracts by one node. When the path reaches the far end the origin's price is the
least cost. Every arc of every cheapest path is then tight, so the tight arcs that lead to the
end, followed in the order of the edits' initials, give the first of the cheapest edit lists.

Conversations of any length: rows are numbered by a range partitioning, and a long one is cut
into blocks of ``BLOCK`` rows. Auctions price each block's crossing from each place to each
other; these 4 x 4 tables are put together from the last block to the first, which fixes the
prices at every block's end; then each block is traced by itself from all places it may be
entered in, and the traces are linked. Inside a block the same is done in strips of ``STRIP``
rows. No task holds a conversation's texts; only 16 numbers per block of one conversation, and
its edits' initials in the report, meet in one row.

A row's first fault counts: blank, duplicate (role and text seen earlier in the conversation)
or truncated (its last character that is not white space is none of ``.!?``). Blank and
duplicate rows must be deleted; a truncated row that stays costs 1 more.

Defined results: rows are ordered by turn, nulls first, then role, then a digest of the text;
a null role or text is one space; rows with a null conversation id are one conversation; other
columns are not read; an empty table has no conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import SPACES
from riskloom.operators.ranks import running_sums
from riskloom.session import materialize

BLOCK = 1024
STRIP = 16
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Places: 0 nothing yet, 1 after s, 2 after u, 3 after a. Where the next user or assistant turn leads:
NEXT = (2, 2, 3, 2)
#: Initials are 1 s, 2 u, 3 a, 0 any other. Where a kept turn leads, by (place, initial):
KEPT = {(0, 1): 1, (0, 2): 2, (1, 2): 2, (2, 3): 3, (3, 2): 2}
LEGAL = {(1, 2), (2, 3), (3, 2)}
UNREACHED = 1 << 40
EDITS = "array<struct<op:string,pos:long,role:string>>"


# ------------------------------------------------------------------ one strip

def lattice(codes, final: bool):
    """Arcs (initial, cost, end) of every node in order of their initials, the ends being the last places
    or, if ``final``, one sink. Node ``4 * row + place``. A code is initial + 4 if to be deleted + 8 if truncated."""
    arcs, n = [], len(codes)
    for i, code in enumerate(codes):
        initial, gone, cut = code & 3, code & 4, TRUNCATED * (code >> 3 & 1)
        for place in range(4):
            down = 4 * (i + 1)
            out = [("D", DELETE, down + place), ("I", INSERT, 4 * i + NEXT[place])]
            if not gone:
                if (place, initial) in KEPT:
                    out.append(("K", KEEP + cut, down + KEPT[place, initial]))
                out.append(("R", REROLE + cut, down + NEXT[place]))
            arcs.append(out)
    if final:
        for place in range(4):
            stop = [("", 0, 4 * n + 4)] if place in (0, 3) else []
            arcs.append([*stop, ("I", INSERT, 4 * n + NEXT[place])])
    return arcs


def leading(arcs, ends, tight=None):
    """Nodes from which a path (of tight arcs, if prices are given) leads to one of ``ends``."""
    back = {}
    for i, out in enumerate(arcs):
        for _, cost, j in out:
            if tight is None or tight[i] == cost + tight[j]:
                back.setdefault(j, []).append(i)
    found, todo = set(ends), list(ends)
    while todo:
        for i in back.get(todo.pop(), ()):
            if i not in found:
                found.add(i)
                todo.append(i)
    return found


def auction(arcs, price, ends, origin):
    """Raises ``price`` until the origin's is its least cost to one of ``ends``, whose prices are fixed."""
    path = [origin]
    while (i := path[-1]) not in ends:
        least, j = min([(cost + price[j], j) for _, cost, j in arcs[i]])
        if price[i] < least:
            price[i] = least
            if len(path) > 1:
                path.pop()
        else:
            path.append(j)
    return price[origin]


def priced(codes, exits):
    """Lattice of a strip, its ends, and prices exact at each place of its start; ``exits``: prices of the
    places at its end, or None if the conversation ends there."""
    arcs = lattice(codes, exits is None)
    ends = {4 * len(codes) + 4: 0} if exits is None else {4 * len(codes) + p: x for p, x in enumerate(exits) if x < UNREACHED}
    low = min(ends.values())
    reach = leading(arcs, ends)
    arcs = [[a for a in out if a[2] in reach] if i in reach else [] for i, out in enumerate(arcs)]
    price = [0] * (4 * len(codes) + 5)
    for j, x in ends.items():
        price[j] = x - low
    costs = [auction(arcs, price, ends, p) + low if p in reach else UNREACHED for p in range(4)]
    return arcs, ends, price, costs


def trace(arcs, ends, price, origin):
    """Initials of the first cheapest path from ``origin``, the nodes it goes through, and its end."""
    good = leading(arcs, ends, price)
    ops, nodes, i = [], [], origin
    while i not in ends:
        op, _, i = next(a for a in arcs[i] if price[i] == a[1] + price[a[2]] and a[2] in good)
        ops.append(op)
        nodes.append(i)
    return "".join(ops), nodes, i


class Strips:
    """Solved strips, kept while a task lasts: few patterns of roles and faults make up most of them."""

    def __init__(self):
        self.solved, self.crossed = {}, {}

    def entry(self, codes, exits):
        """Costs from each place, and from each place the edits as (initial, row or None, place after) and the last place."""
        low = 0 if exits is None else min(exits)
        key = codes, None if exits is None else tuple(x - low for x in exits)
        if key not in self.solved:
            if len(self.solved) > 50_000:
                self.solved.clear()
            arcs, ends, price, costs = priced(codes, key[1])
            traces = []
            for p in range(4):
                ops, nodes, end = trace(arcs, ends, price, p)
                row, edits = 0, []
                for op, node in zip(ops, nodes, strict=False):
                    edits.append((op, None if op == "I" else row, node % 4))
                    row += op != "I"
                traces.append((edits, end % 4))
            self.solved[key] = costs, traces
        costs, traces = self.solved[key]
        return [c + low for c in costs], traces

    def crossing(self, codes):
        """Least cost from each place at a strip's start to each place at its end."""
        if codes not in self.crossed:
            if len(self.crossed) > 50_000:
                self.crossed.clear()
            columns = [priced(codes, [0 if q == p else UNREACHED for q in range(4)])[3] for p in range(4)]
            self.crossed[codes] = [[columns[q][p] for q in range(4)] for p in range(4)]
        return self.crossed[codes]


def joined(left, right):
    return [[min(UNREACHED, min(left[p][m] + right[m][q] for m in range(4))) for q in range(4)] for p in range(4)]


def strips_of(codes):
    return [tuple(codes[a:a + STRIP]) for a in range(0, len(codes), STRIP)]


def block_crossing(codes, strips: Strips):
    out = None
    for strip in strips_of(codes):
        one = strips.crossing(strip)
        out = one if out is None else joined(out, one)
    return out


def block_traces(codes, exits, strips: Strips, entries):
    """Of each place in ``entries``: cost from there, edits (initial, row, role) and the last place."""
    cut = strips_of(codes)
    solved = []
    for strip in reversed(cut):
        exits, traces = strips.entry(strip, exits)
        solved.append(traces)
    out = []
    for place in entries:
        edits, at = [], place
        for k, traces in enumerate(reversed(solved)):
            part, at = traces[at]
            edits += [(op, None if row is None else k * STRIP + row, None if op in "DK" else "user" if to == 2 else "assistant")
                      for op, row, to in part if op]
        out.append((exits[place], edits, at))
    return out


# ------------------------------------------------------------------ all conversations

def conversation_key(conv: Column) -> Column:
    """A conversation id as a text that also tells a null one."""
    return F.when(conv.isNull(), "null").otherwise(F.concat(F.lit("="), conv.cast("string")))


def conversation_rows(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    c = F.col(f"`{conv}`")
    return turns.select(
        conversation_key(c).alias("key"), c.alias("conv"),
        F.col(f"`{turn}`").cast("long").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit(" ")).alias("text"))


def _digest():
    return F.sha2("text", 256)


def numbered_rows(rows: DataFrame) -> DataFrame:
    """Rows without their texts: ``pos`` in the conversation, digest, faults and code; stored."""
    bare = F.btrim("text", F.lit(SPACES))
    last = F.substring(bare, -1, 1)
    small = rows.select(
        "key", F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), "role", _digest().alias("digest"),
        (F.length(bare) == 0).alias("blank"), (~last.isin(".", "!", "?")).alias("cut"), F.lit(1).cast("long").alias("one"))
    small = running_sums(small, ["key"], ["known", "turn", "role", "digest"], {"pos": "one"}).drop("pos_all", "one")
    small = materialize(small.withColumn("pos", F.col("pos") - 1), "turn-places")
    first = small.groupBy("key", "role", "digest").agg(F.min("pos").alias("first"))
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
    fault = F.when(F.col("blank"), "blank").when(F.col("pos") > F.col("first"), "duplicate").when(F.col("cut"), "truncated")
    out = small.join(first, ["key", "role", "digest"]).withColumn("fault", fault)
    return materialize(out.select(
        "key", "pos", F.when(F.col("known"), F.col("turn")).alias("turn"), "role", "digest", "fault",
        (code + F.when(F.col("fault").isin("blank", "duplicate"), 4).when(F.col("fault") == "truncated", 8).otherwise(0)).alias("code")), "turns-numbered")


def _crossings(blocks: DataFrame) -> DataFrame:
    def cross(batches):
        import pyarrow as pa

        strips = Strips()
        for batch in batches:
            tables = [sum(block_crossing(c, strips), []) for c in batch.column("codes").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("block"), pa.array(tables, pa.list_(pa.int64()))], ["key", "block", "costs"])

    return blocks.select("key", "block", "codes").mapInArrow(cross, "key string, block long, costs array<long>")


def _exit_prices(crossings: DataFrame) -> DataFrame:
    """Of every block of a conversation but the last: prices of the places at its end."""
    def back(batches):
        import pyarrow as pa

        for batch in batches:
            out = [], [], []
            for key, tables in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                price = [0, 4, 2, 0]  # at the conversation's end: what is missing is inserted
                for t in reversed(tables):
                    costs = t["costs"]
                    for column, v in zip(out, (key, t["block"], price), strict=True):
                        column.append(v)
                    price = [min(costs[4 * p + q] + price[q] for q in range(4)) for p in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int64()))], ["key", "block", "exits"])

    one = crossings.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("block", "costs"))).alias("tables"))
    return one.mapInArrow(back, "key string, block long, exits array<long>").where("exits IS NOT NULL")


def _traces(blocks: DataFrame) -> DataFrame:
    """Per block its edits from each place it may be entered in (the first: place 0 only), and its illegal pairs."""
    def solve(batches):
        import pyarrow as pa

        strips = Strips()
        kind = pa.list_(pa.struct([("cost", pa.int64()), ("end", pa.int32()), ("edits", pa.list_(pa.struct([("op", pa.string()), ("pos", pa.int64()), ("role", pa.string())])))]))
        for batch in batches:
            out, illegal = [], []
            for block, codes, exits in zip(*(batch.column(c).to_pylist() for c in ("block", "codes", "exits")), strict=True):
                traces = block_traces(codes, exits, strips, range(4) if block else [0])
                out.append([{"cost": cost, "end": end, "edits": [{"op": op, "pos": None if row is None else block * BLOCK + row, "role": role} for op, row, role in edits]}
                            for cost, edits, end in traces])
                illegal.append(sum((a & 3, b & 3) not in LEGAL for a, b in zip(codes, codes[1:], strict=False)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("block"), pa.array(out, kind), pa.array(illegal, pa.int64()),
                 *(pa.array([c[i] & 3 for c in batch.column("codes").to_pylist()], pa.int32()) for i in (0, -1))],
                ["key", "block", "traces", "illegal", "first", "last"])

    return blocks.select("key", "block", "codes", "exits").mapInArrow(
        solve, f"key string, block long, traces array<struct<cost:long,end:int,edits:{EDITS}>>, illegal long, first int, last int")


def _entries(traces: DataFrame) -> DataFrame:
    """The place in which each block of a long conversation is entered."""
    def forward(batches):
        import pyarrow as pa

        for batch in batches:
            out = [], [], []
            for key, blocks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                place = 0
                for b in blocks:
                    for column, v in zip(out, (key, b["block"], place), strict=True):
                        column.append(v)
                    place = b["ends"][place]
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32())], ["key", "block", "entry"])

    one = traces.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("block", F.col("traces.end").alias("ends")))).alias("blocks"))
    return one.mapInArrow(forward, "key string, block long, entry int")


def solved_blocks(numbered: DataFrame) -> DataFrame:
    """(key, block, cost, edits, illegal, first, last), stored: the edits of every block, in order."""
    blocks = numbered.groupBy("key", F.expr(f"pos div {BLOCK}").alias("block")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"]).alias("codes"))
    blocks = materialize(blocks, "turn-blocks")
    several = blocks.where("block > 0").select("key").distinct()
    long_ones = blocks.join(several, "key", "left_semi")
    if not blocks.where("block > 0").head(1):  # every conversation is one block
        traces = _traces(blocks.withColumn("exits", F.lit(None).cast("array<long>"))).withColumn("entry", F.lit(0))
    else:
        exits = _exit_prices(_crossings(long_ones))
        last = blocks.groupBy("key").agg(F.max("block").alias("last_block"))
        priced_blocks = (blocks.join(last, "key").join(exits, ["key", "block"], "left")
                         .withColumn("exits", F.when(F.col("block") < F.col("last_block"), F.col("exits"))))
        traces = materialize(_traces(priced_blocks), "turn-traces")
        traces = traces.join(_entries(traces.where("block > 0 OR size(traces) = 1").join(several, "key", "left_semi")), ["key", "block"], "left")
        traces = traces.withColumn("entry", F.coalesce("entry", F.lit(0)))
    took = F.get("traces", F.col("entry"))
    return materialize(traces.select("key", "block", took["cost"].alias("cost"), took["edits"].alias("edits"), "illegal", "first", "last"), "turn-edits")


class Repair:
    """``turns``: the repaired rows (conv, place, edit, op, role, text), ordered by block and edit within a
    conversation. ``report``: one row per conversation with counts of its faults, ``cost`` and ``audit``."""

    def __init__(self, turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"):
        self.conv = conv
        self.rows = conversation_rows(turns, conv, turn, role, text)
        self.numbered = numbered_rows(self.rows)
        self.blocks = solved_blocks(self.numbered)
        self.convs = self.rows.groupBy("key").agg(F.first("conv").alias(conv))

    @property
    def report(self) -> DataFrame:
        faults = self.numbered.groupBy("key").agg(
            F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
            *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
        order = Window.partitionBy("key").orderBy("block")  # one row per block of a conversation
        before = F.lag("last").over(order)
        meet = before.isNotNull() & ~F.struct(before, "first").isin(*[F.struct(F.lit(a), F.lit(b)) for a, b in sorted(LEGAL)])
        ops = F.array_join(F.transform("edits", lambda e: e["op"]), "")
        paths = self.blocks.select("key", "block", "cost", ops.alias("ops"), (F.col("illegal") + meet.cast("long")).alias("illegal"))
        paths = paths.groupBy("key").agg(
            F.sum("illegal").alias("illegal"), F.min_by("cost", "block").alias("cost"),
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "ops"))), lambda x: x["ops"]), "").alias("audit"))
        return self.convs.join(faults, "key").join(paths, "key").select(
            self.conv, "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    def _edits(self) -> DataFrame:
        edits = self.blocks.select("key", "block", F.posexplode("edits").alias("edit", "e"))
        return edits.select("key", "block", "edit", "e.op", "e.pos", F.col("e.role").alias("new_role")).where("op <> 'D'")

    @property
    def turns(self) -> DataFrame:
        """Kept rows are the first with their role and text in a conversation, so these name their text."""
        places = self.numbered.select("key", "pos", "role", "digest")
        edits = self._edits()
        kept = edits.where("op <> 'I'").join(places, ["key", "pos"])
        texts = self.rows.select("key", "role", "text", _digest().alias("digest")).groupBy("key", "role", "digest").agg(F.first("text").alias("text"))
        kept = kept.join(texts, ["key", "role", "digest"]).select("key", "block", "edit", "op", F.coalesce("new_role", "role").alias("role"), "text")
        added = edits.where("op = 'I'").select("key", "block", "edit", "op", F.col("new_role").alias("role"), F.lit("").alias("text"))
        return kept.unionByName(added).join(self.convs, "key").select(self.conv, "key", "block", "edit", "op", "role", "text")
