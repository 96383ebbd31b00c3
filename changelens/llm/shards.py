"""Sharding (11): balanced label propagation, with DataFrame functions only.

Documents that share a group (here: equal texts) are linked.  Shards fill
evenly, and linked documents move to where their neighbours are:

1. Every document starts in a shard by its cell (size class and hash), cells
   dealt largest first to the emptiest shard, so the start is even.
2. A round counts, per group, its members in each shard (pre-aggregated, so
   no pairs of neighbours exist) and joins the counts back: a document's vote for
   a shard is the share of its neighbours there.  It wants the best shard among
   those with room and its own.
3. Quotas bound what moves: between two shards, what flows one way may flow the
   other way too, and what is above that only fills free room.  Small groups go
   first, so only groups larger than a shard's room are cut.
4. A shard that refuses documents for want of room counts as full until
   others leave it; what it refused looks for the next best shard.  Rounds end
   when the shards no longer change (or after ``rounds``).
5. Documents without links, which cost nothing to move, then fill the shards
   to equal size, again by cells.

Linked documents never fill a shard beyond an equal part, so the fill always
comes out even.  What reaches the driver are sums per cell, pair of shards and
shard, whose number does not depend on the rows.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut, partitions

#: Hash buckets per size class; a cell is a bucket of a class.
BUCKETS = 512
#: Hash buckets per class of group size, and of single documents, by which
#: quotas are filled.
STEPS, FINE = 64, 4096
#: Groups with more than 1 / LARGE of a shard may be cut when a shard gives back.
LARGE = 64
#: A shard that refused documents counts as full once less than 1 / NEAR of its
#: part is free, or a quarter of what was.
NEAR = 256
#: Shards may overfill by so much between rounds if no document is free.
SLACK = 0.25


def size_class(size: Column) -> Column:
    """The number of binary digits of a size (at most 63)."""
    return F.length(F.bin(size)).cast("int")


def _deal(cells: list, load: list[int]) -> list[tuple[int, int, int]]:
    """Shard of each cell (class, bucket, weight): the largest first, to the
    emptiest shard."""
    heap = [(x, i) for i, x in enumerate(load)]
    heapq.heapify(heap)
    out = []
    for c, b, w in sorted(cells, key=lambda x: (-x[2], x[0], x[1])):
        now, shard = heapq.heappop(heap)
        out.append((c, b, shard))
        heapq.heappush(heap, (now + w, shard))
    return out


def _by_cells(rows: DataFrame, load: list[int]) -> DataFrame:
    """``rows`` (row, weight, unit) with a ``shard`` that evens out ``load``.
    Rows of a unit share a cell; there are at most 63 x BUCKETS cells."""
    rows = rows.withColumn("c", size_class(F.col("weight"))).withColumn(
        "b", F.pmod(F.xxhash64("unit"), F.lit(BUCKETS)).cast("int"))
    cells = rows.groupBy("c", "b").agg(F.sum("weight").alias("w")).collect()
    places = rows.sparkSession.createDataFrame(_deal([tuple(x) for x in cells], load), "c int, b int, shard int")
    return rows.join(F.broadcast(places), ["c", "b"]).select("row", "weight", "shard")


def _prefix(rows: DataFrame, quotas: DataFrame, by: list[str]) -> DataFrame:
    """Of ``rows`` (``by``, weight, step, fine) those that come first in the
    order of step and fine, as many as a quota holds.  Two histograms decide: one
    of steps, then one inside the step where the quota ends."""
    def running(level, key):
        w = Window.partitionBy(*by).orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return level.withColumn("upto", F.sum("w").over(w))
    steps = running(rows.groupBy(*by, "step").agg(F.sum("weight").alias("w")), "step").join(
        F.broadcast(quotas), by)
    ends = (steps.where(F.col("upto") > F.col("quota")).groupBy(*by)
            .agg(F.min(F.struct("step", (F.col("quota") - F.col("upto") + F.col("w")).alias("left"))).alias("e"))
            .select(*by, F.col("e.step").alias("end"), F.col("e.left").alias("left")))
    ends = cut(ends, "ends")  # one row per pair of shards
    marked = rows.join(F.broadcast(quotas.drop("quota")), by).join(F.broadcast(ends), by, "left")
    inside = marked.where(F.col("step") == F.col("end"))
    fine = running(inside.groupBy(*by, "left", "fine").agg(F.sum("weight").alias("w")), "fine")
    last = (fine.where(F.col("upto") <= F.col("left")).groupBy(*by).agg(F.max("fine").alias("last")))
    out = marked.join(F.broadcast(last), by, "left").where(
        F.col("end").isNull() | (F.col("step") < F.col("end"))
        | ((F.col("step") == F.col("end")) & (F.col("fine") <= F.coalesce("last", F.lit(-1)))))
    return out.drop("end", "left", "last")


def _votes(members: DataFrame, state: DataFrame) -> DataFrame:
    """(row, weight, grp, gsize, own, shard, vote): of each linked document,
    its share of neighbours (itself included) in each shard that has any."""
    placed = members.join(state, "row")
    tally = placed.groupBy("grp", "shard").agg(F.count("*").alias("n"))
    lists = tally.groupBy("grp").agg(F.collect_list(F.struct("shard", "n")).alias("held"))  # a row a shard at most
    rows = placed.withColumnRenamed("shard", "own").join(lists, "grp").select(
        "row", "weight", "grp", "gsize", "own", F.explode("held").alias("h"))
    return rows.groupBy("row", F.col("h.shard").alias("shard")).agg(
        F.first("weight").alias("weight"), F.first("own").alias("own"), F.min("grp").alias("grp"),
        F.max("gsize").alias("gsize"), F.sum(F.col("h.n") / F.col("gsize")).alias("vote"))


def _round(members: DataFrame, state: DataFrame, shards: int, room: list[int], full: set[int]):
    """``state`` after a round, None if nothing can move, and the shards that
    more documents want than they have room for.  None moves to ``full`` ones
    but in exchange."""
    spark = members.sparkSession
    open_to = [i for i, x in enumerate(room) if x > 0 and i not in full]
    votes = _votes(members, state)
    # ties go by group and shard, so a group's members agree
    rank = F.struct("vote", F.xxhash64("grp", "shard").alias("tie"), "shard")
    best = votes.groupBy("row").agg(
        F.max(rank).alias("any"), F.max(F.when(F.col("shard").isin(open_to), rank)).alias("open"),
        F.max(F.when(F.col("shard") == F.col("own"), rank)).alias("stay"),
        F.first("weight").alias("weight"), F.first("own").alias("own"), F.first("grp").alias("grp"),
        F.first("gsize").alias("gsize"))

    def moved(want):
        return best.where(F.col(want) > F.coalesce("stay", F.col(want))).select(
            "row", "weight", "grp", "gsize", "own", F.col(f"{want}.shard").alias("to"))
    wish = cut(moved("any").withColumn("kind", F.lit(0)).union(moved("open").withColumn("kind", F.lit(1))), "wishes")
    sums = wish.groupBy("kind", "own", "to").agg(F.sum("weight").alias("w")).collect()  # 2 x shards x shards rows
    ask = {(r["own"], r["to"]): r["w"] for r in sums if r["kind"] == 0}
    quotas = [(0, a, b, min(w, ask.get((b, a), 0))) for (a, b), w in ask.items() if (b, a) in ask]
    fill = {(r["own"], r["to"]): r["w"] for r in sums if r["kind"] == 1}
    refusing = set()
    for b in range(shards):
        total = sum(w for (_, to), w in fill.items() if to == b)
        quotas += [(1, a, b, w * min(room[b], total) // total) for (a, to), w in fill.items() if to == b]
        if total > room[b]:
            refusing.add(b)
    quotas = [q for q in quotas if q[3] > 0]
    if not quotas:
        return None, refusing
    table = spark.createDataFrame(quotas, "kind int, own int, to int, quota long")
    ordered = wish.withColumn("step", size_class(F.col("gsize")) * STEPS
                              + F.pmod(F.xxhash64("grp"), F.lit(STEPS)).cast("int")).withColumn(
        "fine", F.pmod(F.xxhash64("grp", "row"), F.lit(FINE)).cast("int"))
    taken = _prefix(ordered, table, ["kind", "own", "to"]).groupBy("row").agg(
        F.min(F.struct("kind", "to")).alias("t")).select("row", F.col("t.to").alias("to"))
    return cut(state.join(taken, "row", "left").select("row", "weight", F.coalesce("to", "shard").alias("shard")),
               "state"), refusing


def _loads(state: DataFrame, shards: int) -> list[int]:
    got = {r["shard"]: r["w"] for r in state.groupBy("shard").agg(F.sum("weight").alias("w")).collect()}
    return [int(got.get(i, 0)) for i in range(shards)]


def propagate(rows: DataFrame, members: DataFrame, shards: int, rounds: int = 24) -> DataFrame:
    """(row, weight, shard) of all ``rows`` (row, weight), where ``members``
    (row, grp) links the rows of a group.  A row may be in several groups."""
    total = rows.agg(F.sum("weight").alias("w")).first()["w"] or 0
    part = -(-total // shards)
    sizes = members.groupBy("grp").agg(F.count("*").alias("gsize")).where("gsize > 1")
    members = cut(members.join(sizes, "grp"), "members")
    # rows of several groups come once; those of large groups count on their own
    linked = members.groupBy("row").agg(F.min(F.struct("gsize", "grp")).alias("g")).select("row", "g.*")
    linked = cut(linked.join(rows.select("row", "weight"), "row").select(
        "row", "weight", F.when(F.col("gsize") * F.col("weight") * LARGE > part, F.col("row")).otherwise(F.col("grp"))
        .alias("unit")), "linked")
    state = cut(_by_cells(linked.withColumn("unit", F.col("row")), [0] * shards), "state")
    load, full = _loads(state, shards), set()
    # where few documents are free to fill up, shards may overfill meanwhile
    slack = max(0.0, SLACK - (1 - sum(load) / max(1, total)))
    limit = int(part * (1 + slack))
    for _ in range(rounds):
        before, shut = load, set(full)
        after, refusing = _round(members, state, shards, [max(0, limit - x) for x in load], full)
        if after is None and not refusing - full:
            break
        state, load = (state, load) if after is None else (after, _loads(after, shards))
        full |= {b for b in refusing
                 if limit - load[b] < max(part / NEAR, (limit - before[b]) / 4) or load[b] == before[b]}
        full -= {b for b in shut if limit - load[b] > 8 * part / NEAR and load[b] < before[b]}  # what left made room
        if load == before and full == shut:
            break
    # a shard above its part gives documents back, small groups whole
    quotas = rows.sparkSession.createDataFrame([(i, part) for i in range(shards)], "shard int, quota long")
    spread = state.join(linked.select("row", "unit"), "row").withColumn(
        "step", F.pmod(F.xxhash64("unit"), F.lit(STEPS * STEPS)).cast("int")).withColumn(
        "fine", F.pmod(F.xxhash64(F.lit(1), "unit"), F.lit(FINE)).cast("int"))
    fixed = cut(_prefix(spread, quotas, ["shard"]).select("row", "weight", "shard"), "fixed")
    rest = (rows.select("row", "weight").join(fixed.select("row"), "row", "left_anti")
            .join(linked.select("row", "unit"), "row", "left").withColumn("unit", F.coalesce("unit", "row")))
    return fixed.unionByName(_by_cells(rest, _loads(fixed, shards)))


def cut_links(placed: DataFrame, members: DataFrame) -> DataFrame:
    """One row: ``links`` (pairs of members of a group) and ``cut`` (those in
    different shards), from counts per group and shard."""
    tally = members.join(placed, "row").groupBy("grp", "shard").agg(F.count("*").cast("decimal(20,0)").alias("n"))
    per = tally.groupBy("grp").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"))
    return per.agg(F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("n")) / 2), F.lit(0)).cast("long").alias("links"),
                   F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("same")) / 2), F.lit(0)).cast("long").alias("cut"))


def shard_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16,
                    rounds: int = 24, carry: list[str] | None = None) -> DataFrame:
    """One row per input row: ``id_col``, ``size`` (UTF-8 bytes of the text plus
    1), ``text_crc32``, ``law`` ("bytes": sizes of the shards are near equal),
    ``shard``, ``slot`` (place in the shard in ascending id order, gapless from
    0), ``grown_shard`` (null under this law), ``text_key`` (the group) and, if
    asked for, the ``carry`` columns as a struct ``row``.

    Groups are equal texts, known by length, crc32 and a 64-bit hash.  A group
    larger than a shard's room is spread over as few shards as have room.

    Defined cases: a null text counts as empty, and all of these are one group;
    null ids come first in their shard; repeated rows have a slot each (their
    order is that of the input); an empty table gives an empty result; other
    columns are ignored unless named in ``carry``."""
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    crc = F.crc32(F.encode(text, "UTF-8"))
    facts = cut(df.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("weight"), crc.alias("crc"),
        F.xxhash64(F.octet_length(text), crc, F.xxhash64(text)).alias("grp"),
        F.monotonically_increasing_id().alias("row"),
        *([F.struct(*[F.col(c) for c in carry]).alias("carried")] if carry else [])), "facts")
    placed = propagate(facts, facts.select("row", "grp"), shards, rounds)
    ordered = (facts.join(placed.select("row", "shard"), "row")
               .repartitionByRange(partitions(spark), "shard", "id", "row")
               .sortWithinPartitions("shard", "id", "row").withColumn("at", F.monotonically_increasing_id()))
    ordered = cut(ordered, "ordered")
    # a range holds a stretch of each shard's order: few rows, one a range and shard
    ranges = ordered.groupBy("shard", F.shiftright("at", 33).alias("range")).agg(
        F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    out = ordered.withColumn("range", F.shiftright("at", 33)).join(F.broadcast(ranges), ["shard", "range"])
    return out.select(F.col("id").alias(id_col), F.col("weight").alias("size"), F.col("crc").alias("text_crc32"),
                      F.lit("bytes").alias("law"), "shard", (F.col("at") - F.col("first") + F.col("base")).alias("slot"),
                      F.lit(None).cast("int").alias("grown_shard"), F.col("grp").alias("text_key"),
                      *([F.col("carried").alias("row")] if carry else []))
