"""Sharding by balanced label propagation, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import apart, materialize, small

SHARDS, ROUNDS = 8, 6
#: Rows that a task ranks together, in the mean, and rows of a group that lie together at most.
RANKED, PIECE = 4_000, 250
SEED = 77


def distributed_rank(rows: DataFrame, within: list[str], bucket: Column, order: list[Column], name: str = "rank") -> DataFrame:
    """rows with a gapless rank from 0 among those that agree on `within`, by bucket and then by `order`.

    Tasks number the rows of a bucket; what stands before a bucket is a running sum over
    the table of buckets, which has a row for some thousands of rows.
    """
    dealt = rows.withColumn("__b", bucket)
    keys = [*within, "__b"]
    before = F.sum("__n").over((Window.partitionBy(*within) if within else Window.partitionBy()).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = materialize(dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).select(*keys, F.coalesce(before, F.lit(0)).alias("__at")))
    numbered = dealt.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.join(small(offsets, 100_000), keys).withColumn(name, F.col("__at") + F.col("__k") - 1).drop("__b", "__at", "__k")


def propagate(linked: DataFrame, quota: list[int], rounds: int = ROUNDS) -> DataFrame:
    """linked rows (grp, n, h, shard, ...) with shards after some rounds of balanced label propagation.

    In a round each document looks up how many of its neighbours, the rows of its group,
    every shard holds, and asks for the fullest. Requests from i to j are met as far as as
    many go from j to i, and beyond that by a share of j's room under its quota; so no shard
    outgrows its quota but by chance's spread. Chance, a hash, picks a group as a whole, or
    its rows one by one where it is large. It ends when no request is left or met.
    """
    shards = len(quota)
    limits = F.array(*[F.lit(q).cast("long") for q in quota])
    now = materialize(linked)
    for turn in range(rounds):
        tally = now.groupBy("grp", "shard").agg(F.count(F.lit(1)).alias("c"))
        # on a tie, a shard by hash of the group, so that ties don't crowd the first one
        tie = F.pmod(F.col("shard") + F.pmod(F.xxhash64("grp"), F.lit(shards)), F.lit(shards))
        best = apart(tally.groupBy("grp").agg(F.max(F.struct("c", tie.alias("tie"), "shard"))["shard"].alias("best")))
        asked = materialize(now.join(best, "grp"))
        flows = asked.groupBy("shard", "best").agg(F.count(F.lit(1)).alias("m"))  # at most shards squared rows
        load = flows.groupBy(F.col("shard").alias("at")).agg(F.sum("m").alias("load"))
        move = flows.where("shard <> best")
        into = move.groupBy(F.col("best").alias("to")).agg(F.sum("m").alias("all"))
        back = move.select(F.col("shard").alias("b_from"), F.col("best").alias("b_to"), F.col("m").alias("back"))
        terms = (
            move.join(F.broadcast(into), F.col("best") == F.col("to"))
            .join(F.broadcast(load), F.col("best") == F.col("at"), "left")
            .join(F.broadcast(back), (F.col("best") == F.col("b_from")) & (F.col("shard") == F.col("b_to")), "left")
        )
        room = F.greatest(F.element_at(limits, (F.col("best") + 1).cast("int")) - F.coalesce("load", F.lit(0)), F.lit(0))
        met = F.least(F.lit(1.0), (F.coalesce("back", F.lit(0)) + room * F.col("m") / F.col("all")) / F.col("m"))
        shares = materialize(terms.select(F.col("shard").alias("s_from"), F.col("best").alias("s_to"), met.alias("met")))
        if not shares.where("met > 0").limit(1).count():
            break
        large = F.col("n") > max(1, min(quota) // 64)
        chance = F.pmod(F.xxhash64(F.lit(SEED + turn), "grp", F.when(large, F.col("h"))), F.lit(1 << 30)) / float(1 << 30)
        goes = chance < F.coalesce("met", F.lit(0.0))
        moved = asked.join(F.broadcast(shares), (F.col("shard") == F.col("s_from")) & (F.col("best") == F.col("s_to")), "left")
        now = materialize(moved.withColumn("shard", F.when(goes, F.col("best")).otherwise(F.col("shard"))).drop("best", "s_from", "s_to", "met"))
    return now


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of each row of docs, under the law `rows`: counts of shards are at most one apart.

    Equal texts, by 128 bits of hash, are linked. Linked documents move by label propagation, then all the rest
    fills the shards up to the quotas; what a shard holds beyond its quota counts with
    the rest. size is the UTF-8 bytes of the text and 1; null texts are empty and equal to
    empty ones. slot counts a shard's rows from 0 without gaps. Repeated rows are rows of
    their own. Places hang on ids alone, or on a row's place where its id is null. Other
    columns play no part; an empty table gives an empty one.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    read = docs.select(
        F.col(id_col).cast("long").alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16).alias("grp"),
        F.xxhash64(F.coalesce(F.col(id_col).cast("long"), F.monotonically_increasing_id()), F.lit(SEED)).alias("h"),
    )
    nodes = materialize(read)
    total = nodes.count()
    quota = [total // shards + (k < total % shards) for k in range(shards)]
    counted = materialize(nodes.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    groups = small(counted)
    single = nodes.join(groups, "grp", "left_anti")
    linked = nodes.join(groups, "grp").withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))
    settled = propagate(linked, quota, rounds)

    # groups lie together in a shard's order, so that one at most is cut where the quota ends; large ones over many buckets
    piece = F.when(F.col("n") > PIECE, F.pmod("h", F.ceil(F.col("n") / PIECE)))
    bucket = F.pmod(F.xxhash64("grp", piece), F.lit(max(1, total // RANKED)))
    ranked = materialize(distributed_rank(settled, ["shard"], bucket, [F.col("grp"), F.col("h"), F.col("id")]))
    limits = F.array(*[F.lit(q).cast("long") for q in quota])
    limit = F.element_at(limits, F.col("shard") + 1)
    kept = ranked.where(F.col("rank") < limit)
    held = {r["shard"]: r["n"] for r in kept.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each shard

    columns = ["id", "size", "text_crc32", "h", "grp"]
    rest = single.select(*columns).unionByName(ranked.where(F.col("rank") >= limit).select(*columns))
    rest = distributed_rank(rest, [], F.pmod("h", F.lit(max(1, total // RANKED))), [F.col("h"), F.col("id"), F.col("grp")])
    room, ends = [quota[k] - held.get(k, 0) for k in range(shards)], []
    for r in room:
        ends.append((ends[-1] if ends else 0) + r)
    array = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    shard = F.size(F.filter(array(ends), lambda end: end <= F.col("rank")))
    placed = rest.withColumn("shard", shard)
    first = F.element_at(array([held.get(k, 0) - (ends[k] - room[k]) for k in range(shards)]), F.col("shard") + 1)
    filled = placed.select("id", "size", "text_crc32", "shard", (first + F.col("rank")).alias("slot"))
    return kept.select("id", "size", "text_crc32", "shard", F.col("rank").alias("slot")).unionByName(filled)
