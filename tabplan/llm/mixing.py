"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
#: Documents that one fold pairs, in the mean; a reduction level leaves one of so many.
FOLD = 96
SEED = 20_240_607


def word_count(text: Column) -> Column:
    """Matches of [^\\x20\\x09-\\x0D]+; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(gid, source, source_size, target) of a table (source, size); gid counts the sources from 0.

    Sources stand by code point, null last, and take the weights in turn. They share
    `share` times the whole size by weight; a target stops at `most` times its source's
    size, and the excess goes to the others by weight until none is above. In closed form:
    by cap per weight, the level of the filling is the greatest of (whole - caps of those
    before) / (weights of the rest), for both sums run along that order.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (turn % len(weights) + 1).cast("int"))
    ranked = by_source.select(turn.alias("gid"), "source", "source_size", weight.alias("w"), (F.col("source_size") * float(most)).alias("cap"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    caps, used = F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.coalesce(F.sum("w").over(before), F.lit(0.0))
    level = (F.sum("source_size").over(everything) * float(share) - caps) / (F.sum("w").over(everything) - used)
    filled = ranked.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return filled.select("gid", "source", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def _chance(*of: Column) -> Column:
    """A number from 0 to under 1, the same in each rerun."""
    return F.shiftrightunsigned(F.xxhash64(*of), 11) / F.lit(float(1 << 53))


def _meet(level: int):
    """The step of a fold: the document held so far meets the next one.

    Mass, which is size times probability, goes from one to the other until one of the two
    is integral, in the direction that chance says, so that neither's expected probability
    changes, nor the sum of mass. The other one is held on.
    """

    def step(held: Column, new: Column) -> Column:
        hs, hx, ns, nx = held["size"], held["x"], new["size"], new["x"]
        up, down = F.least((1 - hx) * hs, nx * ns), F.least(hx * hs, (1 - nx) * ns)
        is_up = _chance(held["key"], new["key"], F.lit(level), F.lit(SEED)) * (up + down) < down
        held_ends = F.when(is_up, (1 - hx) * hs <= nx * ns).otherwise(hx * hs <= (1 - nx) * ns)
        moved = F.when(is_up, up).otherwise(-down)
        done = F.struct(
            F.when(held_ends, held["id"]).otherwise(new["id"]).alias("id"),
            F.when(held_ends, hs).otherwise(ns).alias("size"),
            F.when(held_ends == is_up, 1).otherwise(0).alias("one"),
        )
        met = F.struct(
            F.when(held_ends, new["key"]).otherwise(held["key"]).alias("key"),
            F.when(held_ends, new["id"]).otherwise(held["id"]).alias("id"),
            F.when(held_ends, ns).otherwise(hs).alias("size"),
            F.when(held_ends, nx - moved / ns).otherwise(hx + moved / hs).alias("x"),
            F.concat(held["done"], F.array(done)).alias("done"),
        )
        first = F.struct(new["key"].alias("key"), new["id"].alias("id"), ns.alias("size"), nx.alias("x"), held["done"].alias("done"))
        return F.when(held["key"].isNull(), first).otherwise(met)

    return step


def pivotal_rounding(items: DataFrame, fold: int = FOLD) -> DataFrame:
    """(gid, id, size, one) of all rows of (gid, key, id, size, x) with 0 < x < 1 and size > 0; one is 1 or 0, 1 with probability x.

    Within a group gid, sum(size * one) differs from sum(size * x) by half of one row's
    size at most. Rows are dealt to folds of about `fold` rows by hash of key; each fold pairs its
    rows, the largest first so that mostly a small one is left, and the folds' residuals go up
    a reduction tree until each group has a single one. That one goes to the nearer bound, as
    chance could put it further off. A group of a third of all rows has as many more folds, and none of them is large.
    """
    nothing = "named_struct('key', cast(null as bigint), 'id', cast(null as bigint), 'size', 0D, 'x', 0D, 'done', cast(array() as array<struct<id:bigint,size:double,one:int>>))"
    now = items.select("gid", F.col("key").cast("long"), F.col("id").cast("long"), F.col("size").cast("double"), F.col("x").cast("double")).where("x > 0 and x < 1 and size > 0")
    decided, level, many = [], 0, True
    while many:
        count = now.groupBy("gid").agg(F.count(F.lit(1)).alias("n"))
        many = (count.agg(F.max("n")).first()[0] or 0) > 1.5 * fold
        dealt = now.join(small(count, 50_000), "gid").withColumn("part", F.pmod(F.xxhash64("key", F.lit(level), F.lit(SEED)), F.ceil(F.col("n") / fold))) if many else now.withColumn("part", F.lit(0))
        row = F.struct((-F.col("size")).alias("order"), F.xxhash64("key").alias("h"), "key", "id", "size", "x")
        met = dealt.groupBy("gid", "part").agg(F.sort_array(F.collect_list(row)).alias("rows"))
        folded = materialize(met.select("gid", F.aggregate("rows", F.expr(nothing), _meet(level)).alias("f")))
        decided.append(folded.select("gid", F.inline("f.done")))
        now = folded.select("gid", "f.key", "f.id", "f.size", "f.x")
        level += 1
    decided.append(now.select("gid", "id", "size", (F.col("x") >= 0.5).cast("int").alias("one")))
    return reduce(DataFrame.unionByName, decided).withColumn("size", F.col("size").cast("long"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(id, source, size, source_size, target, copies) of each row of docs.

    copies is target / source_size rounded up or down by pivotal rounding, so that each
    source's copies hold its target's words but for part of one document. Null texts have
    size 0, as have empty ones; documents of size 0 get no copies. Null is a source of its
    own, as is the empty string. Repeated rows are rows of their own; chance hangs on the
    ids alone, or on a row's place where its id is null. Other columns play no part; an
    empty table gives an empty one.
    """
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    return _mix(materialize(read.withColumn("key", F.coalesce("id", F.monotonically_increasing_id()))), weights, share, most)


def _mix(rows: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """mix_sources of materialized rows (id, source, size, key); chance hangs on the keys."""
    targets = materialize(source_targets(rows, weights, share, most))
    rated = targets.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    rated = small(rated.select(F.col("source").alias("s"), "gid", F.floor("rate").alias("base"), (F.col("rate") - F.floor("rate")).alias("x")), 50_000)
    items = rows.join(rated, F.col("source").eqNullSafe(F.col("s"))).select("gid", "key", "id", "size", "x", "base")
    plain = items.where("x <= 0 or size = 0").select("gid", "id", "size", F.lit(0).alias("one"))
    rounded = plain.unionByName(pivotal_rounding(items))
    named = small(targets, 50_000)
    copies = F.when(F.col("size") > 0, F.floor(F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))) + F.col("one")).otherwise(0)
    return rounded.join(named, "gid").select("id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """docs, each row as often as the mix takes it; columns stay as they are.

    Each row has a decision of its own, those that share an id or have none too: rows are
    numbered and written first, and copies joined by number.
    """
    numbered = materialize(docs.withColumn("__row", F.monotonically_increasing_id()))
    read = numbered.select(F.col("__row").alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.coalesce(F.col(id_col).cast("long"), "__row").alias("key"))
    plan = _mix(materialize(read), **options).where("copies > 0").select(F.col("id").alias("__id"), F.col("copies").alias("__copies"))
    taken = numbered.join(small(materialize(plan)), F.col("__row") == F.col("__id"))
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).drop("__row", "__id", "__copies", "__copy")
