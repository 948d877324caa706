"""Order statistics, tallies and counts with metadata, and the fold of map operations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def majority(progress: DataFrame, group: list[str], index: str = "match_index", gap: int | None = None) -> DataFrame:
    """Least, majority (sorted[(n - 1) / 2]) and greatest index of each group.

    With a gap, a majority that runs further ahead of the least than it counts as the least.
    """
    mid = F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {index})").cast("long")
    out = progress.groupBy(*group).agg(F.min(index).alias("least"), mid.alias("majority"), F.max(index).alias("greatest"))
    return out if gap is None else out.withColumn("majority", F.when(F.col("majority") - F.col("least") > gap, F.col("least")).otherwise(F.col("majority")))


def tally(replies: DataFrame, group: str = "election", peer: str = "peer", seq: str = "seq") -> DataFrame:
    """PASSED or REJECTED by majority of each peer's first reply, else TIMEOUT."""
    first = replies.groupBy(group, peer, "voters").agg(F.min_by("granted", seq).alias("granted"))
    out = first.groupBy(group, "voters").agg(F.count_if("granted").alias("yes"), F.count_if(~F.col("granted")).alias("no"))
    need = F.floor(F.col("voters") / 2) + 1
    result = F.when(F.col("yes") >= need, "PASSED").when(F.col("voters") - F.col("no") < need, "REJECTED").otherwise("TIMEOUT")
    return out.select(group, "yes", "no", result.alias("result"))


def hotspots(events: DataFrame, name: str, amount: str, top: int) -> DataFrame:
    """The top groups by summed amount (by count where it is 0), then name: a report of `top` rows."""
    out = events.groupBy(name).agg(F.sum(F.greatest(F.col(amount), F.lit(0))).alias("amount"), F.count("*").alias("events"))
    return out.orderBy(F.when(F.col("amount") > 0, F.col("amount")).otherwise(F.col("events")).desc(), F.col(name)).limit(top)


def retained(snapshots: DataFrame, keep: int, index: str = "idx") -> DataFrame:
    """Which snapshots go: those after `keep` valid ones, from the newest."""
    last = snapshots.where("valid").select(F.col(index).alias("_i")).orderBy(F.desc("_i")).limit(keep).agg(F.min("_i").alias("_least"), F.count("*").alias("_n"))  # one row
    return snapshots.join(F.broadcast(last)).withColumn("deleted", F.coalesce((F.col("_n") >= keep) & (F.col(index) < F.col("_least")), F.lit(False))).drop("_least", "_n")


def kth(df: DataFrame, group: list[str], value: str, places: dict[str, Column], buckets: int = 1024) -> DataFrame:
    """For each group the values at some places of its sorted rows: places are columns over n, from 0.

    Equal values are counted first. Ranges of a group's values are counted next, to find the range
    of each place, and only rows of such ranges are ranked; so no task has a whole large group.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    wide = counts.groupBy(*group).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_c").alias("n"))
    at = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * buckets)).otherwise(0)
    placed = counts.join(wide, group).withColumn("_b", at)
    order = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy(*group, "_b", "n").agg(F.sum("_c").alias("_size")).withColumn("_from", F.coalesce(F.sum("_size").over(order), F.lit(0)))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), k.cast("long").alias("k")) for name, k in places.items()]))
    ranges = ranges.withColumn("_p", wanted).where((F.col("_from") <= F.col("_p.k")) & (F.col("_p.k") < F.col("_from") + F.col("_size"))).select(*group, "_b", "_from", "_p")
    met = placed.select(*group, "_b", "_v", "_c").join(ranges, [*group, "_b"])
    inner = Window.partitionBy(*group, "_b", "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    met = met.withColumn("_start", F.col("_from") + F.coalesce(F.sum("_c").over(inner), F.lit(0)))
    hit = met.where((F.col("_start") <= F.col("_p.k")) & (F.col("_p.k") < F.col("_start") + F.col("_c")))
    return hit.groupBy(*group).agg(*[F.max(F.when(F.col("_p.name") == name, F.col("_v"))).alias(name) for name in places])


def joint(progress: DataFrame, group: list[str], index: str = "match_index") -> DataFrame:
    """Majority indices of the old and the new peers (flags old, new), and the lesser of the two as joint."""
    mid = lambda which: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY CASE WHEN {which} THEN {index} END)").cast("long").alias(which)
    return progress.groupBy(*group).agg(mid("old"), mid("new")).withColumn("joint", F.least("old", "new"))


def label(rows: DataFrame, key: str, text: str, patterns: DataFrame) -> DataFrame:
    """(key, label) once for each label any of whose patterns the text contains, in either case.

    patterns (label, pattern) are few and become one expression; a row may have several labels.
    """
    by_label: dict[str, list[str]] = {}
    for r in patterns.collect():  # a short list that its author wrote
        by_label.setdefault(r["label"], []).append(r["pattern"])
    low = F.lower(F.col(text))
    found = [F.when(F.array_contains(F.array(*[F.contains(low, F.lit(p.lower())) for p in some]), True), F.lit(name)) for name, some in sorted(by_label.items())]
    labels = F.filter(F.array(*found), lambda x: x.isNotNull())
    return rows.select(key, F.explode(labels).alias("label"))


def fold_map(ops: DataFrame) -> DataFrame:
    """(map_name, key, value) after put, remove and clear, by seq. A put without a value does nothing.

    clear counts for all keys of its map (drop and replaceAll clear as well); only its newest seq is
    joined to the keys. An entry that its own replaceAll puts has that seq and stays.
    """
    own = F.col("own") if "own" in ops.columns else F.lit(False)
    ops = ops.withColumn("own", own)
    cleared = ops.where("method in ('clear', 'drop', 'replaceAll')").groupBy("map_name").agg(F.max("seq").alias("cleared"))
    real = ops.where("method = 'remove' or (method = 'put' and value is not null)")
    last = real.groupBy("map_name", "key").agg(F.max_by(F.struct("method", "value", "own"), "seq").alias("o"), F.max("seq").alias("seq"))
    live = last.join(cleared, "map_name", "left").where("o.method = 'put' and (cleared is null or seq > cleared or (o.own and seq = cleared))")
    return live.select("map_name", "key", F.col("o.value").alias("value"))


def spread_entries(ops: DataFrame) -> DataFrame:
    """ops whose putAll and replaceAll (with a map of entries) are followed by a put for each entry, of their seq."""
    puts = ops.where("method in ('putAll', 'replaceAll')").select("seq", F.lit("put").alias("method"), "map_name", F.explode("entries").alias("key", "value"), F.lit(True).alias("own"))
    return ops.where("method <> 'putAll'").drop("entries").withColumn("own", F.lit(False)).unionByName(puts)


def map_read(entries: DataFrame, **read: Column) -> DataFrame:
    """A read function over each whole map: aggregates of its entries (key, value)."""
    return entries.groupBy("map_name").agg(*[c.alias(name) for name, c in read.items()])


def map_update(entries: DataFrame, map_name: str, update: Callable[[Column, Column], Column]) -> DataFrame:
    """An update function of (key, value) over the entries of one map; entries that it makes null go."""
    value = F.when(F.col("map_name") == map_name, update(F.col("key"), F.col("value"))).otherwise(F.col("value"))
    return entries.withColumn("value", value).where("value is not null")
