"""Key ranges and who serves them: routing, overlap, quorum and failover decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Up to FEW regions are compared with each row; more are found by cells of the key space.
FEW = 8
MOST_BROADCAST = 100_000
CELLS = 256
#: Rows that are put in order together, where keys are spread evenly.
TOGETHER = 100_000


def _cell(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are at or below value, by halving."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(value >= cuts[mid], search(mid + 1, high)).otherwise(search(low, mid))

    return search(0, len(cuts))


def _cells(regions: DataFrame) -> tuple[DataFrame, list[int]] | None:
    """regions once for each cell they touch (_cell) and the cuts of the cells; None if regions are few.

    Cuts are quantiles of the regions' starts, so cells hold about as many regions each. The
    copies are broadcast up to MOST_BROADCAST regions, counted first; beyond that cells are a
    shuffled join's key, whose hot cells adaptive execution splits.
    """
    count = regions.limit(MOST_BROADCAST + 1).count()
    if count <= FEW:
        return None
    cuts = sorted({int(x) for x in regions.approxQuantile("start_row", [i / CELLS for i in range(1, CELLS)], 0.001)})
    first = F.when(F.col("start_row").isNull(), 0).otherwise(_cell(F.col("start_row"), cuts))
    last = F.when(F.col("end_row").isNull(), len(cuts)).otherwise(_cell(F.col("end_row"), cuts))
    spread = regions.withColumn("_first", first).withColumn("_cell", F.explode(F.sequence("_first", F.greatest("_first", last))))
    return (F.broadcast(spread) if count <= MOST_BROADCAST else spread), cuts


def route(keys: DataFrame, regions: DataFrame, key: str) -> DataFrame:
    """Each key with the region whose [start_row, end_row) holds it; null region where none does.

    Regions don't overlap. A null start or end is unbounded; a null key meets nothing.
    """
    held = F.col(key).isNotNull() & (F.col("start_row").isNull() | (F.col(key) >= F.col("start_row"))) & (F.col("end_row").isNull() | (F.col(key) < F.col("end_row")))
    found = _cells(regions)
    if found is None:
        return keys.join(F.broadcast(regions), held, "left")
    spread, cuts = found
    return keys.withColumn("_at", _cell(F.col(key), cuts)).join(spread, (F.col("_at") == F.col("_cell")) & held, "left").drop("_at", "_cell", "_first")


def places(rows: DataFrame, region: str, key: str) -> DataFrame:
    """rows with their place (from 1) by key among those of their region; rows without a region go.

    The keys between a region's least and greatest are cut to even ranges, so many that each holds
    about TOGETHER rows. Rows are numbered in their range and moved on by the rows of the ranges
    before it; no task has a whole large region. A key that very many rows share is in one range.
    """
    wide = rows.groupBy(region).agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"), F.ceil(F.count("*") / TOGETHER).alias("_parts"))
    low, high = F.col("_lo").cast("double"), F.col("_hi").cast("double")
    at = F.when(F.col(key).isNull(), -1).when(high > low, F.floor((F.col(key).cast("double") - low) / (high - low) * F.col("_parts"))).otherwise(0)
    ranged = rows.join(F.broadcast(wide), region).withColumn("_range", at).drop("_lo", "_hi", "_parts")
    before = Window.partitionBy(region).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy(region, "_range").agg(F.count("*").alias("_n")).select(region, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(region, "_range").orderBy(key))
    return ranged.join(ranges, [region, "_range"]).withColumn("place", F.col("_before") + inside).drop("_range", "_before")


def overlap(scans: DataFrame, regions: DataFrame) -> DataFrame:
    """A task for each scan range and region that meet, cut to what they share. Null bounds are unbounded."""
    free = lambda a, b: F.col(a).isNull() | F.col(b).isNull() | (F.col(a) < F.col(b))
    meet = free("scan_start", "end_row") & free("start_row", "scan_end")
    found = _cells(regions)
    if found is None:
        met = scans.join(F.broadcast(regions), meet)
    else:
        spread, cuts = found
        low = F.when(F.col("scan_start").isNull(), 0).otherwise(_cell(F.col("scan_start"), cuts))
        high = F.when(F.col("scan_end").isNull(), len(cuts)).otherwise(_cell(F.col("scan_end"), cuts))
        cut = scans.withColumn("_from", low).withColumn("_at", F.explode(F.sequence("_from", F.greatest("_from", high))))
        # A pair may share several cells; it counts in the first of them.
        once = F.col("_at") == F.greatest("_from", "_first")
        met = cut.join(spread, (F.col("_at") == F.col("_cell")) & meet & once).drop("_from", "_at", "_cell", "_first")
    return met.withColumn("task_start", F.greatest("scan_start", "start_row")).withColumn("task_end", F.least("scan_end", "end_row"))


def tree_check(edges: DataFrame) -> DataFrame:
    """One row on edges (parent, child): vertices, edges, roots, children with several parents, vertices reached, valid.

    Reach grows by a step a round and stops when it finds nothing new; each round is checkpointed
    where the session has a checkpoint folder.
    """
    edges = edges.select("parent", "child").distinct()
    vertices = edges.select(F.col("parent").alias("x")).union(edges.select("child")).distinct()
    roots = vertices.join(edges, F.col("x") == F.col("child"), "left_anti")
    doubled = edges.groupBy("child").agg(F.count("*").alias("n")).where("n > 1")
    keep = lambda df: df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df
    reached = front = keep(roots)
    while not front.isEmpty():
        front = keep(front.join(edges, F.col("x") == F.col("parent")).select(F.col("child").alias("x")).distinct().join(reached, "x", "left_anti"))
        reached = keep(reached.union(front))
    sizes = {"vertices": vertices, "edges": edges, "roots": roots, "doubled": doubled, "reached": reached}
    counts = reduce(DataFrame.union, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in sizes.items()])
    row = counts.agg(*[F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in sizes])
    return row.withColumn("valid", (F.col("roots") == 1) & (F.col("reached") == F.col("vertices")) & (F.col("edges") == F.col("vertices") - 1))


def quorum(voters: Column, acked: Column) -> Column:
    return acked >= F.floor(voters / 2) + 1


def write_gate(acks: DataFrame) -> DataFrame:
    """A decision for each region from rows (region_id, role, acked, is_leader, leader_matches).

    Reasons come in order: leader does not match, leader may not lead, quorum is not satisfied.
    """
    voter = F.col("role").isin("DATA_VOTER", "WITNESS_VOTER")
    agg = acks.groupBy("region_id").agg(
        F.count_if(voter).alias("voters"),
        F.count_if(voter & F.col("acked")).alias("acked"),
        F.coalesce(F.bool_or(F.col("is_leader") & F.col("leader_matches")), F.lit(False)).alias("_match"),
        F.coalesce(F.bool_or(F.col("is_leader") & (F.col("role") == "DATA_VOTER")), F.lit(False)).alias("_leads"),
    )
    required = F.floor(F.col("voters") / 2) + 1
    reason = F.when(~F.col("_match"), "leader does not match metadata").when(~F.col("_leads"), "leader cannot lead").when(F.col("acked") < required, "quorum is not satisfied")
    return agg.select("region_id", required.alias("required"), "acked", reason.isNull().alias("allowed"), reason.alias("reason"))


def failover(replicas: DataFrame) -> DataFrame:
    """A plan for each vnode from (vnode_id, ordinal, replica_id, role, reachable, leader_id, epoch).

    The leader stays if it is reachable with a quorum; else the first reachable data voter is
    promoted with the next epoch; without a quorum data voters serve reads only.
    """
    voter, data = F.col("role").isin("DATA_VOTER", "WITNESS_VOTER"), F.col("role") == "DATA_VOTER"
    agg = replicas.groupBy("vnode_id").agg(
        F.count_if(voter).alias("n"),
        F.count_if(voter & F.col("reachable")).alias("up"),
        F.coalesce(F.bool_or(F.col("reachable") & data & (F.col("replica_id") == F.col("leader_id"))), F.lit(False)).alias("leader_up"),
        F.min_by(F.when(F.col("reachable") & data, F.col("replica_id")), F.when(F.col("reachable") & data, F.col("ordinal"))).alias("heir"),
        F.first("leader_id").alias("leader_id"),
        F.first("epoch").alias("epoch"),
    )
    has = quorum(F.col("n"), F.col("up"))
    action = F.when(has & F.col("leader_up"), "KEEP_LEADER").when(has & F.col("heir").isNotNull(), "PROMOTE_DATA_LEADER").when(F.col("heir").isNotNull(), "DEGRADED_READONLY").otherwise("UNAVAILABLE")
    agg = agg.withColumn("action", action)
    target = F.when(F.col("action") == "KEEP_LEADER", F.col("leader_id")).when(F.col("action") == "PROMOTE_DATA_LEADER", F.col("heir"))
    return agg.select("vnode_id", "action", target.alias("leader"), (F.col("epoch") + (F.col("action") == "PROMOTE_DATA_LEADER").cast("long")).alias("epoch"))


def refresh(active: DataFrame, managed: DataFrame) -> DataFrame:
    """What a refresh of clients does with each id: REGISTER, RETAIN or UNREGISTER."""
    a, m = active.select("client_id", F.lit(True).alias("_a")), managed.select("client_id", F.lit(True).alias("_m"))
    action = F.when(F.col("_a").isNull(), "UNREGISTER").when(F.col("_m").isNull(), "REGISTER").otherwise("RETAIN")
    return a.join(m, "client_id", "full").select("client_id", action.alias("action"))
