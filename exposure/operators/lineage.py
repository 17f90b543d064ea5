"""Process lineage: ancestor chains, admission by lineage, levels on offer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposure.functions import fixed
from exposure.session import store

NODE = "struct<pid:bigint,start_time:bigint,uid:int>"


def ancestors(
    procs: DataFrame, max_depth: int = fixed.MAX_CHAIN, keys: Sequence[str] = ("host",)
) -> DataFrame:
    """Chain of every process, itself first: ``keys, pid, chain ARRAY<STRUCT<pid, start_time, uid>>``.

    Stretches of 1, 2, 4 … levels are made by doubling, each only for processes that have a descendant so far below: they are
    what somebody's chain goes on with, and in a tree they grow few at once. The longest stretch is then put on the next shorter
    one and so on down, until each process takes on the chain of its parent, so a long chain of a process without children is
    neither shuffled nor written. Fewer rounds do where no chain goes on. A chain stops at a missing process, at pid 0, at a process
    that is its own parent and at a repeat. Of several rows with one pid (it was used again) the youngest counts; put the snapshot
    among ``keys`` to keep snapshots apart.
    """
    on = list(keys)
    every = F.struct("start_time", "ppid", F.col("uid").cast("int").alias("uid"))
    procs = procs.groupBy(*on, "pid").agg(F.max(every).alias("p")).select(*on, "pid", "p.*")
    parent = F.when((F.col("ppid") != 0) & (F.col("ppid") != F.col("pid")), F.col("ppid"))
    node = F.struct("pid", "start_time", F.col("uid").cast("int").alias("uid"))
    own = store(procs.where("pid <> 0").select(*on, "pid", F.array(node).alias("chain"), parent.alias("next")))
    stretches: list[DataFrame] = []
    length = 1
    while length < max_depth:
        below = stretches[-1] if stretches else own
        asked = below.where("next is not null").select(*on, F.col("next").alias("pid")).distinct()
        above = below.join(asked, [*on, "pid"], "left_semi")
        stretches.append(store(_longer(above, below, on) if stretches else above))
        length *= 2
        if stretches[-1].where("next is not null").isEmpty():
            break
    chains = own
    if stretches:
        whole = stretches.pop()
        while stretches:
            whole = store(_longer(stretches.pop(), whole, on))
        chains = _longer(own, whole, on)
    return chains.select(*on, "pid", F.slice(_until_repeat(F.col("chain")), 1, max_depth).alias("chain"))


def _longer(chains: DataFrame, further: DataFrame, on: list[str]) -> DataFrame:
    """Chains with what ``further`` has for the process that they go on with. Many children share one; adaptive execution splits the hot side."""
    more = further.select(*on, F.col("pid").alias("next"), F.col("chain").alias("more"), F.col("next").alias("beyond"))
    return chains.join(more, [*on, "next"], "left").select(
        *on, "pid", F.concat("chain", F.coalesce("more", F.array().cast(f"array<{NODE}>"))).alias("chain"), F.col("beyond").alias("next"))


def _until_repeat(chain: Column) -> Column:
    """The chain up to the first pid that occurred before. Only a chain with a repeat, in a cycle, is gone through node by node."""
    pids = chain["pid"]
    fresh = F.transform(chain, lambda n, i: F.array_position(pids, n["pid"]) == i + 1)
    cut = F.array_position(fresh, F.lit(False))
    return F.when(F.size(F.array_distinct(pids)) == F.size(pids), chain).otherwise(F.slice(chain, F.lit(1), cut.cast("int") - 1))


def levels(chains: DataFrame) -> DataFrame:
    """Chains as rows with 0-based depth."""
    rest = [c for c in chains.columns if c != "chain"]
    return chains.select(*rest, F.posexplode("chain").alias("depth", "n")).select(
        *rest, "depth", F.col("n.pid").alias("node_pid"), F.col("n.start_time").alias("node_start")
    )


def in_tree(peers: DataFrame, admitted: DataFrame, chains: DataFrame, keys: Sequence[str] = ("host",)) -> DataFrame:
    """Peers ``keys, pid, start_time`` that are an admitted process or descend from one.

    Identity is (pid, start_time). The walk goes up from the peer, never down from the admitted.
    """
    on = list(keys)
    who = peers.select(*on, "pid", "start_time").distinct()
    known = admitted.select(*on, F.col("pid").alias("node_pid"), F.col("start_time").alias("node_start")).distinct()
    up = levels(chains.join(who, [*on, "pid"])).where("depth > 0").select(*on, "pid", "start_time", "node_pid", "node_start")
    itself = who.select(*on, "pid", "start_time", F.col("pid").alias("node_pid"), F.col("start_time").alias("node_start"))
    hit = itself.unionByName(up).join(known, [*on, "node_pid", "node_start"], "left_semi")
    return hit.select(*on, "pid", "start_time").distinct()


def offerable_levels(
    chains: DataFrame, owner: Column, max_offered: int = fixed.MAX_OFFERED,
    floor_levels: int = fixed.FLOOR_LEVELS, min_pid: int = fixed.MIN_PID,
) -> DataFrame:
    """Each level of a chain with why it is not on offer, or null: one row per level.

    Within a chain only the first place beyond the limit is sought, in one pass; the rest is decided level by level.
    """
    rest = [c for c in chains.columns if c != "chain"]

    def base(n: Column, i: Column) -> Column:
        return (
            F.when((i >= F.col("__size") - floor_levels) & (i > 0), "depth_floor")
            .when(n["pid"] <= min_pid, "system_pid")
            .when(F.coalesce(n["uid"] != F.col("__owner"), F.lit(True)), "other_owner")
        )

    free = F.filter(F.transform("chain", lambda n, i: F.when(base(n, i).isNull(), i)), lambda i: i.isNotNull())
    sized = chains.withColumns({"__size": F.size("chain"), "__owner": owner})
    placed = sized.withColumn("__full", F.when(F.col("__size") > max_offered, F.get(free, F.lit(max_offered))))
    rows = placed.select(*rest, "__size", "__owner", "__full", F.posexplode("chain").alias("depth", "n"))
    why = base(F.col("n"), F.col("depth"))
    return rows.select(*rest, "depth", F.col("n.pid").alias("node_pid"), why.alias("__why"), "__full").select(
        *rest, "depth", "node_pid", F.when(F.col("__why").isNull() & (F.col("depth") >= F.col("__full")), "over_limit").otherwise(F.col("__why")).alias("skipped"))


def project_of(paths: DataFrame, projects: DataFrame, home: str | None = None) -> DataFrame:
    """Nearest enclosing project of each path: the longest ancestor directory that is a project root.

    Directories are made distinct first, then each looks its prefixes up by equi-join. Inside
    ``home`` the walk ends there.
    """
    folder = F.regexp_replace("path", r"/[^/]*\z", "")
    folders = paths.select(folder.alias("__dir")).distinct()
    pieces = F.split("__dir", "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda n: F.array_join(F.slice(pieces, F.lit(1), n), "/"))
    if home is not None:
        inside = (F.col("__dir") == home) | F.col("__dir").startswith(home.rstrip("/") + "/")
        heads = F.filter(heads, lambda h: ~inside | (F.length(h) >= len(home)))
    roots = projects.select(F.col("root").alias("__root")).distinct()
    nearest = folders.select("__dir", F.explode(heads).alias("__root")).join(roots, "__root").groupBy("__dir").agg(
        F.max_by("__root", F.length("__root")).alias("project_root")
    )
    return paths.withColumn("__dir", folder).join(nearest, "__dir", "left").select(*paths.columns, "project_root")
