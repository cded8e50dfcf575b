"""Where sessions belong and where they may be sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def route(paths: DataFrame, walls: DataFrame, path_col: str = "path") -> DataFrame:
    """walls: base, project, destination. The longest base that equals the path or is a folder above it wins;
    others are unsorted and local. A path meets walls by equality with the folders above it, so the join has
    an equi key whatever the number of walls."""
    distinct = paths.select(F.col(path_col).alias("_path")).distinct().withColumn("_parts", F.split(F.coalesce("_path", F.lit("")), "/"))
    met = distinct.select("_path", F.explode(F.transform(F.sequence(F.lit(1), F.size("_parts")), lambda n: F.array_join(F.slice("_parts", 1, n), "/"))).alias("base"))
    best = met.join(walls.hint("shuffle_merge"), "base").groupBy("_path").agg(F.max_by(F.struct("project", "destination"), F.length("base")).alias("w"))
    out = paths.join(best.hint("shuffle_merge"), F.col(path_col) == F.col("_path"), "left")
    return out.withColumns({"project": F.coalesce("w.project", F.lit("unsorted")), "destination": F.coalesce("w.destination", F.lit("local"))}).drop("_path", "w")


def canonical(path: Column) -> Column:
    """One spelling of a path: slashes forward, none at the end, lower case."""
    return F.lower(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+$", ""))


def folders_above(path: Column) -> Column:
    """The path and all folders above it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def last_name(path: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(path, r"[\\/]+$", ""), r"([^\\/]*)$", 1)


def route_sessions(sessions: DataFrame, walls: DataFrame, roots: DataFrame) -> DataFrame:
    """sessions: cwd and what else they have. walls: path, project, local_only, same_provider. roots: path of repositories. Adds project, via, network, same_provider, destination.

    Paths are compared in one spelling. A session belongs to the wall of the longest path that is its folder or above it (via wall), else to the repository of the longest such root, by the
    root's last name (root), else to its folder by name (folder); without a folder it is unsorted (none). It may use the network if its wall is not local; without a wall, if there are no walls at all; never without a
    folder. Without a wall it stays with its own provider. Of several walls of one path the first by project counts."""
    known = sessions.select("cwd").distinct().filter("cwd IS NOT NULL AND cwd <> ''").withColumn("_path", canonical(F.col("cwd")))
    above = known.select("cwd", F.explode(folders_above(F.col("_path"))).alias("base"))
    wall = walls.groupBy(canonical(F.col("path")).alias("base")).agg(F.min(F.struct("project", "local_only", "same_provider")).alias("w"))
    root = roots.groupBy(canonical(F.col("path")).alias("base")).agg(F.min(last_name(F.col("path"))).alias("r"))
    met = above.join(wall.hint("shuffle_merge"), "base", "left").join(root.hint("shuffle_merge"), "base", "left")
    nearest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.length("base"))).alias(c)
    best = met.groupBy("cwd").agg(nearest("w"), nearest("r"))
    any_wall = walls.agg((F.count(F.lit(1)) > 0).alias("_walls"))
    out = sessions.join(best.hint("shuffle_merge"), "cwd", "left").crossJoin(F.broadcast(any_wall))  # one row
    placed = F.coalesce(F.col("cwd") != "", F.lit(False))
    name = F.coalesce(F.nullif(F.when(F.col("r").isNotNull(), F.col("r")).otherwise(last_name(F.col("cwd"))), F.lit("")), F.lit("unsorted"))
    out = out.withColumns({
        "project": F.when(~placed, "unsorted").when(F.col("w").isNotNull(), F.col("w.project")).otherwise(name),
        "via": F.when(~placed, "none").when(F.col("w").isNotNull(), "wall").when(F.col("r").isNotNull(), "root").otherwise("folder"),
        "network": placed & F.when(F.col("w").isNotNull(), ~F.col("w.local_only")).otherwise(~F.col("_walls")),
        "same_provider": F.when(placed & F.col("w").isNotNull(), F.col("w.same_provider")).otherwise(True),
    })
    destination = F.when(~F.col("network"), "local").when(F.col("same_provider"), "same-provider").otherwise("model")
    return out.withColumn("destination", destination).drop("w", "r", "_walls")


def egress(routed: DataFrame, agent_col: str = "agent") -> DataFrame:
    """Files by agent, by project, by destination, and in all."""
    sets = routed.select(F.col(agent_col).alias("agent"), "project", "destination").groupingSets([["agent"], ["project"], ["destination"], []], "agent", "project", "destination")
    return sets.agg(F.grouping_id().cast("long").alias("grouping"), F.count(F.lit(1)).alias("files"))
