"""Which functions a part of a program hangs on, and which parts could be split (GRAPH-8, GRAPH-11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Endings of names that tell a role, in any case.
ROLES = (
    "Service Services Handler Handlers Repo Repository Repos Manager Managers Controller Controllers Store Stores"
    " Client Clients Reader Writer Factory Factories Agent Bot Engine"
).split()
#: Fixed scores of an exported name: Go upper case, Python without underscore, all others.
EXPORTED, PUBLIC, OTHER = 1.0, 0.5, 0.3
HUB = 3


def anchor_scores(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """GRAPH-8: (node, in_degree, score, anchor) of functions and methods (id, name, kind, file_path).

    The score is the share of the greatest in-degree, 1 for a name that tells a role, and
    the score of an exported name.  Anchors are names of a role that are no getter or
    setter, and upper-case names in Go; a name with a dot is none unless it is a role's
    and has the greatest in-degree, 3 or more.  Calls of a function by itself and of
    others than functions do not count.
    """
    own = nodes.where(F.col("kind").isin("function", "method")).select(F.col("id").alias("node"), "name", F.col("file_path").alias("file"))
    ids = own.select("node").distinct()
    edges = calls.where("source <> target").join(ids.toDF("source"), "source", "left_semi").join(ids.toDF("target"), "target", "left_semi")
    degree = edges.groupBy(F.col("target").alias("node")).agg(F.count("*").alias("in_degree"))
    scored = own.join(degree, "node", "left").na.fill(0, ["in_degree"])
    # One row.
    most = F.broadcast(degree.agg(F.greatest(F.lit(1).cast("long"), F.coalesce(F.max("in_degree"), F.lit(0))).alias("most")))
    role = F.col("name").rlike(rf"(?i)({'|'.join(ROLES)})$")
    go = F.endswith("file", F.lit(".go"))
    upper = go & F.col("name").rlike("^[A-Z]")
    export = F.when(go, F.when(upper, EXPORTED).otherwise(0.0)).when(F.endswith("file", F.lit(".py")), F.when(F.startswith("name", F.lit("_")), 0.0).otherwise(PUBLIC)).otherwise(OTHER)
    dotted, getter = F.contains("name", F.lit(".")), F.col("name").rlike(r"(?i)^(get|set)\w*$")
    facade = role & ~getter & ~dotted
    top = (F.col("in_degree") == F.col("most")) & (F.col("most") >= HUB) & facade
    score = F.col("in_degree") / F.col("most") + role.cast("int") + export
    return scored.crossJoin(most).select("node", "in_degree", F.round(score, 9).alias("score"), (((facade | upper) & ~dotted) | top).alias("anchor"))


def sub_splits(members: DataFrame, owners: DataFrame, calls: DataFrame, least: int = 3, most_cross: float = 0.4) -> DataFrame:
    """GRAPH-11: (community, groups, calls, crossing, ratio, splittable) of communities (node, community).

    Groups are the types (owners: node, owner) with ``least`` methods or more in a
    community.  Of the calls between functions that touch a group, those between two
    groups of the community cross; two groups or more with at most ``most_cross`` of
    crossing calls may be split.
    """
    owned = members.join(owners.where("owner is not null").select("node", "owner"), "node")
    groups = owned.groupBy("community", "owner").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("community", "owner")
    held = owned.join(groups, ["community", "owner"]).select("node", "community", "owner")
    several = groups.groupBy("community").agg(F.count("*").alias("groups"))
    known = owners.select("node").distinct()
    edges = calls.join(known.toDF("source"), "source", "left_semi").join(known.toDF("target"), "target", "left_semi").select("source", "target", F.monotonically_increasing_id().alias("e"))
    # Each call meets the group of either end; one community sees it once.
    side = lambda end: edges.join(held.withColumnRenamed("node", end), end).select("e", "community", "owner")
    seen = side("source").union(side("target")).groupBy("community", "e").agg(F.countDistinct("owner").alias("owners"))
    sums = seen.groupBy("community").agg(F.count("*").alias("calls"), F.count_if(F.col("owners") == 2).alias("crossing"))
    out = members.select("community").distinct().join(several, "community", "left").join(sums, "community", "left").na.fill(0, ["groups", "calls", "crossing"])
    many = F.col("groups") >= 2
    ratio = F.when(many & (F.col("calls") > 0), F.col("crossing") / F.col("calls")).otherwise(0.0)
    return out.withColumn("ratio", F.round(ratio, 9)).withColumn("splittable", many & (F.col("ratio") <= most_cross))
