"""Parent-child links to whole hierarchies, by tree contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from strataleaf.functions.ids import norm_id
from strataleaf.session import drop, materialise, store


def latest_nodes(nodes: DataFrame, *fields: str) -> DataFrame:
    """(key, *fields) with one row per node, from the row with the latest ingestion_date (tie: the greatest
    by the fields' values in the order given; a null date is the earliest). Null and blank ids are none."""
    best = F.max(F.struct(F.col("ingestion_date").alias("__d"), *fields)).alias("__b")
    keyed = nodes.withColumn("key", norm_id("node_id")).filter("key is not null")
    return keyed.groupBy("key").agg(best).select("key", *[F.col("__b")[f].alias(f) for f in fields])


def hierarchy(links: DataFrame, with_paths: bool = False) -> DataFrame:
    """Root, level and number of descendants of each node of (key, name, parent): (node_id, root_id, level_no,
    n_desc), with ``with_paths`` also path, the names from the root to the node.

    A null parent, or one that is no key, makes a root (level 0). Nodes whose links never reach a root, those
    below a cycle and self-parents included, have root_id ``cycle``, level_no -1, n_desc -1 and a null path.
    An empty table gives no rows. Keys must be distinct; :func:`latest_nodes` makes them so.

    Contraction: each round rakes all leaves into their parents and takes out an independent set of nodes with
    one child (those whose hash is below their parent's and child's), so chains shrink by a third a round and
    the number of rounds is logarithmic in depth. Each removal is recorded with the parent and distance of that
    moment; played backwards the records give root, level, size and path. What no round can remove is a
    cycle's core, shrunk to a node that is its own parent. Counts go map-side to hot parents; the joins that
    give children their parent's values have one row a key on the parents' side, so the runtime skew join
    can split a parent that holds a third of all children."""
    seg = F.array("name").alias("seg") if with_paths else F.lit(None).cast("array<string>").alias("seg")
    keys = links.select(F.col("key").alias("parent"), F.lit(True).alias("known"))
    t = links.join(keys, "parent", "left").select(
        "key", "name", F.when(F.col("known"), F.col("parent")).alias("parent"),
        F.lit(1).cast("long").alias("d"), F.lit(1).cast("long").alias("w"), F.lit(0).cast("long").alias("e"), seg,
    )
    linked = F.col("parent").isNotNull() & (F.col("parent") != F.col("key"))
    t, left = _counted(t.withColumn("act", F.lit("keep")), "tree", linked)
    rounds: list[DataFrame] = []
    while left:
        acted, left = _counted(_contracted(t.select("key", "name", "parent", "d", "w", "e", "seg")), "round", linked & (F.col("act") == "keep"))
        rounds.append(acted)
        t = acted.filter("act = 'keep'")
    done = t.select(
        "key", "name", F.when(F.col("parent").isNull(), F.col("name")).alias("root"),
        F.lit(0).cast("long").alias("level"), F.col("w").alias("size"), F.when(F.col("parent").isNull(), F.col("seg")).alias("path"),
    )
    paths = [store(done, "resolved")]
    # one scan of all tables so far: the plan stays the same size in each round
    resolved = lambda: links.sparkSession.read.schema(done.schema).parquet(*paths)
    for acted in reversed(rounds):
        paths.append(store(_expand(acted, resolved()), "resolved"))
        drop(acted)
    out = resolved()
    rooted = F.col("root").isNotNull()
    cols = [
        F.col("name").alias("node_id"),
        F.coalesce("root", F.lit("cycle")).alias("root_id"),
        F.when(rooted, F.col("level")).otherwise(F.lit(-1).cast("long")).alias("level_no"),
        F.when(rooted, F.col("size") - 1).otherwise(F.lit(-1).cast("long")).alias("n_desc"),
    ]
    return out.select(*cols, *([F.col("path")] if with_paths else []))


def _counted(df: DataFrame, name: str, which: Column) -> tuple[DataFrame, int]:
    """The stored table, and how many of its rows are ``which``, counted as it is written."""
    seen = Observation()
    return materialise(df.observe(seen, F.count_if(which).alias("n")), name), seen.get["n"]


def _contracted(t: DataFrame) -> DataFrame:
    """``t`` with act: ``rake`` (a leaf), ``take`` (unary, chosen) or ``keep``; w has the raked leaves' sizes. Kept nodes under a
    taken one hang on its parent, and u_* is the taken one, to be recorded."""
    linked = F.col("parent").isNotNull() & (F.col("parent") != F.col("key"))
    kids = t.filter(linked).groupBy("parent").agg(F.count(F.lit(1)).alias("kids"), F.max("key").alias("child"))
    j = t.join(kids.withColumnRenamed("parent", "key"), "key", "left")
    leaf = linked & F.col("kids").isNull()
    added = j.filter(leaf).groupBy("parent").agg(F.sum(F.col("w") + F.col("e")).alias("added"))
    j = j.join(added.withColumnRenamed("parent", "key"), "key", "left")
    h = lambda c: F.struct(F.xxhash64(c), F.col(c))
    take = linked & (F.col("kids") == 1) & F.col("added").isNull() & (h("key") < h("child")) & (h("key") < h("parent"))
    act = F.when(leaf, "rake").when(take, "take").otherwise("keep")
    j = j.select("key", "name", "parent", "d", (F.col("w") + F.coalesce("added", F.lit(0))).alias("w"), "e", "seg", act.alias("act"))
    u = j.filter("act = 'take'").select(*[F.col(c).alias(f"u_{c}") for c in ("key", "name", "parent", "d", "w", "e", "seg")])
    # a taken node's only child is kept, as of neighbours only one is chosen and a leaf would have been added
    j = j.join(u, F.col("parent") == F.col("u_key"), "left")
    hit = F.col("u_key").isNotNull()
    return j.select(
        "key", "name", F.when(hit, F.col("u_parent")).otherwise(F.col("parent")).alias("parent"),
        (F.col("d") + F.coalesce("u_d", F.lit(0))).alias("d"), "w",
        (F.col("e") + F.coalesce("u_w", F.lit(0)) + F.coalesce("u_e", F.lit(0))).alias("e"),
        F.when(hit, F.concat("u_seg", "seg")).otherwise(F.col("seg")).alias("seg"), "act",
        "u_key", "u_name", "u_parent", "u_d", "u_seg", (F.col("u_w") + F.col("e")).alias("u_base"),
    )


def _expand(acted: DataFrame, resolved: DataFrame) -> DataFrame:
    """What a round removed, resolved by what was left after it."""
    raked = acted.filter("act = 'rake'").select("key", "name", "parent", "d", "seg", F.col("w").alias("size"))
    taken = acted.filter("u_key is not null")
    sizes = resolved.select("key", F.col("size").alias("below"))
    taken = taken.select("key", "u_key", "u_name", "u_parent", "u_d", "u_seg", "u_base").join(sizes, "key")
    taken = taken.select(
        F.col("u_key").alias("key"), F.col("u_name").alias("name"), F.col("u_parent").alias("parent"), F.col("u_d").alias("d"),
        F.col("u_seg").alias("seg"), (F.col("u_base") + F.col("below")).alias("size"),
    )
    up = resolved.select(F.col("key").alias("parent"), "root", F.col("level").alias("up_level"), F.col("path").alias("up_path"))
    return raked.unionByName(taken).join(up, "parent").select(
        "key", "name", "root", (F.col("up_level") + F.col("d")).alias("level"), "size", F.concat("up_path", "seg").alias("path")
    )


def node_hierarchy(nodes: DataFrame, with_paths: bool = False) -> DataFrame:
    """:func:`hierarchy` of apex_ast_nodes: the row with the latest ingestion_date counts, ids compare without
    blanks and case, node_id and root_id are as written in the row that counts."""
    rows = latest_nodes(nodes, "node_id", "parent_id")
    return hierarchy(rows.select("key", F.col("node_id").alias("name"), norm_id("parent_id").alias("parent")), with_paths)


def descendants(paths: DataFrame) -> DataFrame:
    """(ancestor_id, node_id, distance) for each node and each node above it, from rows with paths."""
    above = F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("i", "ancestor_id")
    rows = paths.filter("level_no > 0").select("node_id", "level_no", above)
    return rows.select("ancestor_id", "node_id", (F.col("level_no") - F.col("i")).alias("distance"))
