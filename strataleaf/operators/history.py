"""History of changing attributes: type-two dimension from versions, whole or by increments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataleaf.functions.ids import micros
from strataleaf.operators.slices import HOT_ROWS, SLICES, add_slices
from strataleaf.session import materialise


def content_digest(c: str | Column) -> Column:
    """16 bytes that stand for a content; the empty binary stands for null, which equals only null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.unhex(F.md5(c)), F.lit(b""))


def latest_versions(versions: DataFrame, *fields: str) -> DataFrame:
    """One row per version_id with ``fields``, from the row with the latest updated_at.

    Rows without version_id are left out; a null updated_at is the earliest. Where rows of one id tie, the
    greatest by the fields' values, in the order given, is taken, so the choice doesn't depend on row order.
    The maximum is built map-side, so an id that is redelivered any number of times stays one row per task."""
    best = F.max(F.struct(F.col("updated_at").alias("__u"), *fields)).alias("__b")
    return (
        versions.filter(F.col("version_id").isNotNull())
        .groupBy("version_id")
        .agg(best)
        .select("version_id", *[F.col("__b")[f].alias(f) for f in fields])
    )


_FIELDS = ("node_id", "eff", "created", "version_number", "arch", "digest")


def version_rows(versions: DataFrame) -> DataFrame:
    """What the merge reads of node_versions, one row per version_id: (version_id, updated_at, node_id, eff, created, version_number, arch, digest)."""
    return latest_versions(
        versions.select(
            "version_id",
            "updated_at",
            "node_id",
            micros("effective_from").alias("eff"),
            micros("created_at").alias("created"),
            "version_number",
            F.coalesce(F.col("validity_status") == "ARCHIVED", F.lit(False)).alias("arch"),
            content_digest("content").alias("digest"),
        ),
        *_FIELDS,
        "updated_at",
    )


def _periods(rows: DataFrame, hot_rows: int, slices: int) -> DataFrame:
    """Periods of version rows: at each start of a node the version created last counts."""
    last = F.max(F.struct("created", "version_number", "version_id", "arch", "digest")).alias("v")
    rows = rows.filter("node_id is not null and eff is not null").groupBy("node_id", "eff").agg(last)
    return periods_of(rows.select("node_id", "eff", "v.version_id", "v.arch", "v.digest"), hot_rows, slices)


def version_periods(versions: DataFrame, hot_rows: int = HOT_ROWS, slices: int = SLICES) -> DataFrame:
    """Whole history of each node: (node_id, version_id, from_us, to_us, is_current), one row per period.

    Type-two merge of the whole log into an empty dimension: the digest of each version is compared with the one in
    force before it; a changed one closes the running period with its own start and opens the next. Stored
    effective_to and is_current are not read.

    * Several rows of one version_id: the latest updated_at counts.
    * Rows without node_id, version_id or effective_from are left out.
    * Versions of a node with one effective_from: the last created counts (tie: greatest version_number,
      then version_id; a null created_at is the earliest).
    * ``ARCHIVED`` ends the running period and starts none. Equal content prolongs the running period.
    * to_us is -1 (and is_current true) for a period that nothing ends. An empty table gives no rows.
    * Nodes with more than ``hot_rows`` versions are cut into slices along effective_from."""
    return _periods(version_rows(versions), hot_rows, slices)


def periods_of(rows: DataFrame, hot_rows: int = HOT_ROWS, slices: int = SLICES) -> DataFrame:
    """Periods of (node_id, eff, version_id, arch, digest) with one row per node_id and eff."""
    rows = add_slices(rows, "node_id", "eff", hot_rows, slices)
    own, by_slice = Window.partitionBy("node_id", "slice_id").orderBy("eff"), Window.partitionBy("node_id").orderBy("slice_id")
    state = F.struct("arch", "digest")
    tails = (
        rows.filter("hot")
        .groupBy("node_id", "slice_id")
        .agg(F.max_by(state, "eff").alias("tail"))
        .withColumn("carried", F.lag("tail").over(by_slice))
        .select("node_id", "slice_id", "carried")
    )
    rows = rows.withColumn("before", F.lag(state).over(own)).join(tails, ["node_id", "slice_id"], "left")
    rows = rows.withColumn("before", F.coalesce("before", "carried")).drop("carried")
    edges = rows.filter(
        F.col("arch") | F.col("before").isNull() | F.col("before.arch") | (F.col("before.digest") != F.col("digest"))
    )
    heads = (
        edges.filter("hot")
        .groupBy("node_id", "slice_id")
        .agg(F.min("eff").alias("head"))
        .withColumn("next_head", F.lead("head").over(by_slice))
        .select("node_id", "slice_id", "next_head")
    )
    ended = edges.withColumn("next_eff", F.lead("eff").over(own)).join(heads, ["node_id", "slice_id"], "left")
    to_us = F.coalesce("next_eff", "next_head", F.lit(-1).cast("long"))
    return ended.filter(~F.col("arch")).select(
        "node_id", "version_id", F.col("eff").alias("from_us"), to_us.alias("to_us"), (to_us == -1).alias("is_current")
    )


def scd2_merge(dimension: DataFrame | None, batch: DataFrame, hot_rows: int = HOT_ROWS, slices: int = SLICES) -> DataFrame:
    """The dimension after a batch of node_versions rows: what changed is closed, new versions are opened.

    The dimension has a row for each version_id, those included that only prolong a period, lose to another version of
    the same start or have no start: (version_id, updated_at, node_id, eff, created, version_number, arch, digest, to_us). to_us is
    the end of the period that the version starts, -1 if open, null if it starts none. ``None`` is an empty dimension.

    * A batch row that isn't newer than the stored row of its version_id is dropped, else it takes that row's place.
    * Only nodes with such a row are compared again, and of these only what begins with the last period that starts
      before the batch's (or the replaced rows') first start; for a batch in order that is the current version. Late rows
      land between periods that are already closed, late archives too.
    * The result is the same however the log is split into batches; an empty batch changes nothing."""
    new = version_rows(batch)
    order = F.struct("updated_at", *_FIELDS)
    if dimension is None:
        return _with_ends(new, hot_rows, slices)
    stored = dimension.select("version_id", order.alias("__old"))
    new = new.join(stored, "version_id", "left").filter(F.col("__old").isNull() | (order > F.col("__old"))).drop("__old")
    new = materialise(new, "batch")
    ids = new.select("version_id")
    replaced = dimension.join(ids, "version_id", "left_semi").select("node_id", "eff")
    since = new.select("node_id", "eff").unionByName(replaced).filter("node_id is not null and eff is not null")
    since = since.groupBy("node_id").agg(F.min("eff").alias("__since"))
    kept = dimension.join(ids, "version_id", "left_anti").join(since, "node_id", "left")
    begin = kept.filter("eff < __since and to_us is not null").groupBy("node_id").agg(F.max("eff").alias("__begin"))
    kept = kept.join(begin, "node_id", "left")
    again = F.coalesce(F.col("__since").isNotNull() & F.coalesce(F.col("eff") >= F.col("__begin"), F.lit(True)), F.lit(False))
    kept = materialise(kept.withColumn("__again", again).drop("__since", "__begin"), "kept")
    redone = _with_ends(kept.filter("__again").select(*new.columns).unionByName(new), hot_rows, slices)
    return kept.filter("not __again").select(*redone.columns).unionByName(redone)


def _with_ends(rows: DataFrame, hot_rows: int, slices: int) -> DataFrame:
    return rows.join(_periods(rows, hot_rows, slices).select("version_id", "to_us"), "version_id", "left")


def merged_by_year(versions: DataFrame) -> DataFrame:
    """(version_id, from_us, to_us): the log merged into the dimension year by year of updated_at, rows without one first."""
    year = F.coalesce(F.year("updated_at"), F.lit(0))
    dimension = None
    for y in sorted(r[0] for r in versions.select(year.alias("y")).distinct().collect()):
        dimension = materialise(scd2_merge(dimension, versions.filter(year == y)), "dimension")
    if dimension is None:
        dimension = scd2_merge(None, versions)
    return dimension.filter("to_us is not null").select("version_id", F.col("eff").alias("from_us"), "to_us")
