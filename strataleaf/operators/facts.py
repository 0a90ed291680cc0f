"""Bitemporal facts: reads by validity, states, differences of states, and checks of version chains.

A fact has fact_id, tenant_id, doc_id, subject, predicate, object, confidence, valid_from, valid_to (null: open),
created_at, parent_fact_id and superseded_by. All operators work on all documents at once; a document is
(tenant_id, doc_id). Null validity starts never match a read; empty tables give no rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataleaf.operators.overlap import overlapping

DOC = ("tenant_id", "doc_id")
SUBJECT = (*DOC, "subject")


def instant(t: str | Column) -> Column:
    return F.lit(t).cast("timestamp_ntz") if isinstance(t, str) else t


def valid_at(t: str | Column, start: str = "valid_from", end: str = "valid_to") -> Column:
    """Half-open validity: start <= t < end, a null end is open."""
    return (F.col(start) <= instant(t)) & (F.col(end).isNull() | (F.col(end) > instant(t)))


def valid_between(a: str | Column, b: str | Column, start: str = "valid_from", end: str = "valid_to") -> Column:
    """start <= b (closed) and end > a (open)."""
    return (F.col(start) <= instant(b)) & (F.col(end).isNull() | (F.col(end) > instant(a)))


def in_range_closed(a: str | Column, b: str | Column, start: str = "effective_from", end: str = "effective_to") -> Column:
    """The closed form that node versions use: start <= b and end >= a."""
    return (F.col(start) <= instant(b)) & (F.col(end).isNull() | (F.col(end) >= instant(a)))


def overlaps(from_a: Column, to_a: Column, from_b: Column, to_b: Column) -> Column:
    """from_a <= to_b and to_a > from_b, null ends unbounded, null starts never: not symmetric where they touch."""
    far = F.lit("9999-12-31").cast("timestamp_ntz")
    hit = (from_a <= F.coalesce(to_b, far)) & (F.coalesce(to_a, far) > from_b)
    return F.coalesce(hit & from_a.isNotNull() & from_b.isNotNull(), F.lit(False))


def page(facts: DataFrame, by: tuple[str, ...], limit: int, offset: int = 0, newest: bool = True) -> DataFrame:
    """Per key, ``limit`` facts by created_at after ``offset``, ties by fact_id."""
    order = [F.desc_nulls_last("created_at") if newest else F.asc_nulls_last("created_at"), F.asc("fact_id")]
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return facts.withColumn("position", n).filter((F.col("position") > offset) & (F.col("position") <= offset + limit))


def newest_per_subject(facts: DataFrame) -> DataFrame:
    """One row per subject, the fact created last (tie: the least fact_id; a null created_at is the earliest), with
    version_count: one aggregation, built map-side, so a subject with any number of facts is one row a task."""
    rest = [c for c in facts.columns if c not in SUBJECT]
    ago = F.coalesce(-F.unix_micros(F.col("created_at").cast("timestamp")), F.lit((1 << 63) - 1))
    best = F.min_by(F.struct(*rest), F.struct(ago, "fact_id"))
    return facts.groupBy(*SUBJECT).agg(best.alias("f"), F.count(F.lit(1)).alias("version_count")).select(*SUBJECT, "version_count", "f.*")


def state_at(facts: DataFrame, t: str | Column) -> DataFrame:
    """Per subject the fact valid at ``t`` that was created last."""
    return newest_per_subject(facts.filter(valid_at(t)))


def snapshot(facts: DataFrame, t: str | Column) -> DataFrame:
    """Per subject the ids of the facts valid at ``t``, newest first."""
    key = F.struct(F.unix_micros(F.col("created_at").cast("timestamp")).alias("c"), "fact_id")
    ids = F.transform(F.reverse(F.array_sort(F.collect_list(key))), lambda x: x["fact_id"])
    return facts.filter(valid_at(t)).groupBy(*SUBJECT).agg(ids.alias("fact_ids"))


def delta(facts: DataFrame, a: str | Column, b: str | Column) -> DataFrame:
    """Facts valid at one of two instants only: change ``added`` or ``removed``; ``modified`` if a fact of one id
    has another object or confidence, which facts of one immutable store never have."""
    side = lambda t, x: facts.filter(valid_at(t)).select(*DOC, "fact_id", F.struct("object", "confidence").alias(x))
    both = side(a, "x").join(side(b, "y"), [*DOC, "fact_id"], "full_outer")
    change = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(F.col("x") != F.col("y"), "modified")
    return both.select(*DOC, "fact_id", change.alias("change")).filter("change is not null")


def compare_states(facts: DataFrame, a: str, b: str) -> DataFrame:
    """Per subject how its state differs between two instants: added, removed, changed or same."""
    side = lambda t, x: state_at(facts, t).select(*SUBJECT, F.col("object").alias(x), F.lit(True).alias(f"has_{x}"))
    both = side(a, "before").join(side(b, "after"), list(SUBJECT), "full_outer")
    change = (
        F.when(F.col("has_before").isNull(), "added")
        .when(F.col("has_after").isNull(), "removed")
        .when(~F.col("before").eqNullSafe(F.col("after")), "changed")
        .otherwise("same")
    )
    return both.select(*SUBJECT, "before", "after", change.alias("change"))


def delta_range(facts: DataFrame, instants: list[str]) -> DataFrame:
    """:func:`delta` of each two neighbouring instants, numbered, in one pass: a fact is added in the interval
    that its start falls in and removed in the one its end falls in."""
    parts = []
    for k, (a, b) in enumerate(zip(instants, instants[1:], strict=False), 1):
        at_a, at_b = valid_at(a), valid_at(b)
        parts.append(F.when(at_b & ~at_a, F.struct(F.lit(k).alias("step"), F.lit("added").alias("change"))))
        parts.append(F.when(at_a & ~at_b, F.struct(F.lit(k).alias("step"), F.lit("removed").alias("change"))))
    rows = facts.select(*DOC, "fact_id", F.explode(F.array_compact(F.array(*parts))).alias("x"))
    return rows.select(*DOC, "fact_id", "x.step", "x.change")


def conflicts(facts: DataFrame) -> DataFrame:
    """Pairs of one subject with overlapping validity, the earlier created (tie: lesser id) first: type
    ``VALUE_CONFLICT`` if the objects differ, else ``WINDOW_OVERLAP``. Only facts that nearly overlap meet."""
    cols = ["fact_id", "object", "valid_from", "valid_to", "created_at"]
    j = overlapping(facts, list(SUBJECT), "fact_id", "valid_from", "valid_to", cols)
    turn = F.struct("a_created_at", "a_fact_id") > F.struct("b_created_at", "b_fact_id")
    both = {f"{x}_{c}": F.when(turn, F.col(f"{y}_{c}")).otherwise(F.col(f"{x}_{c}")) for c in cols for x, y in (("a", "b"), ("b", "a"))}
    j = j.select(*SUBJECT, *[v.alias(k) for k, v in both.items()])
    hit = overlaps(F.col("a_valid_from"), F.col("a_valid_to"), F.col("b_valid_from"), F.col("b_valid_to"))
    kind = F.when(F.col("a_object").eqNullSafe(F.col("b_object")), "WINDOW_OVERLAP").otherwise("VALUE_CONFLICT")
    return j.filter(hit).select(*SUBJECT, F.col("a_fact_id"), F.col("b_fact_id"), kind.alias("kind"))


def chain_overlaps(facts: DataFrame) -> DataFrame:
    """Pairs of one subject, in order of valid_from and fact_id, of which the first ends after the second starts
    (null ends never do), without those linked by parent or superseding fact. Only facts that nearly overlap meet."""
    j = overlapping(facts, list(SUBJECT), "fact_id", "valid_from", "valid_to", ["fact_id", "valid_from", "valid_to", "parent_fact_id", "superseded_by"])
    later = F.col("a_valid_to").isNull() | (F.col("a_valid_to") > F.col("b_valid_from"))
    pairs = (("a_superseded_by", "b_fact_id"), ("b_superseded_by", "a_fact_id"), ("a_parent_fact_id", "b_fact_id"), ("b_parent_fact_id", "a_fact_id"))
    linked = reduce(lambda x, y: x | y, [F.coalesce(F.col(p) == F.col(q), F.lit(False)) for p, q in pairs])
    return j.filter(later & ~linked).select(*SUBJECT, "a_fact_id", "b_fact_id")


def broken_links(facts: DataFrame) -> DataFrame:
    """Links to facts that the tenant doesn't have: (tenant_id, fact_id, link, target)."""
    ids = facts.select("tenant_id", F.col("fact_id").alias("target")).distinct()
    links = F.explode(F.array(*[F.struct(F.lit(c).alias("link"), F.col(c).alias("target")) for c in ("parent_fact_id", "superseded_by")]))
    rows = facts.select("tenant_id", "fact_id", links.alias("l")).select("tenant_id", "fact_id", "l.link", "l.target")
    rows = rows.filter(F.col("target").isNotNull() & ~((F.col("link") == "superseded_by") & F.col("target").startswith("__DELETED__")))
    return rows.join(ids, ["tenant_id", "target"], "left_anti").select("tenant_id", "fact_id", "link", "target")


def unexpected_superseders(facts: DataFrame) -> DataFrame:
    """Facts superseded by a fact of another subject."""
    other = facts.select("tenant_id", F.col("fact_id").alias("superseded_by"), F.col("subject").alias("other_subject"))
    hit = facts.join(other, ["tenant_id", "superseded_by"]).filter("other_subject <> subject")
    return hit.select("tenant_id", "fact_id", "superseded_by", "subject", "other_subject")


def chain_orphans(facts: DataFrame) -> DataFrame:
    """Facts of chains of two or more without parent, children and superseding fact."""
    parents = facts.filter("parent_fact_id is not null").select("tenant_id", F.col("parent_fact_id").alias("fact_id")).distinct()
    size = facts.groupBy(*SUBJECT).agg(F.count(F.lit(1)).alias("chain")).filter("chain > 1")
    lone = facts.filter("parent_fact_id is null and superseded_by is null").join(parents, ["tenant_id", "fact_id"], "left_anti")
    return lone.join(size, list(SUBJECT)).select(*SUBJECT, "fact_id", "chain")


def forks(facts: DataFrame) -> DataFrame:
    """Parents with more than one child: (tenant_id, parent_fact_id, children in order of creation)."""
    key = F.struct(F.unix_micros(F.col("created_at").cast("timestamp")).alias("c"), "fact_id")
    kids = F.transform(F.array_sort(F.collect_list(key)), lambda x: x["fact_id"])
    return facts.filter("parent_fact_id is not null").groupBy("tenant_id", "parent_fact_id").agg(kids.alias("children")).filter(F.size("children") > 1)


def version_gaps(facts: DataFrame, version: str = "version_number") -> DataFrame:
    """Facts whose version isn't one more than the version before in order of creation (the first: not 1)."""
    w = Window.partitionBy(*SUBJECT).orderBy(F.asc_nulls_last("created_at"), "fact_id")
    rows = facts.filter(F.col(version).isNotNull()).withColumn("expected", F.coalesce(F.lag(version).over(w) + 1, F.lit(1)))
    return rows.filter(F.col(version) != F.col("expected")).select(*SUBJECT, "fact_id", F.col(version).alias("found"), "expected")


def duplicate_versions(facts: DataFrame, version: str = "version_number") -> DataFrame:
    rows = facts.filter(F.col(version).isNotNull()).groupBy(*SUBJECT, version)
    return rows.agg(F.count(F.lit(1)).alias("n_facts")).filter("n_facts > 1")


def expired_active(facts: DataFrame, now: str) -> DataFrame:
    return facts.filter((F.col("valid_to") < instant(now)) & F.col("superseded_by").isNull())


def fact_issues(facts: DataFrame, methods: tuple[str, ...] = ("regex", "llm", "manual")) -> DataFrame:
    """Single-fact checks as rows (tenant_id, fact_id, check_type): empty required fields, start after end,
    confidence out of [0, 1] or null, unknown extraction method."""
    empty = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    checks = [F.when(empty(c), F.lit(f"MISSING_REQUIRED_FIELDS:{c}")) for c in ("subject", "predicate", "object", "tenant_id", "doc_id")]
    checks.append(F.when(F.col("valid_from") > F.col("valid_to"), F.lit("TEMPORAL_ORDERING")))
    checks.append(F.when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), F.lit("CONFIDENCE_RANGE")))
    checks.append(F.when(~F.coalesce(F.col("extraction_method").isin(*methods), F.lit(False)), F.lit("EXTRACTION_METHOD")))
    return facts.select("tenant_id", "fact_id", F.explode(F.array_compact(F.array(*checks))).alias("check_type"))


def document_issues(facts: DataFrame, methods: tuple[str, ...] = ("regex", "llm", "manual")) -> DataFrame:
    """All checks of a document's facts, counted: (tenant_id, doc_id, check_type, n_issues)."""
    at = facts.select("tenant_id", "fact_id", "doc_id").distinct()
    single = fact_issues(facts, methods).join(at, ["tenant_id", "fact_id"]).select(*DOC, "check_type")
    links = broken_links(facts).join(at, ["tenant_id", "fact_id"]).select(*DOC, F.lit("SUPERSESSION_INTEGRITY").alias("check_type"))
    twice = facts.groupBy(*DOC, "fact_id").count().filter("count > 1").select(*DOC, F.lit("DUPLICATE_FACT_ID").alias("check_type"))
    over = chain_overlaps(facts).select(*DOC, F.lit("VALIDITY_WINDOW_OVERLAP").alias("check_type"))
    rows = reduce(DataFrame.unionByName, [single, links, twice, over])
    return rows.groupBy(*DOC, "check_type").agg(F.count(F.lit(1)).alias("n_issues"))


def chain_summary(facts: DataFrame, version: str = "version_number") -> DataFrame:
    """Per subject: n_facts, n_gaps, n_forks, n_overlaps and whether the chain is healthy (none of them)."""
    base = facts.groupBy(*SUBJECT).agg(F.count(F.lit(1)).alias("n_facts"))
    gaps = version_gaps(facts, version).groupBy(*SUBJECT).agg(F.count(F.lit(1)).alias("n_gaps"))
    split = forks(facts).select("tenant_id", F.col("parent_fact_id").alias("fact_id")).join(facts, ["tenant_id", "fact_id"])
    split = split.groupBy(*SUBJECT).agg(F.count(F.lit(1)).alias("n_forks"))
    over = chain_overlaps(facts).groupBy(*SUBJECT).agg(F.count(F.lit(1)).alias("n_overlaps"))
    out = reduce(lambda a, b: a.join(b, list(SUBJECT), "left"), [base, gaps, split, over])
    names = ("n_gaps", "n_forks", "n_overlaps")
    out = out.select(*SUBJECT, "n_facts", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in names])
    return out.withColumn("healthy", F.col("n_gaps") + F.col("n_forks") + F.col("n_overlaps") == 0)


def related_facts(facts: DataFrame, min_subject: int = 4) -> DataFrame:
    """Per subject name of at least ``min_subject`` characters in a tenant: its facts and documents, the set that a
    fact of that subject is related to besides its own document."""
    rows = facts.filter(F.length("subject") >= min_subject).groupBy("tenant_id", "subject")
    return rows.agg(F.count(F.lit(1)).alias("n_facts"), F.countDistinct("doc_id").alias("n_docs"))


def authoritative(facts: DataFrame) -> DataFrame:
    """Per subject the fact that nothing supersedes with the latest valid_from (ties: created last, then the
    greatest id); subjects of which all facts are superseded have the newest."""
    order = F.struct(F.col("superseded_by").isNull(), "valid_from", "created_at", "fact_id")
    return facts.groupBy(*SUBJECT).agg(F.max_by("fact_id", order).alias("fact_id"))


def tombstone(facts: DataFrame, gone: DataFrame, now: str) -> DataFrame:
    """Rows to append that mark facts (tenant_id, fact_id) as deleted; the facts themselves stay readable."""
    hit = facts.join(gone, ["tenant_id", "fact_id"], "left_semi")
    return hit.select(
        F.concat(F.lit("__DELETED__"), F.sha2("fact_id", 256).substr(1, 16)).alias("fact_id"), "tenant_id", "doc_id", "subject", "predicate",
        F.lit("__DELETED__").alias("object"), "valid_from", instant(now).alias("valid_to"), F.col("fact_id").alias("parent_fact_id"),
    )
