"""What a question asks for: time, graph projections, dates, modes and their policies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that make a question one about time.
TIME_WORDS = [
    r"\btoday\b", r"\byesterday\b", r"\bhistory\b", r"\btrend\b", r"\bchange\b", r"\bcompare\b", r"\bversion\b", r"\bactive\b", r"\bvalid\b", r"\beffective\b",
    r"\bbetween\b", r"\bfrom\b", r"\bto\b", r"\bq[1-4]\b", r"\bjanuary\b", r"\bfebruary\b", r"\bmarch\b", r"\bapril\b", r"\bmay\b", r"\bjune\b", r"\bjuly\b",
    r"\baugust\b", r"\bseptember\b", r"\boctober\b", r"\bnovember\b", r"\bdecember\b", r"\b\d{4}-\d{2}-\d{2}\b", r"\b\d{4}\b", r"\bwas\b", r"\bwere\b", r"\bhad\b",
    r"\bonce\b", r"\bold\b",
]
# Signals of the projections that are built when first asked for.
SIGNALS = {
    "entity": [
        r"\bwho\b", r"\bwhom\b", r"\bwhose\b", r"\bperson\b", r"\bpeople\b", r"\bemployee", r"\borganization", r"\bcompany", r"\bcorporation", r"\bentity", r"\bentities",
        r"\bmention", r"\brefers?\s+to", r"\bindividual", r"\bstakeholder", r"\bfounder", r"\bceo\b", r"\bexecutive", r"\bpartner(ship)?\b",
        r"\bemploy(s|er|ee|ing|ment)?\b", r"\bsubject\b", r"\bparty\b", r"\bparties\b",
    ],
    "citation": [
        r"\bcite", r"\bcitation", r"\breference", r"\bbibliography", r"\breferences?\s+section", r"\bsee\s+(§|section|chapter)", r"\bcf\.", r"\bvide\b",
        r"\baccording\s+to", r"\bas\s+mentioned\s+in", r"\bfootnote", r"\bendnote", r"\[\d+\]", r"\([A-Z][a-z]+.*,\s*\d{4}\)", r"\bworks?\s+cited\b", r"\bfurther\s+reading\b",
    ],
    "policy": [
        r"\bpolic(y|ies)\b", r"\bregulat", r"\bregulation", r"\bgovern", r"\bgovernance", r"\bshall\b", r"\bmust\b", r"\bis\s+required\b", r"\bcompliance", r"\bcompliant",
        r"\bmandatory", r"\bobligation", r"\bstandard", r"\bprocedure", r"\bprotocol", r"\bguideline", r"\bpermission", r"\bauthoriz", r"\brestrict", r"\bprohibit",
        r"\brule(s)?\b", r"\blaw(s)?\b", r"\blegal\b", r"\bGDPR", r"\bHIPAA", r"\bSOX\b", r"\bESG\b", r"\bCCPA", r"\bADA\b", r"\bOSHA\b", r"\bEPA\b",
    ],
}
# Projections by when they are built, and what each kind of question adds.
EAGER, LAZY, DEFERRED = ("document",), ("entity", "citation", "policy"), ("fact", "reasoning", "temporal", "version")
POLICY_TYPES, CITATION_TYPES = ("LEGAL", "FINANCIAL", "COMPLIANCE"), ("MULTI_DOCUMENT", "COMPARATIVE")
# How each mode retrieves: depth, strictness of verification, whether to go back, whether to rank hybrid.
POLICIES = {
    "factual": (3, 0.9, False, False), "analytical": (5, 0.7, True, True), "legal": (7, 0.95, True, False), "financial": (5, 0.95, True, True), "code": (10, 0.8, True, True),
}
# Labels that stand before a reference's number.
LABELS = ["§", "Section", "Sec.", "Chapter", "Ch.", "Appendix", "Fig.", "Table", "Figure"]


def any_of(text: Column, patterns: list[str], flags: str = "iUd") -> Column:
    """Some pattern is found in the text, without case; false for null."""
    return F.coalesce(F.rlike(text, F.lit(f"(?{flags}){'|'.join(patterns)}")), F.lit(False))


def projections(text: Column, query_type: Column | None = None, has_hints: Column | None = None) -> dict[str, Column]:
    """Which projections a question needs, by its words, and by its type and hints if a planner gives them."""
    need = {k: any_of(text, p) for k, p in SIGNALS.items()}
    if query_type is not None:
        need["policy"] = need["policy"] | F.coalesce(query_type.isin(*POLICY_TYPES), F.lit(False))
        need["citation"] = need["citation"] | F.coalesce(query_type.isin(*CITATION_TYPES), F.lit(False))
    if has_hints is not None:
        need["entity"] = need["entity"] | F.coalesce(has_hints, F.lit(False))
    return need


def built(mode: Column, projection: Column) -> tuple[Column, Column]:
    """Whether a projection is built at intake, and whether when first asked for."""
    eager = F.when(mode == "eager", projection.isin(*EAGER, *LAZY, *DEFERRED)).otherwise(projection.isin(*EAGER))
    return eager, ~mode.isin("eager", "minimal") & projection.isin(*LAZY)


def policy(mode: Column) -> Column:
    """Struct (max_depth, strictness, backtracking, hybrid) of a mode; an unknown mode is an error."""
    cells = reduce(
        lambda rest, kv: F.when(mode == kv[0], F.struct(*[F.lit(v).alias(n) for v, n in zip(kv[1], ("max_depth", "strictness", "backtracking", "hybrid"), strict=True)])).otherwise(rest),
        POLICIES.items(),
        F.raise_error(F.concat(F.lit("unknown mode: "), mode)).cast("struct<max_depth:int,strictness:double,backtracking:boolean,hybrid:boolean>"),
    )
    return cells


_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def parsed_dates(text: Column, default_year: int = 2025) -> Column:
    """Dates that a question names, in order and once each: days, years that stand alone, months (of the year after them, or
    of the default year) and quarters of the default year. Null text has none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    iso = F.regexp_extract_all(low, F.lit(r"\b(\d{4}-\d{2}-\d{2})\b"), F.lit(1))
    years = F.filter(F.regexp_extract_all(low, F.lit(r"\b(20[23]\d)\b"), F.lit(1)), lambda y: ~F.exists(iso, lambda i: F.contains(i, y)))
    found = [F.transform(iso, lambda x: x.try_cast("date")), F.transform(years, lambda y: F.concat(y, F.lit("-01-01")).try_cast("date"))]
    for k, name in enumerate(_MONTHS, 1):
        word = name if name == "may" else f"(?:{name}|{name[:3]})"
        year = F.nullif(F.regexp_extract(low, rf"\b{word}\s+(20\d{{2}})\b", 1), F.lit(""))
        day = F.concat(F.coalesce(year, F.lit(str(default_year))), F.lit(f"-{k:02}-01")).try_cast("date")
        found.append(F.when(F.rlike(low, F.lit(rf"\b{word}\b")), F.array(day)).otherwise(F.array().cast("array<date>")))
    quarters = F.regexp_extract_all(low, F.lit(r"\bq([1-4])\b"), F.lit(1))
    found.append(F.transform(quarters, lambda q: F.make_date(F.lit(default_year), q.cast("int") * 3 - 2, F.lit(1))))
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(*found))))


def temporal_mode(text: Column, dates: Column, is_temporal_type: Column, about_time: Column) -> Column:
    """TREND, BETWEEN, AS_OF or LATEST; null for a question that isn't about time."""
    low, n = F.lower(text), F.size(dates)
    trend = is_temporal_type & (F.contains(low, F.lit("trend")) | F.contains(low, F.lit("growth")))
    between = (n >= 2) | F.contains(low, F.lit("between"))
    return F.when(trend, "TREND").when(between, "BETWEEN").when(n >= 1, "AS_OF").when(is_temporal_type | about_time, "LATEST")


def answer_mode(text: Column, dates: Column) -> Column:
    """How a question about time is answered: by a trend, by comparing two instants, at an instant, or now."""
    low = F.lower(text)
    has = lambda *ws: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in ws])
    return F.when(has("trend", "growth"), "TREND").when(has("change", "compare", "diff") & (F.size(dates) >= 2), "CHANGE_DETECTION").when(F.size(dates) >= 1, "AS_OF_DATE").otherwise("LATEST")


def reference_key(reference: Column) -> Column:
    """A reference without the label before it, lower-cased: what headings are compared with."""
    low = F.lower(reference)
    cut = reference
    for label in reversed(LABELS):
        cut = F.when(low.startswith(label.lower()), F.trim(F.substring(reference, len(label) + 1, 1 << 20))).otherwise(cut)
    return F.lower(F.trim(cut))
