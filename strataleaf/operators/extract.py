"""Pattern extraction from text, and metric literals."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataleaf.session import spread

_MONTH = "January|February|March|April|May|June|July|August|September|October|November|December"
_FORM = "Corporation|Corp|Inc|LLC|Ltd|PLC|GmbH|SA|NV|AG|Co|Group"
# What the extractors look for, by kind: pattern, and the groups of subject and object.
PATTERNS: dict[str, tuple[str, int, int]] = {
    "regulation": (r"(?i)\b(GDPR|HIPAA|SOX|PCI|DSS|ISO\s*\d+|FASB|IFRS|GAAP|ESG|KYC|AML|CCPA|ADA|OSHA|EPA)\b", 1, 1),
    "person": (r"\b(?:Dr\.|Mr\.|Mrs\.|Ms\.|Prof\.)?\s*([A-Z][a-z]+\s[A-Z][a-z]{1,20})\b", 1, 1),
    "date_range": (r"(?i)(?:from|between)\s+(\d{4}(?:-\d{2}-\d{2})?)\s+(?:to|and|through)\s+(\d{4}(?:-\d{2}-\d{2})?)", 1, 2),
    "policy": (r"(?im)([A-Z][A-Za-z\s]{2,50}?)\s+(?:shall|must|will|should|may|is\s+required\s+to|is\s+responsible\s+for)\s+(.{5,200}?)(?:\.|;|$)", 1, 2),
    "cross_reference": (r"(?i)(?:see|cf\.|refer\s+to|as\s+mentioned\s+in|per|vide)\s+((?:§|Section|Sec\.|Chapter|Ch\.|Appendix|Fig\.|Table|Figure)\s*\d+(?:\.\d+)*)", 1, 1),
    "citation": (r"\(([A-Z][a-zA-Z]+(?:\s+et\s+al\.?)?),\s*(\d{4})\)", 1, 2),
    "metric_word": (r"(?i)\b(Revenue|Profit|Margin|EPS|EBITDA|Net\sIncome|Operating\sIncome|Gross\sMargin|Growth|Cost|Expense|Tax|Dividend|Yield)\b", 1, 1),
    "organization": (rf"\b([A-Z][a-zA-Z]+(?:\s(?!(?:{_FORM})\b)[A-Z][a-zA-Z]+)*)\s+({_FORM})\b", 1, 2),
    "product": (r"\b([A-Z][a-zA-Z]+(?:[A-Z][a-z]+)+|\w*(?:Widget|Tool|System|Platform|Suite|Engine))\b", 1, 1),
    "event": (rf"(?i)(?:on|in|during)\s+(\d{{4}}-\d{{2}}-\d{{2}}|Q[1-4]\s+\d{{4}}|(?:{_MONTH})\s+\d{{1,2}},?\s+\d{{4}})\s*,?\s*(.{{5,150}}?)(?:\.|;|$)", 1, 2),
    "contract_term": (r"(?im)(Term|Duration|Period|Payment|Notice|Cancellation)\s*[:=]?\s*(.{5,100}?)(?:\.|;|$)", 1, 2),
    "metric": (r"(?i)([A-Za-z\s]{2,40}?)\s*(?:is|was|were|:|=)\s*([₹$€£¥]?\s*[\d,]+\.?\d*\s*[kKmMbBtT%]?)", 1, 2),
    "currency": (r"\$[\d,]+(?:\.\d+)?", 0, 0),
    "percentage": (r"\d+\.?\d*\%", 0, 0),
    "quarter": (r"(?i)\b(Q[1-4])\b", 1, 1),
    "iso_date": (r"\b(\d{4}-\d{2}-\d{2})\b", 1, 1),
    "long_date": (rf"\b(\d{{1,2}}\s+(?:{_MONTH})\s+\d{{4}})\b", 1, 1),
}
# Words that deny.
NEGATIONS = [
    r"\bnot\b", r"\bno longer\b", r"\bwas repealed\b", r"\bhas been revised\b", r"\bwas rescinded\b", r"\bhas been overturned\b",
    r"\bis no longer valid\b", r"\bis hereby\s+(?:revoked|cancelled|terminated)\b", r"\bcontradict(?:s|ed)?\b", r"\binstead\b", r"\bhowever\b",
]


def matches(rows: DataFrame, key: str, text: str, kind: str) -> DataFrame:
    """(key, match_no, subject, object) of each match in order; null texts have none. Letters, digits and blanks
    are Unicode's, as in the patterns' own dialect."""
    pattern, a, b = PATTERNS[kind]
    pattern = f"(?Ud){pattern}"  # Unicode's classes; only \n ends a line
    get = lambda g: F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(g))
    pairs = rows.select(key, F.posexplode(F.arrays_zip(get(a).alias("a"), get(b).alias("b"))).alias("match_no", "m"))
    return pairs.select(key, F.col("match_no").cast("long").alias("match_no"), F.col("m.a").alias("subject"), F.col("m.b").alias("object"))


def all_facts(rows: DataFrame, key: str, text: str, kinds: tuple[str, ...] = tuple(PATTERNS)) -> DataFrame:
    """Matches of several kinds, (key, match_no, subject, object, kind, fact_id), in one scan of the texts. Ids are made from
    what is matched, so that a repeated run appends the same facts. Null texts have none."""
    schema = T.StructType([rows.schema[key], *T._parse_datatype_string("match_no long, subject string, object string, kind string").fields])
    arrow = pa.schema([("match_no", pa.int64()), ("subject", pa.string()), ("object", pa.string()), ("kind", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(k, re.compile(PATTERNS[k][0]), *PATTERNS[k][1:]) for k in kinds]
        for b in batches:
            at, out = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for kind, pattern, x, y in compiled if t else ():
                    found = [(no, m.group(x), m.group(y), kind) for no, m in enumerate(pattern.finditer(t))]
                    out += found
                    at += [i] * len(found)
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            found = [pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), *found], names=[key, *arrow.names])

    out = spread(rows.select(key, text)).mapInArrow(run, schema)
    return out.withColumn("fact_id", F.sha2(F.concat_ws("|", F.col(key).cast("string"), "kind", F.col("match_no").cast("string"), "subject", "object"), 256))


def negated(text: Column) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [F.rlike(F.lower(text), F.lit(p)) for p in NEGATIONS]), F.lit(False))


# Multipliers of suffixes and words, and literals that stand for an unknown value.
SUFFIX = {"k": 1e3, "K": 1e3, "m": 1e6, "M": 1e6, "b": 1e9, "B": 1e9}
INDIAN = {"l": 1e5, "L": 1e5, "cr": 1e7, "Cr": 1e7, "CR": 1e7}
WORD = {"thousand": 1e3, "million": 1e6, "billion": 1e9, "lakh": 1e5, "crore": 1e7}
UNKNOWN = ["n/a", "na", "unknown", "not available", "none", "null", "tbd", "t.b.d.", "not applicable"]
_NUMBER = r"(-?\d+(?:\.\d+)?)"


def _pick(values: dict[str, float], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def multiplier(suffix: Column, indian: Column) -> Column:
    """What a suffix multiplies by; lakh and crore only where amounts are Indian, 1 for any other suffix."""
    return F.coalesce(F.when(indian, _pick(INDIAN, suffix)), _pick(SUFFIX, suffix), F.lit(1.0))


def parse_metric(value: Column) -> Column:
    """Struct (numeric_value, unit, confidence) of a literal such as ₹1.5Cr, 35%, 5 million or 42.

    In order: blank or unknown words (0, UNKNOWN, 0); per cent; a number with an optional currency sign and suffix
    (suffixes without a multiplier count once, l and cr only after ₹); a number and a word; any other number
    (confidence 0.9); else UNKNOWN."""
    s = F.trim(F.coalesce(value, F.lit("")))
    look = lambda pattern, g: F.nullif(F.regexp_extract(s, pattern, g), F.lit(""))
    pct = look(rf"^\s*{_NUMBER}\s*%\s*$", 1)
    cur = r"^\s*([₹$€£¥])?\s*" + _NUMBER + r"\s*([kKmMbBtTlLcCrR]|Cr|cr|CR)?\s*$"
    sign, number, suffix = look(cur, 1), look(cur, 2), look(cur, 3)
    word = rf"(?i)^\s*{_NUMBER}\s+(million|billion|thousand|lakh|crore)\s*$"
    times = multiplier(suffix, sign == "₹")
    unit = F.when(sign.isNotNull(), "CURRENCY").otherwise("NUMERIC")
    made = lambda v, u, c: F.struct(v.alias("numeric_value"), u.alias("unit"), F.lit(c).alias("confidence"))
    zero = made(F.lit(0.0), F.lit("UNKNOWN"), 0.0)
    return (
        F.when(F.lower(s).isin("", *UNKNOWN), zero)
        .when(pct.isNotNull(), made(pct.try_cast("double") / 100, F.lit("PERCENTAGE"), 1.0))
        .when(number.isNotNull(), made(number.try_cast("double") * times, unit, 1.0))
        .when(look(word, 1).isNotNull(), made(look(word, 1).try_cast("double") * _pick(WORD, F.lower(look(word, 2))), F.lit("NUMERIC"), 1.0))
        .when(s.try_cast("double").isNotNull(), made(s.try_cast("double"), F.lit("NUMERIC"), 0.9))
        .otherwise(zero)
    )


_SHORT = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
# Kinds of dates in the order in which they are tried: pattern, and the groups of year, month and day.
DATES: dict[str, tuple[str, int, int, int]] = {
    "iso": (r"\b(\d{4})-(\d{2})-(\d{2})\b", 1, 2, 3),
    "us_long": (rf"(?i)\b({_MONTH})\s+(\d{{1,2}}),\s*(\d{{4}})\b", 3, 1, 2),
    "us_short": (rf"(?i)\b({_SHORT})\s+(\d{{1,2}}),\s*(\d{{4}})\b", 3, 1, 2),
    "dd_month_yyyy": (rf"(?i)\b(\d{{1,2}})\s+({_MONTH})\s+(\d{{4}})\b", 3, 2, 1),
    "month_yyyy": (rf"(?i)\b({_MONTH})\s+(\d{{4}})\b", 2, 1, 0),
    "quarter": (r"(?i)\bQ([1-4])\s*(?:FY)?(\d{4})\b", 2, 1, 0),
    "year_only": (r"\b(19\d{2}|20\d{2})\b", 1, 0, 0),
    "european": (r"\b(\d{2})[-/](\d{2})[-/](\d{4})\b", 3, 2, 1),
}


def first_date(text: Column, chars: int = 500) -> Column:
    """The date of the first kind in :data:`DATES` whose first match in the first ``chars`` characters is one; of a day that
    its month hasn't, a month in words gives the first. Quarters and years give their first day; dd-mm goes before mm-dd."""
    window = F.substring(text, 1, chars)

    def day(y: Column, m: Column, d: Column) -> Column:
        return F.when(y.try_cast("int") > 0, F.concat_ws("-", y, m, d).try_cast("date"))

    found = []
    for kind, (pattern, *groups) in DATES.items():
        y, m, d = (F.regexp_extract(window, f"(?U){pattern}", g) if g else F.lit("01") for g in groups)
        if kind == "quarter":
            m = (m.try_cast("int") * 3 - 2).cast("string")
        if "month" in kind or kind.startswith("us_"):
            m = F.lpad(((F.position(F.substring(F.lower(m), 1, 3), F.lit("janfebmaraprmayjunjulaugsepoctnovdec")) + 2) / 3).cast("int").cast("string"), 2, "0")
            y = F.when(y.try_cast("int").between(1900, 2099), y)
            found += [F.when(y.isNotNull(), F.coalesce(day(y, m, d), day(y, m, F.lit("01"))))]
        else:
            found += [day(y, m, d)]
        if kind == "european":
            found += [day(y, d, m)]
    return F.coalesce(*found)


def fingerprint(text: Column, size: int = 384) -> Column:
    """A deterministic vector: eight hex digits at a time of sha256(text:counter), scaled to [-1, 1)."""
    blocks = F.transform(F.sequence(F.lit(0), F.lit((size + 7) // 8 - 1)), lambda i: F.sha2(F.concat(text, F.lit(":"), i.cast("string")), 256))
    parts = F.flatten(F.transform(blocks, lambda h: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.conv(F.substring(h, k * 8 + 1, F.lit(8)), 16, 10).cast("double"))))
    return F.slice(F.transform(parts, lambda v: v / 4294967296.0 * 2 - 1), 1, size)
