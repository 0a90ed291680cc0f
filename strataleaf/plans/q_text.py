"""Queries over texts: tokens, ranking, extraction, metric literals, masking, vectors."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from strataleaf.operators import extract as X
from strataleaf.operators import search as R
from strataleaf.operators.slices import numbered
from strataleaf.plans.base import Registry
from strataleaf.sources.tables import table

query = Registry()
Q = "certified retention schedule"
_STOP = "('the','is','in','and','to','a','of','for','on','with','as','by')"
_STOPL = "('the','is','in','and','to','a','of','for','on','with','as','by','an','at','it','this')"
_N = "n as (select distinct doc_id, node_id, node_type, content from apex_ast_nodes)"


def nodes(spark, d):
    return table(spark, d, "apex_ast_nodes").select("doc_id", "node_id", "node_type", "content").distinct()


def _tok(c: str, least: int = 1, stop: str = _STOP) -> str:
    return f"[w for w in regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9_]{{{least},}}') if w not in {stop}]"


_SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def re2(pattern: str) -> str:
    """A pattern without word borders as the SQL twins' engine has to be told it: blanks and digits are Unicode's."""
    inside, out = False, ""
    for part in re.findall(r"\\.|[\[\]]|[^\\\[\]]+", pattern):
        inside = part == "[" or (inside and part != "]")
        out += {r"\s": _SPACE if inside else f"[{_SPACE}]", r"\d": r"\p{Nd}"}.get(part, part)
    return out


def unicode_twin(kind: str) -> str:
    pattern, a, b = X.PATTERNS[kind]
    return f"""with m as (select doc_id, regexp_extract_all(text, $r${re2(pattern)}$r$, {a}) a, regexp_extract_all(text, $r${re2(pattern)}$r$, {b}) b from documents)
select doc_id, unnest(range(len(a))) as match_no, unnest(a) as subject, unnest(b) as object from m where len(a) > 0"""


@query("fn12_tokens", f"with {_N} select node_id, array_to_string({_tok('content', 3, _STOPL)}, ' ') as tokens from n")
def fn12(spark, d):
    return nodes(spark, d).select("node_id", F.array_join(R.tokens(F.col("content"), 3, R.STOP_LONG), " ").alias("tokens"))


_SC = f"""with {_N}, t as (select *, {_tok('content', 3, _STOPL)} own, lower(content) low from n),
s as (select *, len(list_intersect(['certified', 'retention', 'schedule'], own)) sh from t),
r as (select doc_id, node_id, case when len(own) = 0 then 0.0 else (case when contains(low, 'certified retention schedule') then 50.0 else 0.0 end) + case when node_type = 'HEADING' then 15.0 * (contains(low, 'certified')::int + contains(low, 'retention')::int + contains(low, 'schedule')::int) else 0.0 end
 + sh * 5.0 + sh / len(own) * 10.0 end score from s)"""


@query("srt08_structural_scores", f"{_SC} select node_id, round(score, 6) as score from r where score > 0")
def srt08(spark, d):
    s = R.structural_score(Q, F.col("content"), F.col("node_type") == "HEADING")
    return nodes(spark, d).select("node_id", F.round(s, 6).alias("score")).filter("score > 0")


@query("srt09_candidates", f"{_SC} select doc_id, node_id, position from (select *, row_number() over (partition by doc_id order by round(score, 6) desc, node_id, score) position from r where score > 0) where position <= 80")
def srt09(spark, d):
    n = nodes(spark, d)
    s = n.withColumn("score", F.round(R.structural_score(Q, F.col("content"), F.col("node_type") == "HEADING"), 6)).filter("score > 0")
    return R.top_k(s, ["doc_id"], 80, F.desc("score"), F.col("node_id")).select("doc_id", "node_id", "position")


@query("srt10_keyword_top", f"""with {_N}, t as (select *, {_tok('content')} own from n), s as (select doc_id, node_id, round(len([w for w in own if w in ('certified', 'retention', 'schedule')]) * (case when node_type = 'HEADING' then 5.0 else 1.0 end) / len(own), 9) score from t where len(own) > 0)
select doc_id, node_id, position from (select *, row_number() over (partition by doc_id order by score desc, node_id) position from s where score > 0) where position <= 5""")
def srt10(spark, d):
    s = nodes(spark, d).withColumn("score", F.round(R.term_score(Q, F.col("content"), F.col("node_type") == "HEADING"), 9)).filter("score > 0")
    return R.top_k(s, ["doc_id"], 5, F.desc("score"), F.col("node_id")).select("doc_id", "node_id", "position")


@query("srt02_ilike_search", "select doc_id, source from documents where text ilike '%retention schedule%'")
def srt02(spark, d):
    return table(spark, d, "documents").filter(F.col("text").ilike("%retention schedule%")).select("doc_id", "source")


_BM = f"""with t as (select doc_id, {_tok('text')} own from documents), c as (select doc_id, len(own) n, len([w for w in own if w = 'certified']) a, len([w for w in own if w = 'retention']) b, len([w for w in own if w = 'schedule']) c from t),
s as (select count(*) docs, avg(n) m, count_if(a > 0) da, count_if(b > 0) db, count_if(c > 0) dc from c)"""
_PART = "ln(1 + (docs - d{0} + 0.5) / (d{0} + 0.5)) * {0} * 2.2 / ({0} + 1.2 * (0.25 + 0.75 * n / m))"


@query("srt01_bm25", f"{_BM} select doc_id, round({' + '.join(_PART.format(x) for x in 'abc')}, 6) as score from c, s where greatest(a, b, c) > 0")
def srt01(spark, d):
    return R.bm25(table(spark, d, "documents"), "doc_id", "text", Q).withColumn("score", F.round("score", 6))


@query("srt04_postings", f"with t as (select doc_id, {_tok('text')} own from documents) select term, count(distinct doc_id) as n_docs, count(*) as n_uses from (select doc_id, unnest(own) term from t) group by 1")
def srt04(spark, d):
    p = R.postings(table(spark, d, "documents"), "doc_id", "text")
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("tf").alias("n_uses"))


@query("srt12_page_index", "select doc_id, term, position from (select doc_id, term, row_number() over (partition by doc_id order by term) position from (select distinct doc_id, content term from apex_ast_nodes where node_type = 'HEADING'))")
def srt12(spark, d):
    h = table(spark, d, "apex_ast_nodes").filter("node_type = 'HEADING'").select("doc_id", F.col("content").alias("term")).distinct()
    return numbered(h, "doc_id", "term")


def _extraction(name: str, kind: str, pattern: str, a: int, b: int) -> None:
    """A query that extracts one kind from all documents; its twin's word borders are ASCII, so kinds that
    begin or end beside letters of other scripts have none and are tested against Python's patterns."""
    sql = None if kind in ("person", "iso_date", "long_date") else f"""with m as (select doc_id, regexp_extract_all(text, $r${pattern}$r$, {a}) a, regexp_extract_all(text, $r${pattern}$r$, {b}) b from documents)
select doc_id, unnest(range(len(a))) as match_no, unnest(a) as subject, unnest(b) as object from m where len(a) > 0"""

    @query(name, sql)
    def run(spark, d):
        return X.matches(table(spark, d, "documents"), "doc_id", "text", kind)


for _name, _kind in (
    ("gen05_people", "person"), ("gen09_regulations", "regulation"), ("gen10_date_ranges", "date_range"), ("gen11_metric_words", "metric_word"),
    ("gen14_cross_references", "cross_reference"), ("gen14_citations", "citation"), ("fn21_currencies", "currency"), ("fn21_percentages", "percentage"),
    ("fn21_quarters", "quarter"), ("fn17_iso_dates", "iso_date"), ("fn16_long_dates", "long_date"),
):
    _extraction(_name, _kind, *X.PATTERNS[_kind])


@query("gen03_policies", unicode_twin("policy"))
def gen03(spark, d):
    return X.matches(table(spark, d, "documents"), "doc_id", "text", "policy")


@query("gen01_all_facts")
def gen01(spark, d):
    return X.all_facts(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


_NEG = " or ".join(f"regexp_matches(lower(content), $r${p}$r$)" for p in X.NEGATIONS)


@query("fn22_negated_nodes", f"with {_N} select node_id, coalesce({_NEG}, false) as negated from n")
def fn22(spark, d):
    return nodes(spark, d).select("node_id", X.negated(F.col("content")).alias("negated"))


def latest_contents(versions):
    """(version_id, content) of the row with the latest updated_at (tie: the greatest content)."""
    best = F.max(F.struct("updated_at", "content"))
    return versions.filter("version_id is not null").groupBy("version_id").agg(best.alias("b")).select("version_id", F.col("b.content").alias("content"))


_LIT = """v as (select version_id, arg_max(content, struct_pack(u := coalesce(updated_at, timestamp '0001-01-01'), c := content)) t from node_versions where version_id is not null group by 1),
x as (select version_id, trim(split_part(t, ' = ', 2)) s from v)"""


_PARSED = rf"""p as (select *, nullif(regexp_extract(s, '^(-?\d+(?:\.\d+)?)\s*%$', 1), '') pc, regexp_extract(s, '^([₹$€£¥])?\s*(-?\d+(?:\.\d+)?)\s*([kKmMbBtTlLcCrR]|Cr|cr|CR)?$', ['g', 'n', 'x']) c,
regexp_extract(s, '^(-?\d+(?:\.\d+)?)\s+(?i:(million|billion|thousand|lakh|crore))$', ['n', 'w']) w from x)"""
_VALUE = f"""round(case when lower(s) in ('', {', '.join(repr(u) for u in X.UNKNOWN)}) then 0.0 when pc is not null then try_cast(pc as double) / 100 when c.n <> '' then try_cast(c.n as double) * coalesce(case when c.g = '₹' then case lower(c.x) when 'l' then 1e5 when 'cr' then 1e7 end end,
case lower(c.x) when 'k' then 1e3 when 'm' then 1e6 when 'b' then 1e9 end, 1.0) when w.n <> '' then try_cast(w.n as double) * case lower(w.w) when 'thousand' then 1e3 when 'million' then 1e6 when 'billion' then 1e9 when 'lakh' then 1e5 else 1e7 end
else coalesce(try_cast(s as double), 0.0) end, 6) as numeric_value,
case when lower(s) in ('', {', '.join(repr(u) for u in X.UNKNOWN)}) then 'UNKNOWN' when pc is not null then 'PERCENTAGE' when c.n <> '' then case when c.g <> '' then 'CURRENCY' else 'NUMERIC' end when w.n <> '' or try_cast(s as double) is not null then 'NUMERIC' else 'UNKNOWN' end as unit"""


@query("fn01_content_metrics", f"with {_LIT}, {_PARSED} select version_id, {_VALUE} from p")
def fn01_contents(spark, d):
    """The value of each version's content of the form name = value; a content of another form has an unknown one."""
    v = latest_contents(table(spark, d, "node_versions")).select("version_id", X.parse_metric(F.split_part("content", F.lit(" = "), F.lit(2))).alias("m"))
    return v.select("version_id", F.round("m.numeric_value", 6).alias("numeric_value"), F.col("m.unit").alias("unit"))


@query("fn01_text_metrics", f"with mm as ({unicode_twin('metric')}), x as (select doc_id, match_no, subject, trim(object) s from mm), {_PARSED} select doc_id, match_no, subject, {_VALUE} from p")
def fn01_texts(spark, d):
    """The value of each metric that gen02_metrics finds."""
    m = X.matches(table(spark, d, "documents"), "doc_id", "text", "metric").withColumn("m", X.parse_metric(F.col("object")))
    return m.select("doc_id", "match_no", "subject", F.round("m.numeric_value", 6).alias("numeric_value"), F.col("m.unit").alias("unit"))


_SCORED = "with q as (select vec_id qid, embedding::double[] q from embeddings where vec_id % 50 = 0), s as (select qid, vec_id, label, round(list_cosine_similarity(embedding::double[], q), 6) score from embeddings, q)"


def asked(spark, d):
    """Every vector whose id is divisible by 50 is a query."""
    e = table(spark, d, "embeddings")
    return e, e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))


@query("srt06_vector_searches", f"{_SCORED} select qid, vec_id, score, position from (select *, row_number() over (partition by qid order by score desc, vec_id) position from s where score >= 0.3) where position <= 5")
def srt06_all(spark, d):
    """The five vectors most like each query vector, at 0.3 or more."""
    return R.nearest(*asked(spark, d), "vec_id", "embedding", 5, 0.3).select("qid", "vec_id", "score", "position")


@query("srt07_documents_by_vectors", f"{_SCORED}, m as (select qid, label, max(score) score from s group by 1, 2) select qid, label, score, position from (select *, row_number() over (partition by qid order by score desc, label) position from m) where position <= 5")
def srt07_all(spark, d):
    """The five labels most like each query vector, by their best vector."""
    return R.nearest(*asked(spark, d), "vec_id", "embedding", 5, by="label").select("qid", "label", "score", "position")


@query("fn10_cosine_to_label_mean", """with d as (select label, i, avg(v::double) m from (select label, unnest(embedding) v, generate_subscripts(embedding, 1) i from embeddings) group by 1, 2), c as (select label, list(m order by i) c from d group by 1)
select vec_id, round(list_cosine_similarity(embedding::double[], c), 6) as score from embeddings join c using (label)""")
def fn10(spark, d):
    e = table(spark, d, "embeddings")
    mean = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    c = mean.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c")).select("label", F.col("c.m").alias("c"))
    return e.join(c, "label").select("vec_id", F.round(R.cosine(F.col("embedding"), F.col("c")), 6).alias("score"))


_FIELDS = "amount|revenue|profit|salary|margin"


@query("fn24_masked_text", rf"select doc_id, md5(regexp_replace(text, '(?i)\b({_FIELDS})\b\s*(?:=|:|\bof\b|\bis\b)?\s*[$€£\w.,%-]+', '\1 = [REDACTED]', 'g')) as digest from documents")
def fn24(spark, d):
    out = F.regexp_replace("text", rf"(?i)\b({_FIELDS})\b\s*(?:=|:|\bof\b|\bis\b)?\s*[$€£\w.,%-]+", "$1 = [REDACTED]")
    return table(spark, d, "documents").select("doc_id", F.md5(out).alias("digest"))






@query("src02_markdown_lines", r"""with l as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) no from documents)
select doc_id, no::bigint as line_no, len(regexp_extract(line, '^(#{1,6}) ', 1)) as level, case when regexp_matches(line, '^#{1,6} ') then 'HEADING' when line like '|%' then 'TABLE' when line like '- %' then 'LIST' else 'PARAGRAPH' end as node_type from l where regexp_matches(line, '[^ ]')""")
def src02(spark, d):
    """Lines of markdown with their kind: the part of the parser that needs no state."""
    l = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line")).filter(F.trim("line") != "")
    kind = F.when(F.rlike("line", F.lit("^#{1,6} ")), "HEADING").when(F.col("line").startswith("|"), "TABLE").when(F.col("line").startswith("- "), "LIST").otherwise("PARAGRAPH")
    return l.select("doc_id", (F.col("no") + 1).cast("long").alias("line_no"), F.length(F.regexp_extract("line", "^(#{1,6}) ", 1)).cast("long").alias("level"), kind.alias("node_type"))


@query("fn26_truncate", "select doc_id, case when length(text) > 200 then left(text, 197) || '...' else text end as short from documents")
def fn26(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.when(F.length(t) > 200, F.concat(F.substring(t, 1, 197), F.lit("..."))).otherwise(t).alias("short"))
