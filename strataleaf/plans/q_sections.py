"""Queries over parsed texts: sections, chunks, code, embeddings by batches, and ranking and walking of document trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataleaf.functions.embed import embedded_texts
from strataleaf.functions.ids import norm_id
from strataleaf.operators import learned, sinks
from strataleaf.operators import navigation as N
from strataleaf.operators import routes as R2
from strataleaf.operators import search as R
from strataleaf.operators.hierarchy import latest_nodes
from strataleaf.plans import pipeline
from strataleaf.plans.base import Registry
from strataleaf.plans.q_more import _NAV
from strataleaf.plans.q_routes import DATES, QUESTIONS, questions, texts
from strataleaf.plans.q_text import _STOPL, Q, _tok
from strataleaf.session import new_path
from strataleaf.sources import code, files
from strataleaf.sources.chunks import greedy_chunks
from strataleaf.sources.markdown import section_paths
from strataleaf.sources.tables import table

query = Registry()


def nodes(spark, d):
    return table(spark, d, "apex_ast_nodes")


@query("src03_chunks", """with recursive n as (select distinct node_id, content, string_split(content, chr(10) || chr(10)) p from apex_ast_nodes where length(content) > 3000),
w as (select node_id, content, p, 1 i, 0::bigint chunk, length(p[1])::bigint size, length(p[1])::bigint chars from n union all
select node_id, content, p, i + 1, case when size + length(p[i + 1]) > 3000 then chunk + 1 else chunk end, case when size + length(p[i + 1]) > 3000 then length(p[i + 1]) else size + length(p[i + 1]) end,
case when size + length(p[i + 1]) > 3000 then length(p[i + 1]) else chars + 2 + length(p[i + 1]) end from w where i < len(p))
select node_id, md5(content) as digest, chunk as chunk_no, max(chars) as n_chars from w group by 1, 2, 3""")
def src03(spark, d):
    """Contents over 3000 characters, filled greedily with paragraphs; joiners don't count, a longer paragraph stays whole."""
    n = nodes(spark, d).select("node_id", "content").distinct().filter(F.length("content") > 3000)
    rows = n.select("node_id", F.md5("content").alias("digest"), F.posexplode(greedy_chunks(F.col("content"))).alias("chunk_no", "c"))
    return rows.select("node_id", "digest", F.col("chunk_no").cast("long").alias("chunk_no"), F.length("c").cast("long").alias("n_chars"))


_HEAD = r"""l as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) no from documents),
f as (select *, regexp_matches(line, '^`{3,}\s*\w*\s*$') fence from l), g as (select *, sum(fence::int) over (partition by doc_id order by no) k, sum(fence::int) over (partition by doc_id) a from f),
h as (select doc_id, no, length(regexp_extract(line, '^(#{1,6})\s+(.*)$', 1)) lv, trim(regexp_extract(line, '^(#{1,6})\s+(.*)$', 2), ' ' || chr(13) || chr(9)) title from g where regexp_matches(line, '^(#{1,6})\s+(.*)$') and not (k <= a - a % 2 and (fence or k % 2 = 1))),
p as (select *, (select max(b.no) from h b where b.doc_id = h.doc_id and b.no < h.no and b.lv < h.lv) parent from h),
o as (select *, row_number() over (partition by doc_id, parent order by no) pos from p where title <> '')"""


@query("src13_sections", f"with recursive {_HEAD}, w as (select doc_id, no, title, pos::varchar path from o where parent is null union all select o.doc_id, o.no, o.title, w.path || '.' || o.pos from o join w on w.doc_id = o.doc_id and w.no = o.parent) select doc_id, no::bigint as line_no, title, path from w")
def src13(spark, d):
    """Headings with their dotted paths."""
    return section_paths(table(spark, d, "documents")).select("doc_id", F.col("node_no").cast("long").alias("line_no"), F.col("content").alias("title"), "path")


@query("flt04_subtree_by_path", f"with recursive {_HEAD}, w as (select doc_id, no, pos::varchar path from o where parent is null union all select o.doc_id, o.no, w.path || '.' || o.pos from o join w on w.doc_id = o.doc_id and w.no = o.parent) select doc_id, no::bigint as line_no, row_number() over (partition by doc_id order by path) as position from w where starts_with(path, '1.1')")
def flt04(spark, d):
    """Sections whose path begins with 1.1, in the order of paths as texts: 1.10 is one of them, as the operator has it."""
    p = section_paths(table(spark, d, "documents")).filter(F.col("path").startswith("1.1"))
    return R.top_k(p, ["doc_id"], 1 << 62, F.col("path")).select("doc_id", F.col("node_no").cast("long").alias("line_no"), "position")


_CODE = r"""l as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) no from documents),
s as (select doc_id, no, 'function' kind, regexp_extract(line, '^\s*def\s+(\w+)\s*\(', 1) n from l union all select doc_id, no, 'class', regexp_extract(line, '^\s*class\s+(\w+)(?:\((\w+)\))?:', 1) from l)"""


@query("src11_python_symbols", f"with {_CODE} select doc_id, kind, n as name, count(*) as n_uses from s where n <> '' group by 1, 2, 3")
def src11(spark, d):
    """Functions and classes that documents define in Python."""
    files = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.lit("python").alias("language"), F.col("text").alias("code"))
    return code.symbols(files).groupBy(F.col("path").alias("doc_id"), "kind", "name").agg(F.count(F.lit(1)).alias("n_uses"))


@query("src12_symbol_edges", f"with {_CODE}, r as (select doc_id, row_number() over (partition by doc_id order by kind desc, no) no from s where n <> '') select doc_id, no as source, no + 1 as target from r where (doc_id, no + 1) in (select doc_id, no from r)")
def src12(spark, d):
    """Neighbouring symbols of a text."""
    files = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.lit("python").alias("language"), F.col("text").alias("code"))
    e = code.symbol_edges(code.symbols(files)).filter("edge_type = 'SUCCESSOR'")
    return e.select(F.col("path").alias("doc_id"), F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("target"))


_FINGER = """p as (select k, c, ('0x' || substr(h, (8 * p + 1)::bigint, 8))::bigint v, c * 8 + p dim from (select k, c, sha256(t || ':' || c) h from (select *, unnest(range(48)) c from x)), (select unnest(range(8)) p))"""
_SUMS = "select k as {0}, sum((dim + 1) * v)::bigint as checksum, round(max(case when dim = 0 then v end) / 4294967296.0 * 2 - 1, 9) as v0, round(max(case when dim = 383 then v end) / 4294967296.0 * 2 - 1, 9) as v383 from p group by 1"


def _sums(vectors: DataFrame, key: str) -> DataFrame:
    """All 384 values in one checksum, and the first and last."""
    whole = F.transform("v", lambda x, i: (i + 1).cast("long") * F.round((x + 1) / 2 * 4294967296.0).cast("long"))
    total = F.aggregate(whole, F.lit(0).cast("long"), lambda a, x: a + x)
    return vectors.select(key, total.alias("checksum"), F.round(F.get("v", 0), 9).alias("v0"), F.round(F.get("v", 383), 9).alias("v383"))


@query("src16_fingerprints", f"with x as (select doc_id k, coalesce(text, '') t from documents), {_FINGER} {_SUMS.format('doc_id')}")
def src16(spark, d):
    from strataleaf.operators.extract import fingerprint

    v = fingerprint(F.coalesce("text", F.lit("")))
    return _sums(table(spark, d, "documents").select("doc_id", v.alias("v")), "doc_id")


@query("src17_embedded_nodes", f"with x as (select distinct md5(content) k, content t from apex_ast_nodes where content is not null), {_FINGER} {_SUMS.format('digest')}")
def src17(spark, d):
    """Each content once, in batches, by the encoder that is plugged in: by default the fingerprint."""
    n = nodes(spark, d).filter("content is not null").select(F.md5("content").alias("digest"), "content").distinct()
    return _sums(embedded_texts(n, "digest", "content"), "digest")


_LEAF = f"""x as (select lower(trim(node_id, ' ')) k, arg_max(struct_pack(c := content, d := doc_id, e := embedding), struct_pack(a := epoch_us(ingestion_date), b := content, d := doc_id)) v from apex_ast_nodes where trim(node_id, ' ') <> '' group by 1),
pa as (select distinct lower(trim(parent_id, ' ')) k from apex_ast_nodes where trim(parent_id, ' ') <> ''), lf as (select k, v.c c, v.d doc, lower(v.c) low, v.e e from x where k not in (from pa) and v.c <> ''),
sc as (select *, case when len(e) = 4 then list_cosine_similarity(e, [0.5, 0.5, 0.5, 0.5]::double[]) else 0 end vs, (select sum(3.0 * contains(split_part(low, chr(10), 1), w)::int + 0.5 * (len(low) - len(replace(low, w, ''))) / len(w)) from unnest(['certified', 'retention', 'schedule']) q(w)) ks,
1.0 - (row_number() over (partition by doc order by k) - 1) / count(*) over (partition by doc) ss from lf),
nm as (select k, doc, coalesce(vs / nullif(max(vs) over w, 0), vs) vs, coalesce(ks / nullif(max(ks) over w, 0), ks) ks, coalesce(ss / nullif(max(ss) over w, 0), ss) ss from sc window w as (partition by doc))"""


@query("srt05_hybrid_rank", f"with {_LEAF} select k as node_id, round(0.4 * vs + 0.3 * ks + 0.3 * ss, 6) as score from nm where round(0.4 * vs + 0.3 * ks + 0.3 * ss, 6) > 0")
def srt05(spark, d):
    """Leaves of each document by vector, words and place, each over its greatest in the document: .4, .3, .3."""
    n = latest_nodes(nodes(spark, d), "content", "doc_id", "embedding")
    inner = nodes(spark, d).select(norm_id("parent_id").alias("key")).filter("key is not null").distinct()
    leaves = n.join(inner, "key", "left_anti").filter("content <> ''")
    s = N.hybrid_scores(leaves, "doc_id", "key", Q, [0.5, 0.5, 0.5, 0.5])
    return s.select(F.col("key").alias("node_id"), F.round("score", 6).alias("score")).filter("score > 0")


@query("srt15_find_global", f"""{_NAV}, t as (select doc_id, {_tok("split_part(text, chr(10), 1)")} own from documents), y as (select distinct doc_id, unnest(own) term from t), z as (select item_id, doc_id, count(*) c from q join y using (term) group by 1, 2),
b as (select item_id, doc_id, 0 rk from (select *, row_number() over (partition by item_id order by c desc, doc_id) k from z) where k = 1), u as (select item_id, doc_id, min(rk) rk from (select * from b union all select item_id, doc_id, position from r where position <= 5) group by 1, 2)
select item_id, doc_id, row_number() over (partition by item_id order by rk) as position from u""")
def srt15(spark, d):
    """Where each question is looked for in turn: the document that is chosen by its title, then the five that the index finds."""
    questions, docs = table(spark, d, "eval_items"), table(spark, d, "documents")
    return N.candidates(questions, docs, 5).select("item_id", "doc_id", "position")


_WALK = f"""x as (select lower(trim(node_id, ' ')) k, arg_max(struct_pack(c := content, p := parent_id, t := node_type), struct_pack(a := epoch_us(ingestion_date), b := content, c := parent_id, d := node_type)) v from apex_ast_nodes where trim(node_id, ' ') <> '' group by 1),
n as (select k, v.c content, nullif(lower(trim(v.p, ' ')), '') p, v.t node_type from x), tk as (select *, {_tok('content', 3, _STOPL)} own, lower(content) low from n),
sc as (select *, case when len(own) = 0 then 0.0 else (case when contains(low, 'certified retention schedule') then 50.0 else 0.0 end) + case when node_type = 'HEADING' then 15.0 * (contains(low, 'certified')::int + contains(low, 'retention')::int + contains(low, 'schedule')::int) else 0.0 end
 + len(list_intersect(['certified', 'retention', 'schedule'], own)) * 5.0 + len(list_intersect(['certified', 'retention', 'schedule'], own)) / len(own) * 10.0 end score from tk),
ch as (select p, k, content, row_number() over (partition by p order by round(score, 6) desc, k) r from sc where p is not null and score > 0), inn as (select distinct p from n where p is not null),
ro as (select k, content from n where p is null or p not in (select k from n)),
w as (select k root, k, content, ''::varchar path, 0 depth from ro union all select w.root, ch.k, ch.content, w.path || ch.r, w.depth + 1 from w join ch on ch.p = w.k where ch.r <= 2 and w.depth < 10),
e as (select w.root, w.k, w.path, contains(lower(w.content), 'retention') hit from w where w.k not in (from inn) or w.k not in (select p from ch)),
s as (select *, sum((not (hit and k not in (from inn)))::int) over (partition by root order by path rows between unbounded preceding and 1 preceding) fails from e), f as (select * from s where hit and k not in (from inn) and coalesce(fails, 0) <= 15)"""


@query("qry04_walks", f"with recursive {_WALK} select root as root_id, k as node_id, coalesce(fails, 0) as n_back from (select *, row_number() over (partition by root order by path) r from f) where r = 1")
def qry04(spark, d):
    """From each root down to a leaf that answers the question: at each node the best child, then the second, going back from dead ends
    within the budget."""
    n = latest_nodes(nodes(spark, d), "content", "parent_id", "node_type").select("key", "content", norm_id("parent_id").alias("parent"), "node_type")
    score = F.round(R.structural_score(Q, F.col("content"), F.col("node_type") == "HEADING"), 6)
    verified = F.contains(F.lower("content"), F.lit("retention"))
    return N.walk(n.withColumn("score", score).withColumn("verified", verified)).select("root_id", "node_id", "n_back")


@query("fn27_answer_f1", f"""{_NAV}, a as (select item_id, left(min_by(text, position), 120) ans from r join documents using (doc_id) where position <= 5 group by 1),
xx as (select item_id, [w for w in regexp_split_to_array(trim(regexp_replace(regexp_replace(lower(ans), '[^\\w\\s]', '', 'g'), '\\b(a|an|the)\\b', ' ', 'g')), '\\s+') if w <> ''] p, [w for w in regexp_split_to_array(trim(regexp_replace(regexp_replace(lower(ground_truth), '[^\\w\\s]', '', 'g'), '\\b(a|an|the)\\b', ' ', 'g')), '\\s+') if w <> ''] t from a join eval_items using (item_id)),
y as (select item_id, len(p) np, len(t) nt, coalesce(list_sum([least(len([u for u in p if u = w]), len([u for u in t if u = w])) for w in list_distinct(p)]), 0) s from xx) select item_id, round(case when s > 0 then 2.0 * s / (np + nt) else 0 end, 6) as f1 from y""")
def fn27(spark, d):
    """Answers against the ground truth, by the words they share."""
    from strataleaf.operators.stats import token_f1

    items = table(spark, d, "eval_items")
    a = pipeline.answers(items, table(spark, d, "documents")).join(items.select("item_id", "ground_truth"), "item_id")
    return a.select("item_id", F.round(token_f1(F.col("answer"), F.col("ground_truth")), 6).alias("f1"))


@query("qry02_integrated_answers", f"""{_NAV}, a as (select item_id, doc_id, position, score, round(0.4 * (1 - score / max(score) over (partition by item_id)) + 0.35 * (not contains(lower(text), 'retention'))::int + 0.25 * least(1.0, position / 5), 6) nc, text from r join documents using (doc_id) where position <= 5),
c as (select item_id, list_sort(list(nc)) s, count(*) n from a group by 1), k as (select item_id, case when n < 3 then 1.0 else s[greatest(least(ceil((n + 1) * (1.0 - (1.0 - 0.6)))::bigint, n), 1)] end t from c),
z as (select a.*, nc <= t kept from a join k using (item_id)) select item_id, count_if(kept) as n_kept, count(*) as n_found, min_by(doc_id, position) filter (kept) as doc_id, left(min_by(text, position) filter (kept), 120) as answer from z group by 1""")
def qry02(spark, d):
    """Retrieval, nonconformity of what was found, a threshold calibrated on the same packets, and an answer from what is kept."""
    return N.integrated(table(spark, d, "eval_items"), table(spark, d, "documents"), "retention")


@query("qry09_coverage")
def qry09(spark, d):
    """The seeded simulation of coverage with a threshold calibrated on the questions' best scores."""
    return N.simulated_coverage(spark, [k / 100 for k in range(1, 101)])


@query("src01_parsed_files", """select doc_id::varchar as name, case doc_id % 3 when 0 then 'markdown' when 1 then 'markdown' else 'python' end as kind, md5(text) as digest from documents where text <> ''""")
def src01(spark, d):
    """Documents as files, read back by what their names tell."""
    folder = new_path(spark, "files")
    ending = F.element_at(F.array(F.lit(".md"), F.lit(".unknown"), F.lit(".py")), (F.col("doc_id") % 3 + 1).cast("int"))
    docs = table(spark, d, "documents")
    sinks.write_files(docs.select(F.concat(F.col("doc_id").cast("string"), ending).alias("name"), F.col("text").alias("content")), folder)
    back = files.read_texts(spark, folder)
    return back.select(F.regexp_extract("path", r"([^/.]+)\.[a-z]+$", 1).alias("name"), "kind", F.md5("text").alias("digest"))


@query("src06_image_files", """select 'Scan ' || doc_id as title, 'data:image/png;base64,' || to_base64(('PNG' || doc_id)::blob) as data_uri from documents""")
def src06(spark, d):
    """Image files as data URIs with titles from their names, one for each document."""
    folder = new_path(spark, "images")
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("k"))
    sinks.write_files(docs.select(F.concat(F.lit("scan_"), "k", F.lit(".png")).alias("name"), F.concat(F.lit("PNG"), "k").alias("content")), folder)
    return files.read_binary(spark, folder).select("title", "data_uri")


_RANGE = """u as (select id, ds[1] d1, ds[2] d2, len(ds) n from dt), v as (select version_id, node_id, min(effective_from) f, max(coalesce(effective_to, timestamp '9999-12-31')) e from node_versions where effective_from is not null group by 1, 2)
select id, case when n >= 2 then 'range' when n = 1 then 'as_of' else 'latest' end as kind, case when n >= 2 then (select count(*) from v where f <= d2 and e >= d1) when n = 1 then (select count(*) from v where f <= d1 and e > d1) else (select count(distinct node_id) from node_versions where is_current) end as n_versions from u"""


@query("qry07_answers", f"with {QUESTIONS}, {DATES}, {_RANGE}")
def qry07(spark, d):
    """What a question about one instant, a range or now is answered from: versions in force, in the closed range, or current nodes."""
    q = questions(spark, d).select("id", R2.parsed_dates(F.col("text")).alias("ds"))
    q = q.select("id", F.get("ds", 0).alias("d1"), F.when(F.size("ds") >= 2, F.get("ds", 1)).alias("d2"))
    far = F.lit("9999-12-31").cast("timestamp_ntz")
    v = table(spark, d, "node_versions").filter("effective_from is not null").groupBy("version_id", "node_id")
    v = v.agg(F.min("effective_from").alias("f"), F.max(F.coalesce("effective_to", far)).alias("e"))
    # dates come from the questions, so their number is bounded by these and not by the versions
    asked = q.select("d1", "d2").filter("d1 is not null").distinct()
    hit = v.join(asked, F.when(F.col("d2").isNull(), (F.col("f") <= F.col("d1")) & (F.col("e") > F.col("d1"))).otherwise((F.col("f") <= F.col("d2")) & (F.col("e") >= F.col("d1"))))
    hit = hit.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("c")).withColumnsRenamed({"d1": "x1", "d2": "x2"})
    now = table(spark, d, "node_versions").filter("is_current").agg(F.countDistinct("node_id").alias("n_current"))
    j = q.join(hit, F.col("d1").eqNullSafe(F.col("x1")) & F.col("d2").eqNullSafe(F.col("x2")), "left").crossJoin(F.broadcast(now))  # one row
    kind = F.when(F.col("d2").isNotNull(), "range").when(F.col("d1").isNotNull(), "as_of").otherwise("latest")
    return j.select("id", kind.alias("kind"), F.when(F.col("d1").isNull(), F.col("n_current")).otherwise(F.coalesce("c", F.lit(0).cast("long"))).alias("n_versions"))


@query("qry14_learned_routes")
def qry14(spark, d):
    """Projections that texts need, by a router fitted on a bounded sample of what the word lists say."""
    t = texts(spark, d)
    labelled = t.select("text", *[c.alias(k) for k, c in R2.projections(F.col("text")).items()])
    labels = list(R2.SIGNALS)
    return learned.route(learned.fit(labelled, labels), t.select("id", "text"), labels).drop("text")
