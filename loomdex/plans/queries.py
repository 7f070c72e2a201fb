"""Queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomdex.functions import text as T
from loomdex.operators import cache, chunks, graph, index, usage
from loomdex.plans import corpus
from loomdex.plans.corpus import table
from loomdex.sources import changes as changed, files as sources

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Documents whose references to one word may share a row.
REFS_BLOCK = 10_000

# SQL shared by the oracles
STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
FILES = """f as (select source || '/' || lang || '/doc_' || doc_id || case lang when 'en' then '.ts' when 'fr' then '.py' when 'de' then '.rs' when 'es' then '.java' else '.txt' end as path,
 coalesce(text, '') as content, strlen(coalesce(text, ''))::bigint as size_bytes, doc_id as seq, lang, source, doc_id from documents)"""
LINES = "l as (select path, seq, unnest(string_split(content, chr(10))) as line, generate_subscripts(string_split(content, chr(10)), 1) - 1 as idx from f)"
SYMBOLS = """s as (select path, seq, (idx // 3)::int as pos, regexp_extract(line, '([^ \\t]+)', 1) as name,
 ['class', 'function', 'method', 'interface', 'struct'][(idx // 3) % 5 + 1] as kind, (idx + 1)::int as line from l where idx % 3 = 1 and regexp_extract(line, '([^ \\t]+)', 1) <> '')"""
EDGES = """n as (select count(*) as n from documents),
w as (select path as src, lang, unnest([0, 1]) as pos, unnest([(doc_id * 7 + 1) % n, (doc_id * 3 + 2) % n]) as to_id from f, n),
x as (select src, min(w.pos) as p, f.path as dst from w join f on f.doc_id = w.to_id where w.lang = 'en' and f.lang = 'en' group by src, f.path),
e as (select src, (row_number() over (partition by src order by p) - 1)::int as pos, dst from x)"""
REGIONS = """d as (select *, not (regexp_replace(line, '^\\s+', '') ^@ '@' or regexp_replace(line, '^\\s+', '') ^@ '*' or regexp_replace(line, '^\\s+', '') ^@ '//' or (regexp_replace(line, '^\\s+', '') ^@ '#' and not regexp_replace(line, '^\\s+', '') ^@ '#!')) as plain from l),
a as (select path, idx, coalesce(max(case when plain then idx end) over (partition by path order by idx rows between unbounded preceding and 1 preceding), -1) + 1 as above, max(idx) over (partition by path) as last from d),
g as (select s.path, s.name, s.kind, s.pos, s.line, a.above, greatest(a.above, coalesce(lead(s.line) over v - 2, a.last)) as end_line from s join a on a.path = s.path and a.idx = s.line - 1 window v as (partition by s.path order by s.line, s.pos)),
r as (select path, (row_number() over v - 1)::int as n, name, kind, (case when above <= lag(end_line) over v then lag(end_line) over v + 1 else above end)::int as start_line, end_line::int as end_line from g window v as (partition by path order by line, pos))"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"""with {FILES}, k as (select path, seq // {REFS_BLOCK} as block, unnest(list_distinct(regexp_split_to_array(lower(content), '[^a-z0-9_]+'))) as word from f)
select word, block, count(*) as n_refs, string_agg(path, ',' order by path) as refs from k where length(word) >= 3 and word not in ({STOP}) group by word, block""")
def keyword_index(spark, d):
    i = index.keyword_index(corpus.texts(spark, d), "content", "path", F.floor(F.col("seq") / REFS_BLOCK))
    return i.withColumn("refs", F.array_join("refs", ","))


@query(f"""with {FILES}, k as (select path, unnest(list_distinct(regexp_split_to_array(lower(content), '[^a-z0-9_]+'))) as word from f)
select word, count(*) as n from k where length(word) >= 3 and word not in ({STOP}) group by word order by n desc, word limit 50""")
def keyword_top_terms(spark, d):
    words = index.keyword_refs(corpus.texts(spark, d), "content", "path")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(50)


@query(f"""with {FILES}, k as (select path, unnest(list_distinct(regexp_split_to_array(lower(content), '[^a-z0-9_]+'))) as word from f),
b as (select item_id as query, unnest(list_distinct(regexp_split_to_array(lower(text), '[^a-z0-9_]+'))) as word from benchmark)
select query, path as ref, count(*) as score from b join k using (word) where length(word) >= 3 and word not in ({STOP}) group by query, path
qualify row_number() over (partition by query order by score desc, ref) <= 20""")
def keyword_search(spark, d):
    """The twenty best matches of each query."""
    terms = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), "text")
    return index.search(index.keyword_refs(corpus.texts(spark, d), "content", "path"), terms, 20)


@query(f"""with {FILES}, k as (select path, unnest(list_distinct(regexp_split_to_array(lower(content), '[^a-z0-9_]+'))) as word from f),
b as (select item_id as query, unnest(list_distinct(regexp_split_to_array(lower(text), '[^a-z0-9_]+'))) as word from benchmark)
select query, path as ref, count(*) as score from b join k using (word) where length(word) >= 3 and word not in ({STOP}) group by all""")
def keyword_search_all(spark, d):
    """keyword_search with all matches."""
    terms = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), "text")
    return index.search(index.keyword_refs(corpus.texts(spark, d), "content", "path"), terms)


@query(f"""with {FILES} select case lang when 'en' then 'typescript' when 'fr' then 'python' when 'de' then 'rust' when 'es' then 'java' else 'unknown' end as language,
case lang when 'en' then 'TypeScript' when 'fr' then 'Python' when 'de' then 'Rust' when 'es' then 'Java' else 'Unknown' end as display, count(*) as n_files, sum(size_bytes)::bigint as bytes from f group by all""")
def files_by_language(spark, d):
    f = corpus.files(spark, d).withColumn("display", T.display_language_of(F.col("path")))
    return f.groupBy("language", "display").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size_bytes").alias("bytes"))


@query(f"with {FILES} select source || '/' || lang as dir, seq // {REFS_BLOCK} as block, count(*) as n_files, string_agg(path, ',' order by path) as paths from f group by 1, 2")
def files_by_directory(spark, d):
    return index.files_by_directory(corpus.files(spark, d), F.floor(F.col("seq") / REFS_BLOCK)).withColumn("paths", F.array_join("paths", ","))


@query(f"with {FILES}, {LINES}, {SYMBOLS} select path, size_bytes from f where path not in (select path from s) and length(regexp_replace(content, '^\\s+|\\s+$', '', 'g')) < 50")
def filter_trivial(spark, d):
    f = corpus.files(spark, d)
    n = corpus.symbols(f).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    return f.join(n, "path", "left").where(T.is_trivial(F.coalesce("n", F.lit(0)), F.col("content"))).select("path", "size_bytes")


@query(f"with {FILES} select path, size_bytes from f where size_bytes / 1024.0 <= 1 * 5")
def filter_size_cap(spark, d):
    return sources.size_capped(corpus.files(spark, d), 1).select("path", "size_bytes")


@query(f"with {FILES} select path from f where not (path ^@ 'src1/' or regexp_matches(path, '_[0-9]*7\\.ts$') or regexp_matches(path, '(^|/)de/'))")
def filter_excluded(spark, d):
    return corpus.files(spark, d).where(~sources.excluded(F.col("path"), ["src1/**", "**/*_*7.ts", "**/de/**"])).select("path")


@query(f"with {FILES} select path, size_bytes from f where path ^@ 'src2/' or path ^@ 'src3/en/' or path = 'src4/en/doc_4.ts'")
def include_list(spark, d):
    text = spark.createDataFrame([("# folders\nsrc2\n src3/en/ \n\nsrc3/en\nsrc4/en/doc_4.ts\nmissing\n",)], "text string")
    return sources.include_scan(corpus.files(spark, d), text.select(F.explode(sources.parse_include(F.col("text"))).alias("entry"))).select("path", "size_bytes")


@query(f"with {FILES} select path, sha256(content) as sha256, sha1(encode('blob ' || strlen(content)) || '\\x00'::blob || encode(content)) as git_hash from f")
def content_hash(spark, d):
    return corpus.files(spark, d).select("path", T.content_hash(F.col("content")).alias("sha256"), T.git_blob_hash(F.col("content")).alias("git_hash"))


@query(f"with {FILES} select sha256(content) as content_hash, count(*) as n, min(path) as first_path from f group by 1 having n > 1")
def duplicate_content(spark, d):
    f = corpus.files(spark, d).select("path", T.content_hash(F.col("content")).alias("content_hash"))
    return f.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path")).where("n > 1")


@query(f"with {FILES}, h as (select path, seq, sha256(content) as content_hash from f) select path, content_hash, content_hash in (select content_hash from h join labels on doc_id = seq) as cached from h")
def cache_partition(spark, d):
    f = corpus.files(spark, d).select("path", "seq", T.content_hash(F.col("content")).alias("content_hash"))
    known = f.join(table(spark, d, "labels").select(F.col("doc_id").alias("seq")), "seq", "left_semi").select("content_hash")
    return cache.partition_by_cache(f, known).select("path", "content_hash", "cached")


@query(f"""with {FILES}, {LINES}, {SYMBOLS}, {REGIONS}, c as (select r.path, n, sha256(array_to_string(string_split(f.content, chr(10))[start_line + 1:end_line + 1], chr(10))) as content_hash from r join f using (path))
select path, n as chunk_index, content_hash, n % 3 <> 0 or exists (select 1 from c as o where o.path = c.path and o.content_hash = c.content_hash and o.n % 3 <> 0) as reused from c""")
def chunk_delta(spark, d):
    f = corpus.texts(spark, d)
    c = chunks.chunks(corpus.symbols(f), f).where(F.size("symbol_names") > 0)
    old = c.where("chunk_index % 3 <> 0").select("path", F.col("content_hash").alias("chunk_hash"), "chunk_index", F.lit("x").alias("result"))
    return cache.chunk_delta(c, old).select("path", "chunk_index", "content_hash", "reused")


@query(f"""with {FILES}, b as (select path, (row_number() over (order by seq) - 1) // 6 as batch from f where size_bytes <= 6000)
select f.path, size_bytes <= 6000 as is_small, b.batch::bigint as batch from f left join b using (path)""")
def batch_plan(spark, d):
    return chunks.batch_plan(corpus.files(spark, d)).select("path", "is_small", "batch")


@query(f"""with {FILES}, t as (select ceil(count(*) filter (size_bytes <= 6000) / 6.0)::bigint as batches, count(*) filter (size_bytes > 6000)::bigint as large from f)
select batches, large, batches + large as requests, ceil((batches + large) / 12.0)::bigint as minutes from t""")
def request_estimate(spark, d):
    return usage.request_estimate(chunks.batch_plan(corpus.files(spark, d)), 12)


@query(f"with {FILES}, {LINES}, {SYMBOLS}, {REGIONS} select path, n, name, kind, start_line, end_line from r")
def symbol_regions(spark, d):
    f = corpus.texts(spark, d)
    return chunks.regions(corpus.symbols(f), f)


@query(f"""with {FILES}, {LINES}, {SYMBOLS}, {REGIONS}, t as (select path, n, name, start_line, end_line, array_to_string(string_split(f.content, chr(10))[start_line + 1:end_line + 1], chr(10)) as content from r join f using (path)
 union all select path, 0, null, 0, (len(string_split(content, chr(10))) - 1)::int, content from f where path not in (select path from s) and length(regexp_replace(content, '^\\s+|\\s+$', '', 'g')) >= 50)
select path, n::int as chunk_index, path || '::chunk_' || n as id, sha256(content) as content_hash, coalesce(name, '') as symbol, start_line, end_line, length(content)::int as n_chars from t""")
def symbol_chunks(spark, d):
    f = corpus.texts(spark, d)
    c = chunks.chunks(corpus.symbols(f), f, max_chars=10_000_000)
    return c.select("path", "chunk_index", "id", "content_hash", F.array_join("symbol_names", ",").alias("symbol"), "start_line", "end_line", F.length("content").alias("n_chars"))


@query(f"""with {FILES}, {LINES}, {SYMBOLS}, {REGIONS}, {EDGES},
c as (select r.path, n, unnest(list_distinct(regexp_split_to_array(array_to_string(string_split(f.content, chr(10))[start_line + 1:end_line + 1], chr(10)), '[^A-Za-z0-9_]+'))) as name from r join f using (path)),
i as (select distinct e.src as path, s.name from e join s on s.path = e.dst where length(s.name) > 2 and regexp_matches(s.name, '^[A-Za-z0-9_]+$'))
select c.path, c.n as chunk_index, name from c join i using (path, name)""")
def chunk_refs(spark, d):
    f = corpus.texts(spark, d)
    s = corpus.symbols(f)
    plain = s.where(F.col("name").rlike("^[A-Za-z0-9_]+$"))
    return chunks.references(chunks.chunks(s, f).where(F.size("symbol_names") > 0), corpus.edges(spark, d), plain)


@query(f"""with {FILES}, {LINES}, {SYMBOLS}, {EDGES}, x2 as (select src as path, e.pos, dst, string_agg(name || '(' || kind || ')', ', ' order by s.pos) as names from e join s on s.path = e.dst group by all)
select path, string_agg('`' || dst || '` exports: ' || names, '; ' order by pos) as dep_context from x2 group by path""")
def export_context(spark, d):
    return chunks.export_context(corpus.edges(spark, d), corpus.symbols(corpus.texts(spark, d)))


@query(f"""with {FILES}, {LINES}, {SYMBOLS}, {EDGES}, k as (select distinct path, unnest(regexp_split_to_array(content, '[^A-Za-z0-9_]+')) as name from f),
u as (select e.src as path, e.pos as edge, e.dst, s.pos, s.name, s.kind from e join s on s.path = e.dst join k on k.path = e.src and k.name = s.name where length(s.name) > 2),
x2 as (select path, edge, dst, string_agg(name || '(' || kind || ')', ', ' order by pos) as names from u group by all)
select path, string_agg('`' || dst || '`: ' || names, '; ' order by edge) as dep_context from x2 group by path""")
def dep_context(spark, d):
    f = corpus.texts(spark, d)
    s, e = corpus.symbols(f), corpus.edges(spark, d)
    whole = f.select("path", F.lit(0).alias("chunk_index"), "content")
    plain = s.where(F.col("name").rlike("^[A-Za-z0-9_]+$"))
    return chunks.dependency_context(chunks.references(whole, e, plain), e, plain, [])


@query(f"with {FILES}, {EDGES} select src, pos, dst from e")
def import_edges(spark, d):
    return corpus.edges(spark, d)


@query(f"with {FILES}, {EDGES} select dst as path, f.seq // {REFS_BLOCK} as block, string_agg(src, ',' order by f.seq) as imported_by, count(*) as n from e join f on f.path = e.src group by 1, 2")
def reverse_edges(spark, d):
    r = graph.reverse_edges(corpus.edges(spark, d), corpus.files(spark, d).select("path", "seq"), REFS_BLOCK)
    return r.select("path", "block", F.array_join("imported_by", ",").alias("imported_by"), F.size("imported_by").cast("long").alias("n"))


@query(f"with {FILES}, {LINES}, {SYMBOLS}, {EDGES} select (select count(*) from f) as total_files, (select count(*) from s) as total_symbols, (select count(*) from e) as total_edges")
def graph_stats(spark, d):
    f = corpus.files(spark, d)
    return graph.graph_stats(f.select("path"), corpus.symbols(f), corpus.edges(spark, d))


@query(f"""with recursive {FILES}, {EDGES}, reach(a, b) as (select src, dst from e union select r.a, e.dst from reach as r join e on e.src = r.b),
cyc as (select distinct a from reach where a = b), bad as (select a as path from cyc union select a from reach where b in (select a from cyc)),
walk(path, level) as (select path, 0 from f where path not in (select path from bad) union select e.src, level + 1 from walk join e on e.dst = walk.path where e.src not in (select path from bad))
select path, max(level)::int as level from walk group by path union all select path, null from bad""")
def topo_levels(spark, d):
    return graph.levels(corpus.files(spark, d).select("path"), corpus.edges(spark, d))


@query()
def topo_dfs(spark, d):
    return graph.dependency_order(corpus.files(spark, d).select("path", "seq"), corpus.edges(spark, d))


@query()
def pack_groups(spark, d):
    f = corpus.texts(spark, d)
    g = chunks.groups(chunks.chunks(corpus.symbols(f), f, 2000), 2000)
    return g.select("path", "group_no", F.array_join("chunk_indexes", ",").alias("chunk_indexes"), F.size("symbol_names").alias("n_symbols"), T.utf16_length(F.col("combined_content")).alias("size"))


CALLS = """c as (select event_type as provider, ts, event_id, trunc(value * 100)::bigint as tokens, event_id % 3 = 0 as whole, cast(json_extract_string(props, '$.k') as bigint) as ms from events)"""


@query(f"""with {CALLS} select provider, count(*) as request_count, sum(ms)::bigint as total_duration_ms, coalesce(sum(case when not whole then tokens end), 0)::bigint as input_tokens,
coalesce(sum(case when not whole then floor(tokens / 2.0) end), 0)::bigint as output_tokens, coalesce(sum(case when whole then tokens end), 0)::bigint as unsplit_tokens from c group by provider""")
def usage_by_provider(spark, d):
    return usage.tally_calls(corpus.calls(spark, d), "provider")


def _runs(spark, d):
    """A run a user and provider."""
    c = corpus.calls(spark, d).join(table(spark, d, "events").select("event_id", "user_id"), "event_id")
    t = usage.tally_calls(c, "user_id", "provider").withColumnRenamed("total_duration_ms", "duration_ms")
    last = c.groupBy("user_id", "provider").agg(F.max("ts").alias("ts"), F.max("event_id").alias("seq"))
    extra = [(F.col("request_count") % 5).alias("files_analyzed"), (F.col("request_count") % 2).alias("files_from_cache"), F.lit(0).alias("errors")]
    return t.join(last, ["user_id", "provider"]).select("*", *extra)


RUNS = f"""{CALLS.replace("event_id,", "event_id, user_id,")}, r as (select user_id, provider, count(*) as request_count, sum(ms)::bigint as duration_ms, coalesce(sum(case when not whole then tokens end), 0)::bigint as input_tokens,
coalesce(sum(case when not whole then floor(tokens / 2.0) end), 0)::bigint as output_tokens, coalesce(sum(case when whole then tokens end), 0)::bigint as unsplit_tokens, max(ts) as ts, max(event_id) as seq from c group by all)"""


@query(f"""with {RUNS}, p as (select provider, sum(input_tokens)::bigint as i, sum(output_tokens)::bigint as o, sum(unsplit_tokens)::bigint as u, sum(request_count)::bigint as q, sum(request_count % 5 + request_count % 2)::bigint as fs, sum(duration_ms)::bigint as ms from r group by provider)
select provider, i as input_tokens, o as output_tokens, i + o + u as total_tokens, q as request_count, round(i / n)::bigint as avg_input_tokens, round(o / n)::bigint as avg_output_tokens, round(fs / n)::bigint as avg_files, round(ms / 60000 * 10) / 10 as duration_min from p, (select count(*) as n from r)""")
def usage_averages(spark, d):
    r = _runs(spark, d)
    return usage.averages(usage.by_provider(r), r.agg(F.count(F.lit(1)).alias("n")).scalar())


@query(f"""with {RUNS} select user_id, provider, epoch_us(ts) as ts_us, input_tokens, case when round(duration_ms / 1000) >= 60 then (round(duration_ms / 1000)::bigint // 60) || 'm ' || (round(duration_ms / 1000)::bigint % 60) || 's' else round(duration_ms / 1000)::bigint || 's' end as duration,
'–' as errors_shown from r order by ts desc, seq desc limit 20""")
def recent_runs(spark, d):
    r = usage.recent_runs(_runs(spark, d))
    return r.select("user_id", "provider", usage.micros("ts").alias("ts_us"), "input_tokens", usage.duration_text(F.col("duration_ms")).alias("duration"), usage.errors_text(F.col("errors")).alias("errors_shown"))


@query("""select event_id, event_type, count(*) over (partition by event_type order by epoch_us(ts) range between 59999999 preceding and current row) as in_window from events""")
def rate_window(spark, d):
    return usage.in_window(table(spark, d, "events"), "event_type").select("event_id", "event_type", "in_window")


@query("""with g as (select user_id, ts, case when ts < lag(ts) over (partition by user_id order by ts) + interval 3600 second then 0 else 1 end as new from events),
s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select user_id, epoch_us(min(ts)) as start_us, epoch_us(max(ts) + interval 3600 second) as fires_us, count(*) as n from s group by user_id, k""")
def debounce_sessions(spark, d):
    s = usage.sessions(table(spark, d, "events"), "user_id", "3600 seconds")
    return s.select("user_id", usage.micros("start").alias("start_us"), usage.micros("fires_at").alias("fires_us"), "n")


@query(f"""with {FILES}, o as (select path, sha256(content) as h from f where seq % 10 <> 0), n as (select path, sha256(case when seq % 7 = 0 then content || ' changed' else content end) as h from f where seq % 13 <> 5)
select coalesce(o.path, n.path) as path, case when o.path is null then 'added' when n.path is null then 'deleted' else 'modified' end as change from o full join n on o.path = n.path where o.h is distinct from n.h""")
def changed_files(spark, d):
    return changed.snapshot_diff(*corpus.snapshots(spark, d))


@query(f"""with {FILES}, o as (select path, sha256(content) as h from f where seq % 10 <> 0), n as (select path, seq, sha256(case when seq % 7 = 0 then content || ' changed' else content end) as h from f where seq % 13 <> 5),
fresh as (select n.path, n.h from n left join o using (path) where o.h is distinct from n.h and n.seq % 4 <> 0)
select path, h as content_hash, 'fresh' as origin from fresh union all select path, h, 'kept' from o where path not in (select path from fresh) and path in (select path from n)""")
def incremental_merge(spark, d):
    """Every fourth analysis fails: those files keep their former context."""
    old, new = corpus.snapshots(spark, d)
    ch = changed.snapshot_diff(old, new)
    ok = corpus.files(spark, d).where("seq % 4 <> 0").select("path")
    fresh = new.join(ch.where("change <> 'deleted'").select("path"), "path", "left_semi").join(ok, "path", "left_semi").withColumn("origin", F.lit("fresh"))
    return cache.merge_contexts(old.withColumn("origin", F.lit("kept")), fresh, ch, ch.where("change = 'deleted'"))


@query(f"""with {FILES}, o as (select path, sha256(content) as h from f where seq % 10 <> 0), n as (select path, sha256(case when seq % 7 = 0 then content || ' changed' else content end) as h from f where seq % 13 <> 5)
select path, coalesce(n.h, o.h) as content_hash from o full join n using (path) where path not in (select path from f where seq % 13 = 5)""")
def branch_state(spark, d):
    old, new = corpus.snapshots(spark, d)
    return cache.merge_branch(old, new, corpus.files(spark, d).where("seq % 13 = 5").select("path"))


@query(f"""with {FILES}, u as (select sha256(content) as content_hash, path, seq as seen from f) select content_hash, arg_max(path, seen) as path, max(seen) as seen from u group by content_hash""")
def cache_upsert(spark, d):
    f = corpus.files(spark, d).select(T.content_hash(F.col("content")).alias("content_hash"), "path", F.col("seq").alias("seen"))
    return cache.upsert(f.where("seen % 2 = 0"), f.where("seen % 2 = 1"), "content_hash", "seen")


@query(f"with {FILES}, {LINES}, {SYMBOLS} select name, kind, path, line from s where kind in ('class', 'interface', 'function', 'struct', 'trait') order by seq, pos limit 50")
def key_symbols(spark, d):
    return index.key_symbols(corpus.symbols(corpus.files(spark, d))).select("name", "kind", "path", "line")


@query(f"with {FILES}, {LINES}, {SYMBOLS} select name, seq // {REFS_BLOCK} as block, count(*) as n, string_agg(path || ':' || line, ',' order by seq, pos) as places from s group by 1, 2")
def symbol_index(spark, d):
    f = corpus.texts(spark, d)
    s = corpus.symbols(f).select("name", "kind", F.col("path").alias("file"), "line", F.lit("").alias("purpose"), F.lit("").alias("behavior"), F.lit(None).cast("string").alias("limitations"), "seq", "pos")
    places = F.array_join(F.transform("entries", lambda x: F.concat(x["file"], F.lit(":"), x["line"].cast("string"))), ",")
    return index.symbol_index(s, F.floor(F.col("seq") / REFS_BLOCK)).select("name", "block", F.size("entries").cast("long").alias("n"), places.alias("places"))


@query(f"with {FILES}, {LINES}, {SYMBOLS} select (select count(distinct path) from f) as total_files, (select count(*) from s) as total_symbols")
def index_totals(spark, d):
    f = corpus.files(spark, d)
    return index.index_totals(f.select("path"), corpus.symbols(f))


@query(f"""with {FILES}, v as (select *, regexp_replace(regexp_replace(regexp_replace(content, '[\\r\\n]+', ' ', 'g'), '\\s{{2,}}', ' ', 'g'), '^\\s+|\\s+$', '', 'g') as flat from f)
select source || '/' || lang as dir, row_number() over (partition by source, lang order by path) ::int as place, '- **`' || path || '`** — ' || case when flat = '' then '_No overview available_' when length(flat) > 200 then flat[1:197] || '…' else flat end as line from v""")
def overview_lines(spark, d):
    return index.overview_lines(corpus.texts(spark, d).withColumn("overview", F.col("content")))


@query("""select conv_id, coalesce(string_agg(text, chr(10) order by turn) filter (role = 'system'), '') as system_text, count(*) filter (role <> 'system') as n_messages,
string_agg(case role when 'assistant' then 'model' else role end, ',' order by turn) filter (role <> 'system') as gemini_roles from conversations group by conv_id""")
def message_shaping(spark, d):
    from loomdex.operators.providers import shape_messages

    return shape_messages(table(spark, d, "conversations"))


@query("""select page_id, regexp_extract(html, '(?s)<script(\\b[^>]*)>(.*?)</script>', 2) as script, case when regexp_matches(regexp_extract(html, '(?s)<script(\\b[^>]*)>(.*?)</script>', 1), '\\blang=[''"]ts[''"]') then 'typescript' else 'javascript' end as language,
(len(string_split(regexp_extract(html, '(?s)^(.*?<script\\b[^>]*>).*?</script>', 1), chr(10))) - 1)::int as line_offset from pages where regexp_matches(html, '(?s)<script(\\b[^>]*)>(.*?)</script>')""")
def script_blocks(spark, d):
    p = table(spark, d, "pages").select("page_id", sources.vue_script(F.col("html")).alias("s"))
    return p.where("s IS NOT NULL").select("page_id", "s.script", "s.language", "s.line_offset")


@query("""select distinct page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as spec from pages""")
def raw_imports(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))).alias("spec"))


@query(f"""with {FILES}, {EDGES}, dp as (select src as path, string_agg('- `' || dst || '`', chr(10) order by pos) as deps from e group by src)
select f.path, sha256('# ' || f.path || chr(10) || '**Language:** ' || case lang when 'en' then 'typescript' when 'fr' then 'python' when 'de' then 'rust' when 'es' then 'java' else 'unknown' end || '  ' || chr(10) || '**Analyzed:** 2024-01-01T00:00:00.000Z  ' || chr(10) || chr(10) ||
case when seq % 5 = 0 then '> **Trivial file** — no significant logic to analyze.' else '## Overview' || chr(10) || 'Document ' || seq || chr(10) || coalesce(chr(10) || '## Dependencies' || chr(10) || deps || chr(10), '') end) as markdown_hash from f left join dp using (path)""")
def context_markdown(spark, d):
    f = corpus.files(spark, d).select("path", "language", "seq")
    deps = corpus.edges(spark, d).groupBy(F.col("src").alias("path")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "dst"))), lambda x: x["dst"]).alias("dependencies"))
    none = F.array().cast("array<string>")
    c = f.join(deps, "path", "left").withColumns({
        "dependencies": F.coalesce("dependencies", none), "overview": F.when(F.col("seq") % 5 == 0, index.TRIVIAL_OVERVIEW).otherwise(F.concat(F.lit("Document "), F.col("seq").cast("string"))),
        "chunk_count": F.when(F.col("seq") % 5 == 0, 0).otherwise(1), "analyzed_at": F.lit("2024-01-01T00:00:00.000Z"),
        "symbols": F.array().cast("array<struct<name:string,kind:string,line:int,purpose:string,behavior:string,parameters:string,returns:string,limitations:string,used_by:array<string>>>"),
    })
    return c.select("path", F.sha2(F.encode(index.markdown(), "UTF-8"), 256).alias("markdown_hash"))