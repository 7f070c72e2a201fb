"""Queries of the source-tree operators over whole tables: parsing, imports, changes, replies, prompts, runs; and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from loomdex.functions import parsing, replies, text as T
from loomdex.operators import cache, chunks, graph, index, order, providers, sinks, usage
from loomdex.operators.storage import checkpoint_dir
from loomdex.plans import corpus
from loomdex.plans.corpus import table
from loomdex.plans.queries import EDGES, FILES, LINES, REGIONS, SYMBOLS, query
from loomdex.sources import changes, files as sources

LANGUAGE = "case lang when 'en' then 'typescript' when 'fr' then 'python' when 'de' then 'rust' when 'es' then 'java' else 'unknown' end"


# Imports: each file names two or three others, as its language writes it.
def _imports(spark, d, lang: str, forms) -> DataFrame:
    """Edges of the files of ``lang``; ``forms`` make a specifier of the number of a wanted document."""
    f = corpus.files(spark, d)
    n = f.agg(F.count(F.lit(1)).alias("n")).scalar()
    wanted = [(F.col("seq") * (2 * i + 3) + i) % n for i in range(len(forms))]
    specs = F.array(*(form(w.cast("string")) for form, w in zip(forms, wanted, strict=True)))
    mine = f.where(T.language_of(F.col("path")) == lang)
    return graph.import_edges(mine.select(F.col("path").alias("src"), F.posexplode(specs).alias("pos", "spec")), f.select("path", "seq"))


def _imports_sql(lang: str, local: list[bool]) -> str:
    """``local``: whether a specifier reaches its own source only."""
    numbers = ", ".join(f"(doc_id * {2 * i + 3} + {i}) % n" for i in range(len(local)))
    return f"""with {FILES}, n as (select count(*) as n from documents),
w as (select path as src, source, unnest({list(range(len(local)))}) as pos, unnest([{numbers}]) as to_id, unnest({str(local).lower()}) as own from f, n where lang = '{lang}'),
x as (select src, min(w.pos) as p, f.path as dst from w join f on f.doc_id = w.to_id and f.lang = '{lang}' and (not own or f.source = w.source) group by src, f.path)
select src, (row_number() over (partition by src order by p) - 1)::int as pos, dst from x"""


@query(_imports_sql("en", [True, True]))
def script_imports(spark, d):
    return _imports(spark, d, "typescript", [lambda i: F.concat(F.lit("./doc_"), i), lambda i: F.concat(F.lit("../en/./doc_"), i, F.lit(".ts"))])


@query(_imports_sql("fr", [True, True]))
def python_relative_imports(spark, d):
    return _imports(spark, d, "python", [lambda i: F.concat(F.lit(".doc_"), i), lambda i: F.concat(F.lit("..fr.doc_"), i)])


@query(_imports_sql("es", [False, False]))
def java_suffix_imports(spark, d):
    return _imports(spark, d, "java", [lambda i: F.concat(F.lit("es.doc_"), i), lambda i: F.concat(F.lit("doc_"), i)])


@query(_imports_sql("de", [False, True, True]))
def rust_crate_imports(spark, d):
    return _imports(spark, d, "rust", [lambda i: F.concat(F.lit("crate::de::doc_"), i), lambda i: F.concat(F.lit("super::de::doc_"), i), lambda i: F.concat(F.lit("self::doc_"), i)])


# Parsing: code made of each document's number, in its language, with its first word in a comment.
CODE = {
    "en": "// {w}\nimport {{ a }} from './m{i}';\nexport function run{i}(a: number) {{\n  return a;\n}}\nclass Box{i} {{\n  size() {{ return 1; }}\n}}\ninterface Form{i} {{ a: number }}\n",
    "fr": "# {w}\nfrom .m{i} import a\nclass Box{i}:\n    def size(self):\n        return 1\n\ndef run{i}(a):\n    return a\n",
    "de": "// {w}\nuse crate::m{i}::A;\npub fn run{i}(a: i32) -> i32 {{ a }}\nstruct Box{i} {{ a: i32 }}\ntrait Form{i} {{ }}\n",
    "es": "// {w}\nimport org.m{i}.A;\npublic class Box{i} {{\n  public int size() {{ return 1; }}\n}}\ninterface Form{i} {{ }}\n",
}
#: (name, kind, line, signature) of that code, in order.
FOUND = {
    "en": [("run{i}", "function", 3, "export function run{i}(a: number) {{"), ("Box{i}", "class", 6, "class Box{i} {{"), ("size", "method", 7, "size() {{ return 1; }}"), ("Form{i}", "interface", 9, "interface Form{i} {{ a: number }}")],
    "fr": [("Box{i}", "class", 3, "class Box{i}:"), ("size", "method", 4, "def size(self):"), ("run{i}", "function", 7, "def run{i}(a):")],
    "de": [("run{i}", "function", 3, "pub fn run{i}(a: i32) -> i32 {{ a }}"), ("Box{i}", "struct", 4, "struct Box{i} {{ a: i32 }}"), ("Form{i}", "trait", 5, "trait Form{i} {{ }}")],
    "es": [("Box{i}", "class", 3, "public class Box{i} {{"), ("size", "method", 4, "public int size() {{ return 1; }}"), ("Form{i}", "interface", 6, "interface Form{i} {{ }}")],
}
SPEC = {"en": "./m{i}", "fr": ".m{i}", "de": "crate::m{i}::A", "es": "org.m{i}.A"}


def _code_files(spark, d) -> DataFrame:
    f = corpus.files(spark, d)
    word, number = F.regexp_extract("content", "[a-zA-Z]+", 0), F.col("seq").cast("string")

    def filled(template: str):
        text = F.lit(template.replace("{{", "{").replace("}}", "}"))
        return F.replace(F.replace(text, F.lit("{i}"), number), F.lit("{w}"), word)

    grammar = T.grammar_of(F.col("path"))
    code = F.lit("")
    for lang, name in (("en", "typescript"), ("fr", "python"), ("de", "rust"), ("es", "java")):
        code = F.when(grammar == name, filled(CODE[lang])).otherwise(code)
    return f.select("path", code.alias("content"), "language", F.octet_length(code).cast("long").alias("size_bytes"), "seq")


def _code(spark, d) -> DataFrame:
    return parsing.parse_files(_code_files(spark, d).select("path", "content"))


def _values(rows) -> str:
    quoted = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("{{", "{").replace("}}", "}").replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)


@query(f"""with {FILES}, v(lang, pos, name, kind, line, signature) as (values {_values((lang, i, *x) for lang, xs in FOUND.items() for i, x in enumerate(xs))})
select path, pos, replace(name, '{{i}}', doc_id::varchar) as name, kind, line, replace(signature, '{{i}}', doc_id::varchar) as signature from f join v using (lang)""")
def parsed_symbols(spark, d):
    return _code(spark, d).select("path", F.posexplode("parsed.symbols").alias("pos", "s")).select("path", "pos", "s.name", "s.kind", "s.line", "s.signature")


@query(f"""with {FILES}, v(lang, spec) as (values {_values(SPEC.items())}) select path, 0 as pos, replace(spec, '{{i}}', doc_id::varchar) as spec from f join v using (lang)""")
def parsed_imports(spark, d):
    return _code(spark, d).select("path", F.posexplode("parsed.specs").alias("pos", "spec"))


# Scans
@query(f"""with {FILES}, p as (select case when seq % 9 = 0 then '{sources.STATE_DIR}/' || path when seq % 9 = 1 then 'dist/' || path when seq % 9 = 2 then path || '.lock' else path end as path from f)
select path, path as seq from p where regexp_matches(path, '\\.(ts|py|rs|java)$') and not path ^@ '{sources.STATE_DIR}/' and not path ^@ 'dist/'""")
def kept_sources(spark, d):
    """What a scan keeps: extensions, exclusions, the state folder; seq is the path."""
    p, n = F.col("path"), F.col("seq") % 9
    put = F.when(n == 0, F.concat(F.lit(f"{sources.STATE_DIR}/"), p)).when(n == 1, F.concat(F.lit("dist/"), p)).when(n == 2, F.concat(p, F.lit(".lock"))).otherwise(p)
    return sources.number_by_path(sources.keep_source(corpus.files(spark, d).select(put.alias("path"), "content"))).select("path", "seq")


@query(f"with {FILES} select path, (row_number() over (order by path) - 1)::bigint as row from f")
def scan_order(spark, d):
    return order.numbered(corpus.files(spark, d).select("path"), "path")


@query(f"""with {FILES} select path, not (regexp_matches(path, '^(.*/)?en/.*$') or regexp_matches(path, '^src1/.*$') or regexp_matches(path, '^(.*/)?[^/]*7\\.ts$')) as kept_by_glob,
not (regexp_matches(path, '.[^/]*/en/.[^/]*') or regexp_matches(path, 'src1/.[^/]*') or regexp_matches(path, '.[^/]*/[^/]*7.ts')) as kept_by_compat from f""")
def exclude_modes(spark, d):
    patterns = ["**/en/**", "src1/**", "**/*7.ts"]
    return corpus.files(spark, d).select("path", *((~sources.excluded(F.col("path"), patterns, m)).alias(f"kept_by_{m}") for m in ("glob", "compat")))


@query(f"""with {FILES} select path, case lang when 'en' then 'typescript' when 'fr' then 'python' when 'de' then 'rust' when 'es' then 'java' end as grammar, replace(source || '/' || lang, '/', '--') as branch_dir,
case when source = 'src1' and lang = 'en' then 'doc_' || doc_id || '.ts' when source = 'src1' then '../' || lang || '/' || split_part(path, '/', 3) else '../../' || path end as from_here from f""")
def path_forms(spark, d):
    p = F.col("path")
    return corpus.files(spark, d).select("path", T.grammar_of(p).alias("grammar"), T.branch_dir(T.dirname(p)).alias("branch_dir"), T.relative_path(F.lit("src1/en"), p).alias("from_here"))


@query("""select page_id, regexp_replace(url, '([.*+?^${}()|\\[\\]\\\\])', '\\\\\\1', 'g') as escaped from pages""")
def escaped_names(spark, d):
    return table(spark, d, "pages").select("page_id", T.escape_regex(F.col("url")).alias("escaped"))


@query(f"with {FILES}, {LINES}, {SYMBOLS} select s.path, s.pos, regexp_replace(l.line, '^\\s+|\\s+$', '', 'g')[1:120] as signature from s join l on l.path = s.path and l.idx = s.line - 1")
def signatures(spark, d):
    f = corpus.texts(spark, d)
    lines = chunks.lines_of(f).select("path", (F.col("idx") + 1).alias("line"), F.col("line").alias("text"))
    return corpus.symbols(f).join(lines, ["path", "line"]).select("path", "pos", T.signature(F.col("text")).alias("signature"))


# Chunks
MOST = 2000


@query(f"""with recursive {FILES}, b as (select path, content, string_split(content, chr(10)) as ls from f where length(content) > {MOST}),
w(path, i, now, chunk) as (select path, 1, length(ls[1]), 0 from b union all
 select w.path, i + 1, case when now > 0 and now + length(ls[i + 1]) + 1 <= {MOST} then now + 1 + length(ls[i + 1]) else length(ls[i + 1]) end,
 chunk + (now > 0 and now + length(ls[i + 1]) + 1 > {MOST})::int from w join b using (path) where i < len(ls))
select path, 0 as n, length(content)::int as n_chars from f where length(content) <= {MOST}
union all select path, chunk, max(now)::int from w group by path, chunk having max(now) > 0""")
def document_line_chunks(spark, d):
    f = corpus.texts(spark, d)
    return f.select("path", F.posexplode(T.chunk_lines(F.col("content"), MOST)).alias("n", "chunk")).select("path", "n", F.length("chunk").alias("n_chars"))


WHOLE = """t as (select r.path, n, name, start_line, array_to_string(string_split(f.content, chr(10))[start_line + 1:end_line + 1], chr(10)) as content from r join f using (path)
 union all select path, 0, null, 0, content from f where path not in (select path from s) and length(regexp_replace(content, '^\\s+|\\s+$', '', 'g')) >= 50)"""


@query(f"""with {FILES}, {LINES}, {SYMBOLS}, {REGIONS}, {EDGES}, {WHOLE},
i as (select distinct e.src as path, s.name from e join s on s.path = e.dst where length(s.name) > 2),
p as (select path, name, case when regexp_matches(name, '^[A-Za-z0-9_]') then '(^|[^A-Za-z0-9_])' else '[A-Za-z0-9_]' end || regexp_replace(name, '([.*+?^${{}}()|\\[\\]\\\\])', '\\\\\\1', 'g')
 || case when regexp_matches(name, '[A-Za-z0-9_]$') then '($|[^A-Za-z0-9_])' else '[A-Za-z0-9_]' end as pattern from i)
select t.path, t.n::int as chunk_index, p.name from t join p on p.path = t.path where regexp_matches(t.content, p.pattern)""")
def chunk_refs_any_name(spark, d):
    f = corpus.texts(spark, d)
    s = corpus.symbols(f)
    return chunks.references(chunks.chunks(s, f, max_chars=10_000_000), corpus.edges(spark, d), s)


@query(f"""with {FILES}, {LINES}, {SYMBOLS}, {REGIONS} select path, sha256(array_to_string(string_split(f.content, chr(10))[1:start_line], chr(10))) as preamble_hash from r join f using (path) where n = 0 and start_line > 0""")
def preambles(spark, d):
    f = corpus.texts(spark, d)
    c = chunks.chunks(corpus.symbols(f), f, max_chars=10_000_000)
    return c.where("chunk_index = 0 AND preamble <> ''").select("path", T.content_hash(F.col("preamble")).alias("preamble_hash"))


def _found(c: DataFrame) -> DataFrame:
    """Model symbols of groups of three chunks: those of chunks with an even number, and one that no chunk declares."""
    name = F.explode(F.concat(F.filter("symbol_names", lambda _: F.col("chunk_index") % 2 == 0), F.when(F.col("chunk_index") % 3 == 0, F.array(F.lit("(none)"))).otherwise(F.array().cast("array<string>"))))
    s = c.select("path", F.floor(F.col("chunk_index") / 3).cast("int").alias("group_no"), "chunk_index", name.alias("name"))
    none = {n: F.lit("") for n in ("purpose", "behavior")} | {n: F.lit(None).cast("string") for n in ("parameters", "returns", "limitations")}
    symbol = F.struct("chunk_index", "name", F.lit("function").alias("kind"), F.lit(0).alias("line"), *(v.alias(k) for k, v in none.items()))
    g = s.groupBy("path", "group_no").agg(F.array_sort(F.collect_list(symbol)).alias("m"))
    return g.select("path", "group_no", F.lit("o").alias("overview"), F.transform("m", lambda x: x.dropFields("chunk_index")).cast(f"array<{replies.SYMBOL}>").alias("symbols"))


@query(f"""with {FILES}, {LINES}, {SYMBOLS}, {REGIONS}, c as (select path, n, n // 3 as g, name from r), k as (select path, g, n, name from c where n % 2 = 0),
m as (select c.path, c.n, c.g, k.name, k.n as at from c join k on k.path = c.path and k.g = c.g and k.name = c.name union all select path, n, g, '(none)', n from c where n % 3 = 0)
select c.path, c.n as chunk_index, coalesce(string_agg(m.name, ',' order by m.name), '') as names, case when c.n % 3 = 0 then 'o' else '' end as overview from c left join m on m.path = c.path and m.n = c.n group by c.path, c.n""")
def chunk_assignments(spark, d):
    """A group's answer dealt to its chunks: by declared names, the rest and the overview to the first."""
    f = corpus.texts(spark, d)
    c = chunks.chunks(corpus.symbols(f), f, max_chars=10_000_000).where(F.size("symbol_names") > 0).select("path", "chunk_index", "symbol_names")
    members = c.groupBy("path", F.floor(F.col("chunk_index") / 3).cast("int").alias("group_no")).agg(F.array_sort(F.collect_list(F.struct("chunk_index", "symbol_names"))).alias("members"))
    out = chunks.assign(members.join(_found(c), ["path", "group_no"]))
    return out.select("path", "chunk_index", F.array_join(F.array_sort(F.transform("symbols", lambda s: s["name"])), ",").alias("names"), "overview")


EDITED = f"""old as (with {FILES}, {LINES}, {SYMBOLS}, {REGIONS}, {WHOLE} select path, n, sha256(content) as h from t),
new as (with f as (with {FILES} select path, case when seq % 7 = 0 then content || ' changed' else content end as content, seq, lang, source, doc_id from f where seq % 13 <> 5), {LINES}, {SYMBOLS}, {REGIONS}, {WHOLE} select path, n, sha256(content) as h from t)"""


@query(f"with {EDITED} select path, n::int as chunk_index, h as content_hash, exists (select 1 from old where old.path = new.path and old.h = new.h) as reused from new")
def reanalyzed_chunks(spark, d):
    """A run after edits that is given the former version's chunks: only chunks of new content are asked about."""
    from loomdex.plans.workflow import analyze_parts

    f = corpus.texts(spark, d)
    settings = sources.Settings(concurrent_requests=int(spark.conf.get("spark.sql.shuffle.partitions")))
    old = chunks.chunks(corpus.symbols(f), f, settings.max_chunk_chars())
    entry = F.struct(F.lit("").alias("overview"), F.array().cast(f"array<{replies.SYMBOL}>").alias("symbols"))
    before = old.select("path", F.col("content_hash").alias("chunk_hash"), "chunk_index", entry.alias("result"))
    content = F.when(F.col("seq") % 7 == 0, F.concat("content", F.lit(" changed"))).otherwise(F.col("content"))
    new = f.where("seq % 13 <> 5").withColumn("content", content)
    out = analyze_parts(new, corpus.symbols(new), corpus.edges(spark, d), settings, previous=before)
    return out["chunks"].select("path", "chunk_index", F.col("chunk_hash").alias("content_hash"), "reused")


# Runs
@query(f"""with {FILES}, {LINES}, {SYMBOLS}, {REGIONS}, {EDGES}, {WHOLE}, c as (select path, count(*) as n_chunks, count(name) as n_symbols from t group by path), dp as (select src as path, count(*) as n from e group by src)
select f.path, {LANGUAGE} as language, case when c.path is null then '{index.TRIVIAL_OVERVIEW}' else 'Overview of ' || f.path || '.' end as overview, coalesce(c.n_symbols, 0)::int as n_symbols, coalesce(dp.n, 0)::int as n_dependencies,
coalesce(c.n_chunks, 0)::int as chunk_count from f left join c using (path) left join dp using (path)""")
def workflow_contexts(spark, d):
    """The whole run with the offline provider: files to contexts."""
    from loomdex.plans.workflow import analyze

    f = corpus.texts(spark, d)
    at_once = int(spark.conf.get("spark.sql.shuffle.partitions"))
    c = analyze(f, corpus.symbols(f), corpus.edges(spark, d), sources.Settings(concurrent_requests=at_once))
    return c.select("path", "language", "overview", F.size("symbols").alias("n_symbols"), F.size("dependencies").alias("n_dependencies"), "chunk_count")


@query(f"""with {FILES}, v(lang, n) as (values {_values((lang, len(x)) for lang, x in FOUND.items())})
select path, {LANGUAGE} as language, case when seq % 2 = 0 then 'From the cache' else 'Overview of ' || path || '.' end as overview, case when seq % 2 = 0 then 0 else n end::int as n_symbols, 1 as chunk_count from f join v using (lang)""")
def run_contexts(spark, d):
    """A whole run over code, every second file from the cache, the others in batches."""
    from loomdex.plans.workflow import CONTEXT_SYMBOL, full_run

    f = _code_files(spark, d).where("language <> 'unknown'")
    f = f.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    cached = f.where("seq % 2 = 0").select(
        T.content_hash(F.col("content")).alias("content_hash"), "path", "language", F.lit("From the cache").alias("overview"), F.array().cast(f"array<{CONTEXT_SYMBOL}>").alias("symbols"),
        F.array().cast("array<string>").alias("dependencies"), F.lit("T").alias("analyzed_at"), F.lit(1).alias("chunk_count"),
    )
    out = full_run(f, cached, sources.Settings(concurrent_requests=4))
    return out["contexts"].select("path", "language", "overview", F.size("symbols").alias("n_symbols"), "chunk_count")


@query(f"with {FILES} select path, sha256(content) as content_hash, size_bytes from f where lang in ('en', 'fr', 'de', 'es')")
def tree_round_trip(spark, d):
    """Files written one by one below the shared folder and scanned again."""
    root = f"{checkpoint_dir(spark)}/tree-{uuid.uuid4().hex}"
    sinks.write_files(corpus.texts(spark, d).select("path", F.col("content").alias("text")), root)
    return sources.read_tree(spark, root).select("path", T.content_hash(F.col("content")).alias("content_hash"), "size_bytes")


@query(f"with {FILES}, {EDGES} select src, pos, dst from e")
def published_edges(spark, d):
    """Two versions published, the last one read."""
    root, e = f"{checkpoint_dir(spark)}/index-{uuid.uuid4().hex}", corpus.edges(spark, d)
    sinks.publish({"edges": e.where("pos = 0")}, root, "first")
    sinks.publish({"edges": e}, root, "second")
    return sinks.current(spark, root, "edges")


@query(f"""with {FILES}, {EDGES}, u as (select dst as path, src, row_number() over (partition by dst order by f.seq) as k from e join f on f.path = e.src) select path, string_agg(src, ',' order by k) as used_by from u where k <= 10 group by path""")
def first_importers(spark, d):
    e = corpus.edges(spark, d).join(corpus.files(spark, d).select(F.col("path").alias("src"), F.col("seq").alias("src_seq")), "src")
    return graph.first_importers(e).select("path", F.array_join("used_by", ",").alias("used_by"))


@query(f"""with {FILES}, {EDGES}, i as (select dst as path, count(*) as n from e group by dst) select f.path, 'context/' || f.path || '.md' as context_file, coalesce(i.n, 0)::int as n_importers from f left join i using (path)""")
def file_index(spark, d):
    f = corpus.files(spark, d)
    return index.file_index(f.select("path"), graph.reverse_edges(corpus.edges(spark, d), f.select("path", "seq"))).select("path", "context_file", F.size("imported_by").alias("n_importers"))


@query(f"""with {FILES} select path, sha256('File: ' || path || chr(10) || 'Language: ' || {LANGUAGE} || case when seq % 3 = 0 then '' else chr(10) || 'Part: ' || (seq % 3) || '/' || 2 end
|| case when seq % 3 = 2 then chr(10) || 'Fields: symbols; leave overview empty' else chr(10) || 'Fields: overview, symbols' end || chr(10) || '```' || chr(10) || content || chr(10) || '```') as prompt_hash from f""")
def file_prompts(spark, d):
    f = corpus.files(spark, d).withColumns({
        "n_groups": F.when(F.col("seq") % 3 == 0, 1).otherwise(2), "group_no": F.when(F.col("seq") % 3 == 0, 0).otherwise((F.col("seq") % 3 - 1).cast("int")), "wants_overview": F.col("seq") % 3 != 2,
        "symbol_names": F.array().cast("array<string>"), "dep_context": F.lit(None).cast("string"), "combined_content": F.col("content"),
    })
    return f.select("path", T.content_hash(providers.prompt()).alias("prompt_hash"))


@query(f"""with {FILES}, b as (select *, (row_number() over (order by seq) - 1) // 6 as batch from f where size_bytes <= 6000), x as (select *, row_number() over (partition by batch order by seq) as k from b)
select batch::bigint as batch, sha256('{providers.BATCH_HEAD}' || chr(10) || 'Paths: ' || string_agg(path, ', ' order by k) || chr(10) || 'Form: {{' || string_agg('"' || path || '": {{"overview": "...", "symbols": []}}', ', ' order by k) filter (k <= 2) || '}}' || chr(10) || chr(10)
|| string_agg('File: ' || path || chr(10) || 'Language: ' || {LANGUAGE} || chr(10) || '```' || chr(10) || content || chr(10) || '```', chr(10) || chr(10) order by k)) as prompt_hash from x group by batch""")
def batch_prompts(spark, d):
    f = corpus.files(spark, d)
    b = f.join(chunks.batch_plan(f).where("is_small").select("path", "batch"), "path").withColumns({"symbol_names": F.array().cast("array<string>"), "dep_context": F.lit(None).cast("string")})
    m = b.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("seq", "path", providers.batch_section().alias("section")))).alias("m"))
    return m.select("batch", T.content_hash(providers.batch_prompt(F.transform("m", lambda x: x["section"]), F.transform("m", lambda x: x["path"]))).alias("prompt_hash"))


@query("""select event_id, event_id % 5 < 3 as retryable from events""")
def retryable_errors(spark, d):
    said = F.array(*(F.lit(x) for x in ("read ECONNRESET", "fetch failed", "network down", "network: context size exceeded", "bad key")))
    return table(spark, d, "events").select("event_id", providers.is_retryable(F.element_at(said, (F.col("event_id") % 5 + 1).cast("int"))).alias("retryable"))


@query("""select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad((epoch_us(ts) % 1000000 // 1000)::varchar, 3, '0') || 'Z' as iso from events""")
def iso_times(spark, d):
    return table(spark, d, "events").select("event_id", T.iso_time(F.col("ts")).alias("iso"))


# Changes
@query(f"""with {FILES}, h as (select path, seq, case when seq % 9 = 0 then '' else sha256(content) end as content_hash from f) select path, content_hash <> '' and content_hash in (select content_hash from h where seq % 2 = 0) as cached from h""")
def cache_guard(spark, d):
    """Files whose hash is empty never hit the cache."""
    f = corpus.files(spark, d).select("path", "seq", F.when(F.col("seq") % 9 == 0, "").otherwise(T.content_hash(F.col("content"))).alias("content_hash"))
    return cache.partition_by_cache(f, f.where("seq % 2 = 0")).select("path", "cached")


def _status(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    f = corpus.files(spark, d)
    line = lambda n, *kinds: F.element_at(F.array(*(F.lit(k) for k in kinds)), (F.col("seq") % n + 1).cast("int"))
    tab = F.lit("\t")
    renamed = F.concat(F.lit("R100\told/"), "path", tab, "path")
    committed = f.where("seq % 5 < 4").select(F.when(F.col("seq") % 5 == 3, renamed).otherwise(F.concat(line(5, "A", "M", "D", "R", ""), tab, F.col("path"))).alias("line"))
    uncommitted = f.where("seq % 7 < 2").select(F.concat(line(7, "D", "M", "", "", "", "", ""), tab, F.col("path")).alias("line"))
    return changes.name_status(committed), changes.name_status(uncommitted), f.where("seq % 11 = 0").select("path")


CHANGES = f"""{FILES}, k as (select path, seq % 5 in (0, 1, 3) as c, seq % 5 = 2 as cd, seq % 7 = 1 as m, seq % 7 = 0 as d, seq % 11 = 0 as u from f
 union all select 'old/' || path, false, true, false, false, false from f where seq % 5 = 3), g as (select path, (c or m or u) and not d as needs_analysis, d or (cd and not m) as deleted from k where c or cd or m or d or u)"""


@query(f"with {CHANGES} select path, needs_analysis, deleted from g")
def change_union(spark, d):
    return changes.changed_files(*_status(spark, d))


@query(f"with {CHANGES} select path, 'analyze' as action from g where needs_analysis and path in (select path from f where seq % 4 <> 0) union all select path, 'delete' from g where deleted and path in (select path from f where seq % 3 <> 0)")
def relevant_changes(spark, d):
    f = corpus.files(spark, d)
    return changes.relevant(changes.changed_files(*_status(spark, d)), f.where("seq % 4 <> 0"), f.where("seq % 3 <> 0"))


# Replies
@query("""select doc_id, case doc_id % 6 when 0 then '{"overview":"About ' || doc_id || '","symbols":[]}' when 1 then '{"a":' || doc_id || '}' when 2 then '{"a":' || doc_id || '}' when 3 then '{"a":"} {' || doc_id || '"}' end as found from documents""")
def extract_json(spark, d):
    i = F.col("doc_id").cast("string")
    made = [F.concat(F.lit('{"overview": "About '), i, F.lit('", "symbols": []}')), F.concat(F.lit('Sure: {"a": '), i, F.lit("}\nAnything else?")), F.concat(F.lit('```json\n{"a": '), i, F.lit("}\n```")), F.concat(F.lit('It is {"a": "} {'), i, F.lit('"} so')), F.concat(F.lit('{"a": '), i), F.lit("no object")]
    reply = F.element_at(F.array(*made), (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", reply.alias("reply")).select("doc_id", replies.extract_json("reply").alias("found"))


@query("""select doc_id, case when doc_id % 3 = 0 then 'unknown' else 'f' || doc_id end as name, case when doc_id % 3 = 0 then 'unknown' else 'function' end as kind, case when doc_id % 3 = 0 then 0 else doc_id % 1000 end::int as line,
case when doc_id % 3 = 1 then 'p' else '' end as purpose, '' as behavior, case when doc_id % 3 = 1 then 'x' end as parameters, null::varchar as returns from documents""")
def normalize_symbols(spark, d):
    i = F.col("doc_id").cast("string")
    some = F.concat(F.lit('{"symbols":[{"name":"f'), i, F.lit('","kind":"function","line":'), (F.col("doc_id") % 1000).cast("string"), F.when(F.col("doc_id") % 3 == 1, ',"purpose":"p","parameters":"x"').otherwise(""), F.lit("}]}"))
    f = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, '{"symbols":[{}]}').otherwise(some).alias("reply"))
    s = f.select("doc_id", F.explode(replies.normal_symbols(replies.parse_reply(F.col("reply"))["symbols"])).alias("s"))
    return s.select("doc_id", "s.name", "s.kind", "s.line", "s.purpose", "s.behavior", "s.parameters", "s.returns")


@query(f"with {FILES} select path, case seq % 3 when 0 then 'By path ' || seq when 1 then 'By name ' || seq else '' end as overview from f")
def batch_replies(spark, d):
    i = F.col("seq").cast("string")
    entry = lambda key, text: F.concat(F.lit('{"'), key, F.lit('": {"overview": "'), F.lit(text), i, F.lit('"}, "else": {"overview": "no"}}'))
    name = T.basename(F.col("path"))
    reply = F.when(F.col("seq") % 3 == 0, entry(F.col("path"), "By path ")).when(F.col("seq") % 3 == 1, entry(name, "By name ")).otherwise('{"else": {"overview": "no"}}')
    f = corpus.files(spark, d).select("path", reply.alias("reply"))
    found = F.from_json(replies.extract_json("reply"), replies.BATCH_REPLY)
    return f.select("path", F.coalesce(replies.batch_entry(found, F.col("path"))["overview"], F.lit("")).alias("overview"))


@query("""with c as (select event_type as provider, user_id, trunc(value * 100)::bigint as tokens, event_id % 3 = 0 as whole, cast(json_extract_string(props, '$.k') as bigint) as ms, event_id % 17 = 0 as failed from events)
select user_id, 'stub' as provider, count(*) as request_count, sum(ms)::bigint as duration_ms, coalesce(sum(case when not whole then tokens end), 0)::bigint as input_tokens,
coalesce(sum(case when not whole then floor(tokens / 2.0) end), 0)::bigint as output_tokens, coalesce(sum(case when whole then tokens end), 0)::bigint as unsplit_tokens, count(*) filter (failed) as errors from c group by user_id""")
def run_records(spark, d):
    """A record a run, as a run appends it to the history; here each user's calls are a run."""
    e = table(spark, d, "events").select("event_id", "user_id")
    c = corpus.calls(spark, d).join(e, "event_id").withColumn("error", F.when(F.col("event_id") % 17 == 0, "x"))
    r = usage.run_record(c, "stub", "user_id")
    return r.select("user_id", "provider", "request_count", "duration_ms", "input_tokens", "output_tokens", "unsplit_tokens", "errors")
