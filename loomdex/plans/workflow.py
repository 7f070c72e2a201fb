"""Full, incremental and single-file runs over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomdex.functions import parsing, replies, text as T
from loomdex.operators import cache, chunks, graph, index, providers, sinks, usage
from loomdex.operators.storage import kept
from loomdex.sources import changes
from loomdex.sources.files import Settings, size_capped

CONTEXT_SYMBOL = "struct<name:string,kind:string,line:int,purpose:string,behavior:string,parameters:string,returns:string,limitations:string,used_by:array<string>,uses:array<string>>"
USED_BY = 10


def parse(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbols, edges) of files (path, content, seq). Parsing is done once a file; both come from it."""
    p = kept(parsing.parse_files(files.select("path", "content", "seq")).select("path", "seq", "parsed"))
    symbols = p.select("path", "seq", F.posexplode("parsed.symbols").alias("pos", "s")).select("path", "seq", "pos", "s.*")
    specs = p.select(F.col("path").alias("src"), F.posexplode("parsed.specs").alias("pos", "spec"))
    edges = graph.import_edges(specs, files.select("path", "seq"))
    return symbols, kept(edges.join(files.select(F.col("path").alias("src"), F.col("seq").alias("src_seq")), "src"))


def analyze(files: DataFrame, symbols: DataFrame, edges: DataFrame, settings: Settings = Settings(), make=providers.Stub, analyzed_at: str | None = None) -> DataFrame:
    """The contexts of ``analyze_parts``."""
    return analyze_parts(files, symbols, edges, settings, make, analyzed_at)["contexts"]


def analyze_parts(files: DataFrame, symbols: DataFrame, edges: DataFrame, settings: Settings = Settings(), make=providers.Stub, analyzed_at: str | None = None, previous: DataFrame | None = None) -> dict[str, DataFrame]:
    """Contexts of ``files`` (path, language, content), the chunk entries they are made of, and the calls that were made.

    contexts: path, language, overview, symbols, dependencies, analyzed_at, chunk_count. chunks: path,
    chunk_hash, chunk_index, result (overview, symbols), reused. calls: tokens, duration_ms, error.

    Chunks whose hash is among ``previous`` (chunk entries of former versions) keep their result; only
    the others are packed into groups and asked about. An answer is dealt to its group's chunks by the
    symbols they declare. The overview is asked for with a file's first group, unless a reused chunk
    has been there before. Trivial files get a fixed overview without a call; a file whose every
    call failed, and that reuses nothing, has an empty context; a failed group stores no entries,
    so the next run asks again.
    """
    none = F.array().cast("array<string>")
    budget = settings.max_chunk_chars()
    chunk = chunks.chunks(symbols, files, budget).persist()  # read by the branches below
    if previous is None:
        todo, reused = chunk, None
    else:
        mark = cache.chunk_delta(chunk, previous).persist()
        todo, reused = mark.where("NOT reused"), mark.where("reused")
    group = chunks.groups(todo, budget).persist()
    refs = chunks.references(todo, edges, symbols)
    member = group.select("path", "group_no", F.explode("chunk_indexes").alias("chunk_index"))
    wanted = chunks.dependency_context(refs.join(member, ["path", "chunk_index"]), edges, symbols, ["group_no"])
    counts = group.groupBy("path").agg(F.count(F.lit(1)).alias("n_groups"))
    ask = group.join(counts, "path").join(wanted, ["path", "group_no"], "left").join(files.select("path", "language"), "path")
    if reused is not None:
        ask = ask.join(reused.select("path", F.lit(True).alias("known")).distinct(), "path", "left")
    first = F.col("group_no") == 0
    ask = ask.withColumn("wants_overview", first if reused is None else first & F.col("known").isNull())
    # written once, so that no later action calls again
    said = kept(providers.call_model(ask.select("path", "group_no", providers.prompt().alias("prompt")), make, settings.effective_rpm(), settings.concurrent_requests).drop("prompt"))
    r = said.select("path", "group_no", replies.parse_reply(F.col("reply")).alias("r")).where("r IS NOT NULL")
    answers = group.select("path", "group_no", "members").join(r, ["path", "group_no"]).select("path", "group_no", "members", F.col("r.overview").alias("overview"), replies.normal_symbols(F.col("r.symbols")).alias("symbols"))
    entry = F.struct("overview", "symbols").alias("result")
    entries = chunks.assign(answers).join(todo.select("path", "chunk_index", F.col("content_hash").alias("chunk_hash")), ["path", "chunk_index"]).select("path", "chunk_hash", "chunk_index", entry, F.lit(False).alias("reused"))
    if reused is not None:
        entries = entries.unionByName(reused.select("path", F.col("content_hash").alias("chunk_hash"), "chunk_index", F.col("prior_result").alias("result"), F.lit(True).alias("reused")))
    # reused chunks come first, then the groups' answers as they were given
    said_by = answers.select("path", F.lit(1).alias("rank"), F.col("group_no").alias("place"), "overview", "symbols")
    if reused is not None:
        said_by = said_by.unionByName(reused.select("path", F.lit(0).alias("rank"), F.col("chunk_index").alias("place"), "prior_result.overview", "prior_result.symbols"))
    per = said_by.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("rank", "place", "overview", "symbols"))).alias("e"))
    texts = F.filter(F.transform("e", lambda x: F.coalesce(x["overview"], F.lit(""))), lambda x: x != "")
    per = per.select("path", F.array_join(texts, "\n\n").alias("overview"), F.flatten(F.transform("e", lambda x: x["symbols"])).alias("found"), F.lit(True).alias("ok"))
    n_chunks = chunk.groupBy("path").agg(F.count(F.lit(1)).cast("int").alias("n_chunks"))
    j = files.select("path", "language").join(n_chunks, "path", "left").join(per, "path", "left").join(imports_of(edges), "path", "left").join(graph.first_importers(edges, USED_BY), "path", "left")
    ok = F.coalesce("ok", F.lit(False))
    overview = F.when(F.col("n_chunks").isNull(), index.TRIVIAL_OVERVIEW).when(ok, F.col("overview")).otherwise("")
    full = decorated(F.coalesce("found", F.array().cast(f"array<{replies.SYMBOL}>")))
    contexts = j.select("path", "language", overview.alias("overview"), full.alias("symbols"), F.coalesce("dependencies", none).alias("dependencies"), stamp(analyzed_at), F.when(ok, F.col("n_chunks")).otherwise(0).alias("chunk_count"))
    return {"contexts": contexts, "chunks": entries, "calls": said.select("input_tokens", "output_tokens", "tokens_used", "duration_ms", "error")}


def imports_of(edges: DataFrame) -> DataFrame:
    """(path, dependencies), in their order."""
    return edges.groupBy(F.col("src").alias("path")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "dst"))), lambda x: x["dst"]).alias("dependencies"))


def decorated(symbols: Column) -> Column:
    """Symbols of an answer with the file's importers and imports (columns used_by, dependencies)."""
    none = F.array().cast("array<string>")
    names = ("name", "kind", "line", "purpose", "behavior", "parameters", "returns", "limitations")
    full = F.transform(symbols, lambda s: F.struct(*(s[n].alias(n) for n in names), F.coalesce("used_by", none).alias("used_by"), F.coalesce("dependencies", none).alias("uses")))
    return full.cast(f"array<{CONTEXT_SYMBOL}>")


def stamp(analyzed_at: str | None) -> Column:
    return (T.iso_now() if analyzed_at is None else F.lit(analyzed_at)).alias("analyzed_at")


def analyze_batches(files: DataFrame, symbols: DataFrame, edges: DataFrame, settings: Settings = Settings(), make=providers.Stub, analyzed_at: str | None = None) -> dict[str, DataFrame]:
    """What ``analyze_parts`` gives, with small files asked for together, six to a call.

    A file's entry is looked up by its path, then by its base name. Files that are large, trivial, or
    whose batch gave no usable answer go through ``analyze`` one by one. The answers are written to
    the shared folder once, so that no later action calls again.
    """
    n = symbols.groupBy("path").agg(F.count(F.lit(1)).alias("n_symbols"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("symbol_names"))
    none = F.array().cast("array<string>")
    f = files.join(n, "path", "left").withColumns({"n_symbols": F.coalesce("n_symbols", F.lit(0)), "symbol_names": F.coalesce("symbol_names", none)})
    plan = chunks.batch_plan(f.where(~T.is_trivial(F.col("n_symbols"), F.col("content"))).select("path", "seq", "size_bytes")).where("is_small").select("path", "batch")
    small = f.join(plan, "path").join(chunks.export_context(edges, symbols), "path", "left")
    sections = small.select("batch", "seq", "path", providers.batch_section().alias("section")).groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("seq", "path", "section"))).alias("m"))
    ask = sections.select(F.transform("m", lambda x: x["path"]).alias("paths"), providers.batch_prompt(F.transform("m", lambda x: x["section"]), F.transform("m", lambda x: x["path"])).alias("prompt"))
    said = kept(providers.call_model(ask, make, settings.effective_rpm(), settings.concurrent_requests, providers.MAX_TOKENS_BATCH).drop("prompt"))
    found = said.select(F.explode("paths").alias("path"), F.from_json(replies.extract_json("reply"), replies.BATCH_REPLY).alias("all")).where("all IS NOT NULL AND size(all) > 0")
    got = found.select("path", replies.batch_entry(F.col("all"), F.col("path")).alias("r"))
    j = got.join(files.select("path", "language"), "path").join(imports_of(edges), "path", "left").join(graph.first_importers(edges, USED_BY), "path", "left")
    full, d = decorated(replies.normal_symbols(F.col("r.symbols"))), F.coalesce("dependencies", none)
    batched = j.select("path", "language", F.coalesce("r.overview", F.lit("")).alias("overview"), full.alias("symbols"), d.alias("dependencies"), stamp(analyzed_at), F.lit(1).alias("chunk_count"))
    rest = analyze_parts(files.join(found.select("path"), "path", "left_anti"), symbols, edges, settings, make, analyzed_at)
    calls = said.select("input_tokens", "output_tokens", "tokens_used", "duration_ms", "error").unionByName(rest["calls"])
    return {"contexts": batched.unionByName(rest["contexts"]), "chunks": rest["chunks"], "calls": calls}


def build_index(contexts: DataFrame, edges: DataFrame, files: DataFrame, blocks: int = 1) -> dict[str, DataFrame]:
    """Index tables: files, symbols, keywords, totals. A word's references are dealt over ``blocks`` rows by their file."""
    f = index.file_index(contexts, graph.reverse_edges(edges, files.select("path", "seq")))
    s = contexts.join(files.select("path", "seq"), "path").select("path", "seq", F.posexplode("symbols").alias("pos", "s")).select(F.col("path").alias("file"), "seq", "pos", "s.*")
    words = index.keyword_index(s.select(index.symbol_text().alias("text"), F.concat("file", F.lit("::"), "name").alias("ref"), "file"), "text", "ref", F.pmod(F.xxhash64("file"), F.lit(blocks)))
    return {"files": f, "symbols": s, "keywords": words, "totals": index.index_totals(f, s)}


def full_run(files: DataFrame, store: DataFrame | None = None, settings: Settings = Settings(), make=providers.Stub, analyzed_at: str | None = None, history: str | None = None) -> dict[str, DataFrame]:
    """All tables of a run over files (path, content, language, size_bytes, seq). ``store``: cached contexts by
    content_hash, each used under the path that asks for it. The run's usage row is appended to ``history``, where that names a folder."""
    symbols, edges = parse(files)
    hashed = size_capped(files, settings.max_file_size_kb).withColumn("content_hash", T.content_hash(F.col("content")))
    if store is None:
        cached, todo = None, hashed
    else:
        mark = cache.partition_by_cache(hashed, store)
        todo = mark.where("NOT cached")
        cached = mark.where("cached").select("path", "content_hash").join(store.drop("path").dropDuplicates(["content_hash"]), "content_hash").drop("content_hash")
    parts = (analyze_batches if settings.batch_files() else analyze_parts)(todo, symbols, edges, settings, make, analyzed_at)
    fresh = kept(parts["contexts"])
    contexts = fresh if cached is None else cached.unionByName(fresh, allowMissingColumns=True)
    new_store = fresh.where("chunk_count > 0").join(todo.select("path", "content_hash"), "path")
    run = record(parts["calls"], fresh, cached, settings, history)
    tables = {"graph_files": files.drop("content"), "graph_symbols": symbols, "edges": edges.drop("src_seq"), "contexts": contexts, "chunks": parts["chunks"], "cache": new_store, "branch": hashed.select("path", "content_hash"), "usage": run}
    return tables | {f"index_{k}": v for k, v in build_index(contexts, edges, files).items()}


def record(calls: DataFrame, fresh: DataFrame, cached: DataFrame | None, settings: Settings, history: str | None) -> DataFrame:
    """The usage row of a run, appended to ``history`` where that is given."""
    count = lambda d: F.lit(0).cast("long") if d is None else d.agg(F.count(F.lit(1))).scalar()
    run = usage.run_record(calls, settings.provider).select("*", count(fresh).alias("files_analyzed"), count(cached).alias("files_from_cache"), F.current_timestamp().alias("ts"), F.unix_micros(F.current_timestamp()).alias("seq"))
    run = kept(run)
    if history:
        usage.append_runs(run, history)
    return run


def incremental_run(files: DataFrame, branch: DataFrame, contexts: DataFrame, settings: Settings = Settings(), make=providers.Stub, analyzed_at: str | None = None, previous: DataFrame | None = None, changed: DataFrame | None = None, head: str | None = None, history: str | None = None) -> dict[str, DataFrame]:
    """Tables after a change: only files whose hash differs from ``branch`` (path, content_hash) are analysed, of
    these only chunks that ``previous`` (chunk entries) lacks.

    ``changed`` (path, needs_analysis, deleted), as a version control system tells it, narrows the work
    to its paths. A file whose analysis fails keeps its former context, and its hash is not
    recorded, so that the next run tries again. ``state`` is the branch's row: head and time.
    """
    symbols, edges = parse(files)
    now = files.withColumn("content_hash", T.content_hash(F.col("content")))
    diff = changes.snapshot_diff(branch, now.select("path", "content_hash"))
    if changed is not None:
        diff = diff.join(changed.where("needs_analysis OR deleted").select("path").distinct(), "path", "left_semi")
    gone = diff.where("change = 'deleted'").select("path")
    todo = now.join(diff.where("change <> 'deleted'").select("path"), "path", "left_semi")
    parts = analyze_parts(todo, symbols, edges, settings, make, analyzed_at, previous)
    fresh, entries = kept(parts["contexts"]), kept(parts["chunks"])
    ok = fresh.where(f"chunk_count > 0 OR overview = '{index.TRIVIAL_OVERVIEW}'")
    merged = cache.merge_contexts(contexts, ok, diff, gone)
    state = cache.merge_branch(branch, todo.join(ok.select("path"), "path", "left_semi").select("path", "content_hash"), gone)
    if previous is not None:
        entries = previous.join(entries.select("path").union(gone).distinct(), "path", "left_anti").unionByName(entries, allowMissingColumns=True)
    run = record(parts["calls"], fresh, None, settings, history)
    about = files.sparkSession.range(1).select(F.lit(head).alias("head"), T.iso_now().alias("last_indexed_at"))
    return {"contexts": merged, "chunks": entries, "branch": state, "state": about, "deleted": gone, "edges": edges.drop("src_seq"), "usage": run} | {f"index_{k}": v for k, v in build_index(merged, edges, files).items()}


def single_file(files: DataFrame, path: str, settings: Settings = Settings(), make=providers.Stub) -> DataFrame:
    """The context of one file, its dependencies resolved against all; index tables stay as they are."""
    symbols, edges = parse(files)
    return analyze(files.where(F.col("path") == path), symbols, edges, settings, make)


def keep_indexed(stream: DataFrame, files, root: str, checkpoint: str, settings: Settings = Settings(), make=providers.Stub):
    """A stream writer that runs ``incremental_run`` for each batch of change events (path, ...) and publishes its tables below ``root``.

    ``files`` is called for the files as they are now. A version must have been published before, by
    ``full_run``; a batch that is run again starts from the version before it, so it gives the same tables.
    """

    def update(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        named = f"stream-{number}"
        before = sinks.latest_version(spark, root, but=named)
        table = lambda name: spark.read.parquet(f"{root}/{before}/{name}")
        touched = batch.select("path", F.lit(True).alias("needs_analysis"), F.lit(True).alias("deleted")).distinct()
        out = incremental_run(files(), table("branch"), table("contexts"), settings, make, previous=table("chunks"), changed=touched)
        sinks.publish({n: out[n] for n in ("branch", "contexts", "chunks", "edges", "index_files", "index_symbols", "index_keywords", "index_totals")}, root, named)

    return stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint)
