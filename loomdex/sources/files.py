"""File tables: path, content, language, size_bytes, seq (scan order)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomdex.functions import text as T

# Defaults of the settings.
EXTENSIONS = (
    ".ts .tsx .js .jsx .py .go .rs .java .cs .cpp .c .h .hpp .rb .php .swift .kt .scala .vue .svelte"
).split()
EXCLUDES = (
    "**/node_modules/** **/.git/** **/dist/** **/build/** **/out/** **/*.min.js **/*.lock **/package-lock.json **/yarn.lock"
).split()
STATE_DIR = ".loomdex"
DEFAULT_INCLUDE = "# Directories to include (scanned recursively)\nsrc\n\n# Individual files\n# main.ts\n\n# Lines starting with # are comments\n"


@dataclass(frozen=True)
class Settings:
    """All options and their defaults."""

    provider: str = "stub"
    model: str = ""
    base_url: str = ""
    requests_per_minute: int = 12
    max_file_size_kb: int = 200
    local_context_size: int = 4096
    compat_context_size: int = 8192
    concurrent_requests: int = 1
    auto_update: bool = False
    extensions: tuple[str, ...] = field(default_factory=lambda: tuple(EXTENSIONS))
    excludes: tuple[str, ...] = field(default_factory=lambda: (*EXCLUDES, f"**/{STATE_DIR}/**"))
    exclude_mode: str = "glob"

    def max_chunk_chars(self) -> int:
        """60,000, or what a smaller context leaves after 4,396 tokens at four characters each, 2,000 at least."""
        size = {"local": self.local_context_size, "openai-compat": self.compat_context_size}.get(self.provider)
        return 60_000 if size is None else max(2000, (size - 4396) * 4)

    def batch_files(self) -> bool:
        return self.provider != "local"

    def effective_rpm(self) -> int:
        """Own servers get 10,000; the offline stub has no limit."""
        return {"stub": 10**9, "local": 10_000, "openai-compat": 10_000}.get(self.provider, self.requests_per_minute)


def files(df: DataFrame) -> DataFrame:
    """Adds language and size to rows (path, content, seq). Rows with one path: the last by seq stays."""
    d = df.groupBy("path").agg(F.max_by("content", "seq").alias("content"), F.min("seq").alias("seq"))
    return d.select("path", "content", T.language_of(F.col("path")).alias("language"), F.coalesce(F.octet_length("content"), F.lit(0)).cast("long").alias("size_bytes"), "seq")


def read_tree(spark: SparkSession, root: str, settings: Settings = Settings()) -> DataFrame:
    """The files below ``root`` with an included extension, exclusions and the state folder left out, by path."""
    base = root.rstrip("/")
    glob = "*{" + ",".join(settings.extensions) + "}"
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(base, wholetext=True)
    d = raw.select(below(F.col("_metadata.file_path"), base).alias("path"), F.col("value").alias("content"))
    return number_by_path(keep_source(d, settings))


SCHEME = "^[a-z][a-z0-9+.-]*:/*"


def below(address: Column, root: str) -> Column:
    """A file's address as a path below ``root``, whatever scheme either is written with."""
    bare = re.sub(SCHEME, "/", root.rstrip("/"))
    return F.substring(F.regexp_replace(F.url_decode(F.replace(address, F.lit("+"), F.lit("%2B"))), SCHEME, "/"), len(bare) + 2, 1 << 20)


def number_by_path(d: DataFrame) -> DataFrame:
    """seq follows the code units of the path; the numbers are the path itself, so no global sort is needed."""
    return d.select("path", "content", T.language_of(F.col("path")).alias("language"), F.coalesce(F.octet_length("content"), F.lit(0)).cast("long").alias("size_bytes"), F.col("path").alias("seq"))


def keep_source(d: DataFrame, settings: Settings = Settings()) -> DataFrame:
    p = F.col("path")
    return d.where(T.extension(p).isin(*settings.extensions) & ~p.startswith(f"{STATE_DIR}/") & ~excluded(p, settings.excludes, settings.exclude_mode))


def glob_regex(pattern: str, mode: str = "glob") -> str:
    """A glob as a regular expression. 'compat' keeps an old translation that leaves dots and ends open and
    turns every star, those of '**' included, into one path part."""
    if mode == "compat":
        return pattern.replace("**", ".*").replace("*", "[^/]*")
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + ("\\" if pattern[i] in r".+^$|()[]{}\\" else "") + pattern[i], i + 1
    return f"^{out}$"


def excluded(path: Column, patterns, mode: str = "glob") -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike(glob_regex(p, mode))
    return out


def parse_include(text: Column) -> Column:
    """Entries of an include list: trimmed lines that are neither empty nor comments."""
    return F.filter(F.transform(F.split(text, "\n"), T.js_trim), lambda x: (x != "") & ~x.startswith("#"))


def include_scan(all_files: DataFrame, entries: DataFrame) -> DataFrame:
    """Files that an entry (column ``entry``: a file, or a folder with all below) names: every ancestor of a path is
    looked up, so the semi-join is an equi-join; overlapping entries give a file once."""
    parts = F.split("path", "/")
    up = all_files.withColumn("entry", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))))
    clean = entries.select(F.regexp_replace("entry", r"^\./|/+$", "").alias("entry"))
    hit = up.join(clean.distinct(), "entry", "left_semi").select("path").distinct()
    whole = clean.agg(F.coalesce(F.max(F.col("entry").isin("", ".")), F.lit(False)).alias("whole")).scalar()
    mark = all_files.join(hit.withColumn("__named", F.lit(True)), "path", "left")
    return mark.where(F.col("__named").isNotNull() | whole).drop("__named")


def collect(spark: SparkSession, root: str, settings: Settings = Settings(), include_file: str = "include") -> DataFrame:
    """The files that the include list in the state folder names, where there is one; else all that a scan keeps."""
    entries = read_text(spark, f"{root.rstrip('/')}/{STATE_DIR}/{include_file}")
    found = read_tree(spark, root, settings)
    if entries is None:
        return found
    text = spark.createDataFrame([(entries,)], "text string")
    return include_scan(found, text.select(F.explode(parse_include(F.col("text"))).alias("entry")))


def write_default_include(spark: SparkSession, root: str, include_file: str = "include") -> str:
    """Writes the default include list, unless there is one, and returns its address."""
    path = f"{root.rstrip('/')}/{STATE_DIR}/{include_file}"
    if not exists(spark, path):
        fs, p = _store(spark, path)
        out = fs.create(p, False)
        out.write(bytearray(DEFAULT_INCLUDE.encode()))
        out.close()
    return path


def _store(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _store(spark, path)
    return bool(fs.exists(p))


def size_kb(spark: SparkSession, path: str) -> float:
    """Kilobytes of a file; 0 where it is not there."""
    fs, p = _store(spark, path)
    return fs.getFileStatus(p).getLen() / 1024 if fs.exists(p) else 0.0


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None where it is not there."""
    return spark.read.text(path, wholetext=True).first().value if size_kb(spark, path) else "" if exists(spark, path) else None


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The table of a JSON file or folder; None where it is not there or holds no row of ``schema``."""
    if not exists(spark, path):
        return None
    d = spark.read.schema(f"{schema}, __bad string").option("multiLine", "true").option("columnNameOfCorruptRecord", "__bad").json(path).cache()
    good = d.where("__bad IS NULL").drop("__bad")
    return None if good.isEmpty() else good


def size_capped(d: DataFrame, max_kb: int) -> DataFrame:
    return d.where(F.col("size_bytes") / 1024 <= max_kb * 5)


def vue_script(content: Column) -> Column:
    """(script, language, line_offset) of the first script block of a single-file component; null without one."""
    pattern = r"(?s)<script(\b[^>]*)>(.*?)</script>"
    body, attrs = F.regexp_extract(content, pattern, 2), F.regexp_extract(content, pattern, 1)
    before = F.regexp_extract(content, r"(?s)^(.*?<script\b[^>]*>).*?</script>", 1)
    found = F.struct(
        body.alias("script"), F.when(attrs.rlike("\\blang=[\"']ts[\"']"), "typescript").otherwise("javascript").alias("language"),
        (F.size(F.split(before, "\n", -1)) - 1).alias("line_offset"),
    )
    return F.when(content.rlike(pattern), found)
