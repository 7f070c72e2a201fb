"""Column expressions over paths, texts and hashes. All are built-in functions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Extension to language, as parsers and the graph name them.
LANGUAGE_OF_EXTENSION = {
    ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".py": "python",
    ".go": "go", ".rs": "rust", ".java": "java", ".vue": "vue",
}
# Extension to grammar.
GRAMMAR_OF_EXTENSION = {
    ".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "javascript", ".py": "python",
    ".go": "go", ".rs": "rust", ".java": "java",
}
# Extension to the name shown to people.
DISPLAY_LANGUAGE = {
    ".ts": "TypeScript", ".tsx": "TypeScript (React)", ".js": "JavaScript", ".jsx": "JavaScript (React)", ".py": "Python",
    ".go": "Go", ".rs": "Rust", ".java": "Java", ".cs": "C#", ".cpp": "C++", ".c": "C", ".h": "C/C++ Header", ".hpp": "C++ Header",
    ".rb": "Ruby", ".php": "PHP", ".swift": "Swift", ".kt": "Kotlin", ".scala": "Scala", ".vue": "Vue", ".svelte": "Svelte",
}
# Words that carry no meaning for the keyword index.
STOP_WORDS = (
    "the a an and or but in on at to for of with by from as is are was were be been being have has had do does did will "
    "would could should may might shall can that this it its not if then else when where which who how what why all any both "
    "each into through during before after above below up down out off over under again further once also just only own same "
    "so than too very s t now don no such whether either neither upon while"
).split()
#: White space as script engines define it.
SPACE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
TRIVIAL_CHARS = 50


SPACES = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def js_trim(c: Column) -> Column:
    return F.trim(c, F.lit(SPACES))


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units, which chunk budgets are counted in."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def dirname(path: Column) -> Column:
    """Up to the last slash, else '.'."""
    return F.when(F.instr(path, "/") > 0, F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)).otherwise(F.lit("."))


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; a name that begins with its only dot has none."""
    return F.lower(F.regexp_extract(basename(path), r"^.+?(\.[^.]*)$", 1))


def lookup(key: Column, table: dict[str, str], otherwise: str) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, key), F.lit(otherwise))


def language_of(path: Column) -> Column:
    return lookup(extension(path), LANGUAGE_OF_EXTENSION, "unknown")


def display_language_of(path: Column) -> Column:
    return lookup(extension(path), DISPLAY_LANGUAGE, "Unknown")


def grammar_of(path: Column) -> Column:
    return F.nullif(lookup(extension(path), GRAMMAR_OF_EXTENSION, ""), F.lit(""))


def normal_path(path: Column) -> Column:
    """Folds '.', '..' and empty parts; what climbs above the root keeps its '..'."""

    def step(acc, part):
        climbs = (part == "..") & (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != "..")
        return F.when((part == "") | (part == "."), acc).when(climbs, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.concat(acc, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def relative_path(base: Column, path: Column) -> Column:
    """``path`` as seen from the folder ``base``."""
    here, there = F.split(normal_path(base), "/"), F.split(normal_path(path), "/")
    same = F.aggregate(F.sequence(F.lit(1), F.least(F.size(here), F.size(there))), F.lit(0), lambda n, i: F.when((n == i - 1) & (F.get(here, i - 1) == F.get(there, i - 1)), i).otherwise(n))
    return F.array_join(F.concat(F.array_repeat(F.lit(".."), F.size(here) - same), F.slice(there, same + 1, F.size(there))), "/")


def iso_time(ts: Column) -> Column:
    """As in 2024-01-31T12:00:00.000Z, whatever the session's zone."""
    return F.date_format(ts.cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_now() -> Column:
    return iso_time(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()))


def content_hash(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def git_blob_hash(text: Column) -> Column:
    head = F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(text).cast("string")), "UTF-8"), F.unhex(F.lit("00")))
    return F.sha1(F.concat(head, F.encode(text, "UTF-8")))


def meaningful_words(text: Column) -> Column:
    """Distinct words of three or more of a-z, 0-9 and _, in lower case, stop words left out, first seen first."""
    words = F.split(F.lower(text), "[^a-z0-9_]+")
    stop = F.array(*(F.lit(w) for w in STOP_WORDS if len(w) >= 3))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w)))


def exploded_words(rows, text: str, *keep):
    """Rows (*keep, word) of the meaningful words of ``text``: as above, with the tests behind the explosion, where they are compiled."""
    d = rows.select(*keep, F.explode(F.array_distinct(F.split(F.lower(F.col(text)), "[^a-z0-9_]+"))).alias("word"))
    return d.where((F.length("word") >= 3) & ~F.col("word").isin(*STOP_WORDS))


def inline_overview(text: Column) -> Column:
    """One line of at most 200 characters; a placeholder where there is nothing to show."""
    flat = js_trim(F.regexp_replace(F.regexp_replace(text, r"[\r\n]+", " "), f"{SPACE}{{2,}}", " "))
    short = F.when(F.length(flat) > 200, F.concat(F.substring(flat, 1, 197), F.lit("…"))).otherwise(flat)
    return F.when(F.coalesce(js_trim(text), F.lit("")) == "", F.lit("_No overview available_")).otherwise(short)


def signature(line: Column) -> Column:
    return F.substring(js_trim(line), 1, 120)


def is_trivial(n_symbols: Column, content: Column) -> Column:
    return (n_symbols == 0) & (F.length(js_trim(content)) < TRIVIAL_CHARS)


def is_decorator(line: Column) -> Column:
    """Lines that belong to the declaration below: annotations, attributes, comments, but no shebang."""
    t = js_trim(line)
    return t.startswith("@") | t.startswith("*") | t.startswith("//") | t.startswith("/**") | (t.startswith("#") & ~t.startswith("#!"))


def branch_dir(branch: Column) -> Column:
    return F.replace(branch, F.lit("/"), F.lit("--"))


def escape_regex(c: Column) -> Column:
    return F.regexp_replace(c, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def chunk_lines(text: Column, most: Column | int) -> Column:
    """Array of chunks of whole lines with at most ``most`` UTF-16 units; a longer line is a chunk by itself.

    Blank lines at the head of a chunk are lost and an empty rest gives none; a text that fits is kept as it is.
    """
    most = F.lit(most) if isinstance(most, int) else most
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc, line):
        full = (utf16_length(acc["now"]) + utf16_length(line) + 1 > most) & (acc["now"] != "")
        joined = F.when(acc["now"] == "", line).otherwise(F.concat(acc["now"], F.lit("\n"), line))
        done = F.when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.when(full, line).otherwise(joined).alias("now"))

    def finish(acc):
        return F.when(acc["now"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"])))

    return F.when(utf16_length(text) <= most, F.array(text)).otherwise(F.aggregate(F.split(text, "\n", -1), empty, step, finish))
