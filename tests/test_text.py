import pytest
from pyspark.sql import functions as F

from loomdex.functions import replies, text as T


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


@pytest.mark.parametrize("path,ext,lang,shown,grammar", [
    ("a/b.ts", ".ts", "typescript", "TypeScript", "typescript"), ("b.TSX", ".tsx", "typescript", "TypeScript (React)", "tsx"), (".bashrc", "", "unknown", "Unknown", None),
    ("a.b/c", "", "unknown", "Unknown", None), ("x.tar.vue", ".vue", "vue", "Vue", None), ("q.hpp", ".hpp", "unknown", "C++ Header", None), ("m.jsx", ".jsx", "javascript", "JavaScript (React)", "javascript"),
])
def test_languages(spark, path, ext, lang, shown, grammar):
    p = F.col("p")
    d = spark.createDataFrame([(path,)], "p string").select(T.extension(p), T.language_of(p), T.display_language_of(p), T.grammar_of(p)).first()
    assert tuple(d) == (ext, lang, shown, grammar)


@pytest.mark.parametrize("path,want", [("a/./b/../c", "a/c"), ("../a", "../a"), ("a/../../b", "../b"), ("./x//y/", "x/y"), ("", ""), ("a/b/../..", "")])
def test_paths(spark, path, want):
    assert one(spark, T.normal_path(F.col("p")), p=path) == want


@pytest.mark.parametrize("text,words", [
    ("Validates user authentication tokens", ["validates", "user", "authentication", "tokens"]), ("the function is a helper for the user", ["function", "helper", "user"]),
    ("do it now ok", []), ("database database connection database", ["database", "connection"]), ("fetchUserData", ["fetchuserdata"]), ("", []), ("a_b été x9y", ["a_b", "x9y"]),
])
def test_words(spark, text, words):
    assert one(spark, T.meaningful_words(F.col("t")), t=text) == words


def test_hashes_and_lengths(spark):
    assert one(spark, T.git_blob_hash(F.col("t")), t="abc") == "f2ba8f84ab5c1bce84a7b441cb1959cfc7093b7f"
    assert one(spark, T.utf16_length(F.col("t")), t="a😀é") == 4
    assert one(spark, T.js_trim(F.col("t")), t="\u00a0\t x\n\ufeff") == "x"


@pytest.mark.parametrize("text,want", [("", "_No overview available_"), (None, "_No overview available_"), (" \n", "_No overview available_"), ("a\n\nb   c ", "a b c"), ("x" * 201, "x" * 197 + "…"), ("y" * 200, "y" * 200)])
def test_inline_overview(spark, text, want):
    assert one(spark, T.inline_overview(F.col("t")), t=text) == want


@pytest.mark.parametrize("text,most,want", [
    ("Hello world", 1000, ["Hello world"]), ("a" * 100, 100, ["a" * 100]), ("a" * 300, 100, ["a" * 300]), ("aaaa\nbbbb\ncccc\n\n\ndd", 10, ["aaaa\nbbbb", "cccc\n\n\ndd"]),
    ("\n\nabcdefghijklmnop\nz", 10, ["abcdefghijklmnop", "z"]), ("\n" * 20, 5, []), ("ab\ncd", 0, ["ab", "cd"]),
])
def test_chunk_lines(spark, text, most, want):
    assert one(spark, T.chunk_lines(F.col("t"), most), t=text) == want


@pytest.mark.parametrize("name,want", [("feature/my-feature", "feature--my-feature"), ("release/v1/beta", "release--v1--beta"), ("/hotfix", "--hotfix")])
def test_branch_dir(spark, name, want):
    assert one(spark, T.branch_dir(F.col("t")), t=name) == want


@pytest.mark.parametrize("reply,want", [
    ('{"a": 1}', '{"a":1}'), ('{"a":1}\n\nmore', '{"a":1}'), ("```json\n{\"a\":1}\n```", '{"a":1}'), ("```\n{\"a\":1}\n```", '{"a":1}'), ('See: {"a":{"b":"}"}} {', '{"a":{"b":"}"}}'),
    ('{"m":"He said \\"hi\\""}', '{"m":"He said \\"hi\\""}'), ("", None), ("none", None), ('{"a":', None), ("[1]", "[1]"), ("x {bad} y", None), ("NaN", None), ('{"é":"ü"} x', '{"é":"ü"}'),
])
def test_find_json(reply, want):
    assert replies.find_json(reply) == want
