"""Plans that must stay as they are: columns pruned at the scan, filters pushed down, no Python, no nested loops."""

import re

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name,columns", [
    ("content_hash", {"doc_id", "text", "lang", "source"}), ("files_by_directory", {"doc_id", "lang", "source"}), ("script_blocks", {"page_id", "html"}),
    ("rate_window", {"event_id", "ts", "event_type"}), ("debounce_sessions", {"user_id", "ts"}), ("files_by_language", {"doc_id", "text", "lang", "source"}),
])
def test_only_what_is_needed_is_read(spark, name, columns):
    read = set(re.findall(r"ReadSchema: struct<([^>]*)>", plan(entry.queries()[name](spark, SF))))
    assert {c.split(":")[0] for r in read for c in r.split(",")} <= columns


NATIVE = "keyword_index files_by_directory filter_trivial content_hash cache_partition chunk_delta batch_plan symbol_regions symbol_chunks chunk_refs import_edges reverse_edges graph_stats usage_averages rate_window debounce_sessions changed_files incremental_merge overview_lines context_markdown".split()


@pytest.mark.parametrize("name", NATIVE)
def test_no_python_and_no_nested_loops(spark, name):
    assert not re.search(r"Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan(entry.queries()[name](spark, SF)))


def test_filter_reaches_the_scan(spark):
    from loomdex.plans import corpus

    assert "PushedFilters: [IsNotNull(doc_id), GreaterThan(doc_id,5)]" in plan(corpus.files(spark, SF).where("seq > 5"))
