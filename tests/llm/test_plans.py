import re

import pytest

from loomdex.llm.queries import QUERIES
from tests.test_plans import SF, plan


@pytest.mark.parametrize("name", ["op2_mixing", "op6_linededup", "op8_urlfilter"])
def test_no_python(spark, name):
    p = plan(QUERIES[name](spark, SF))
    assert not re.search(r"Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", p)


def test_pages_are_read_without_their_html(spark):
    assert "html" not in plan(QUERIES["op8_urlfilter"](spark, SF))


@pytest.mark.parametrize("name", ["op3_media", "op4_packing"])
def test_no_shuffle(spark, name):
    assert "Exchange" not in plan(QUERIES[name](spark, SF))


def test_the_url_filter_meets_its_bitmaps_in_one_join(spark):
    p = plan(QUERIES["op8_urlfilter"](spark, SF))
    assert len(re.findall(r"\w+Join", p)) <= 2 and "Subquery" not in p
