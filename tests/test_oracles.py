import glob
import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))

from compare_oracles import compare  # noqa: E402

from docproof import registry  # noqa: E402


class Core:
    queries = staticmethod(registry.queries)
    oracle_sql = staticmethod(registry.oracle_sql)


#: Queries that no SQL states, and the tests that hold them to a plain statement of what they do; and those that find nothing in these tables.
WITHOUT_SQL = {"name_similarity": "test_name_similarity", "quote_match": "test_quote_match_values", "report_lines": "test_reports_of_one_document", "ledger_json": "test_reports_of_one_document"}
EMPTY = {"quote_pairs": "test_quotation_queries_see_whole_texts"}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(spark, sf, name):
    assert glob.glob(f"{sf}/*.parquet")
    said = compare(spark, Core, sf, name)
    if name in WITHOUT_SQL:
        assert said.startswith("rows only") and not said.endswith(" 0"), said
    else:
        assert said.startswith("ok") and (said != "ok 0" or name in EMPTY), said


def test_names_do_not_need_a_session():
    assert set(registry.oracle_sql()) <= set(registry.queries())
