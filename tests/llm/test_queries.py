import re

import __spark_entry__ as entry


def test_all_queries_are_there():
    """Where the training-data part can be imported, none of its queries is missing."""
    numbers = {int(m[1]) for name in entry.queries() if (m := re.match(r"op(\d+)_", name))}
    assert numbers == set(range(1, 14)) and "pipeline" in entry.queries()
    assert {"op5_url_filters", "op12_fill_middle"} <= set(entry.oracle_sql()) <= set(entry.queries())
