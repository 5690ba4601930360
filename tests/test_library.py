import pytest

from tracelode.operators import evolution


def test_pages_of_the_library(spark):
    rows = spark.createDataFrame([(f"m{i}", "global" if i % 2 else "repository") for i in range(7)], "memory_id string, scope string")
    seen, after = [], None
    while True:
        page = sorted(evolution.library_page(rows, 3, after).collect())
        seen.append([r.memory_id for r in page])
        after = page[-1].next_cursor
        assert all(r.next_cursor is None for r in page[:-1])
        if after is None:
            break
    assert seen == [["m0", "m1", "m2"], ["m3", "m4", "m5"], ["m6"]]
    assert evolution.library_page(rows, 3, "m6").collect() == []
    for scope in ("global", "repository"):
        with pytest.raises(ValueError, match="cursor_invalid"):
            evolution.library_page(rows.where(f"scope = '{scope}'"), 3, "m1" if scope == "repository" else "m2")
