"""Archives of which some entries are empty: an entry without content is stored as it is, for an unpacked size of 0 says so."""

import pytest

from .test_odd_inputs import against_sql

QUERIES = ["archive_extraction", "archive_payloads_verified", "archive_rebuild", "batch_rebuild", "package_cycle", "workspace_states"]


@pytest.mark.parametrize("name", QUERIES)
def test_empty_texts(spark, tmp_path, name):
    texts = ["", "a", "some words " * 9, "", "", "more"]
    got, want = against_sql(spark, name, tmp_path, [(k, f"s{k % 2}", "en", texts[k // 2 % 6]) for k in range(48)])
    assert got == want
