"""Cases beyond the block size give the same rows as the plain form."""

import pytest
from conftest import SF, rows_of

from caseloom.catalog import load

NAMES = [
    "seconds_since_case_start", "seconds_since_earlier_event", "all_prefixes", "end_rows", "prefix_suffix_cuts",
    "decision_records", "replayed_decision_records", "prefix_markings", "aligned_moves_filtered_net", "labeller_feature_state",
]


@pytest.mark.parametrize("name", NAMES)
def test_small_blocks(spark, blocks, name):
    run = load()[name].run
    plain = rows_of(run(spark, SF))
    blocks(9)
    assert rows_of(run(spark, SF)) == plain
