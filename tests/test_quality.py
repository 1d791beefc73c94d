"""Checks of ranked lists that are cut into ranges of ranks."""

import pytest

from candisieve.operators import quality


@pytest.mark.parametrize("width", [1, 3, 10_000])
def test_order_over_ends_of_ranges(spark, monkeypatch, width):
    monkeypatch.setattr(quality, "RANK_RANGE", width)
    scores = {1: 9, 2: 8, 3: 8.5, 4: 8, 5: 8, 6: 8.2, 9: 7, 12: 7.5, 13: 7.5}
    rows = [(j, n, 4, f"CAND_{(50 - r):07d}", str(r), str(s), "x") for j in (1, 2) for n, (r, s) in enumerate(scores.items())]
    rows.append((2, 90, 4, "CAND_0000099", "13", "7.9", "repeated rank"))
    sub = spark.createDataFrame(rows, "job_id long, row_num long, n_cells long, candidate_id string, rank string, score string, reasoning string")
    rising = {(r.job_id, r.row_key) for r in quality.check_monotonic(sub, ["job_id"]).collect()}
    assert rising == {(1, "2"), (1, "5"), (1, "9"), (2, "2"), (2, "5"), (2, "9"), (2, "13")}
    ties = {(r.job_id, r.row_key) for r in quality.check_ties(sub, ["job_id"]).collect()}
    assert ties == {(1, "4"), (2, "4"), (1, "12"), (2, "12")}
    repeated = [(r.job_id, r.rule, r.row_key) for r in quality.check_ranks(sub, ["job_id"]).collect() if r.rule == "rank_duplicate"]
    assert repeated == [(2, "rank_duplicate", "90")]
