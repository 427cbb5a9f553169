"""Permutation queries ask for the reference's number of sign flips."""

import pytest

from evoked.plans import signal_queries


@pytest.mark.parametrize("query", [signal_queries.time_clusters, signal_queries.map_clusters])
def test_number_of_flips(spark, sf_dir, monkeypatch, query):
    asked = []
    monkeypatch.setattr(signal_queries.stats, "cluster_permutation", lambda *args, n_perm=200, **options: asked.append(n_perm) or args[0])
    query(spark, sf_dir)
    assert asked == [2000]
