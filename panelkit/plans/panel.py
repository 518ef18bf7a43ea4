"""The labelled panel, from observations to presences and absences."""

from __future__ import annotations

from ._tables import Registry, panel, sql

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


@R.add("panel_labelled", sql("panel", "SELECT * FROM panel"), "mean_log_count mean_count total_count max_count other_count cell_lat cell_lon")
def labelled(spark, sf):
    return panel(spark, sf)
