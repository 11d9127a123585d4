"""Live tables are replaced as a whole."""

from __future__ import annotations

from playlens.session import new_path
from playlens.sources import live_store


def test_readers_keep_their_version_during_a_refresh(spark):
    folder = new_path(spark, "live_versions")

    def table(n):
        return spark.createDataFrame([(f"p{i}", "jump", i) for i in range(n)], "player_name string, key_name string, presses bigint")

    live_store.write_live_table(table(3), f"{folder}/key_presses", ("player_name", "key_name"))
    old = live_store.scan_live_table(spark, folder, "key_presses")
    live_store.write_live_table(table(5), f"{folder}/key_presses", ("player_name", "key_name"))
    assert old.count() == 3
    assert live_store.scan_live_table(spark, folder, "key_presses").count() == 5
    assert set(old.columns) == {"player_name", "key_name", "presses"}
