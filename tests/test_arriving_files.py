"""Parts of a streamed log are written by many tasks, and each is a batch of its own."""

from __future__ import annotations

from glob import glob

from tidewake.plans import scale_queries
from tidewake.streaming.stop_state import StopState


def test_parts_of_the_streamed_log_are_files_of_many_tasks(spark, monkeypatch):
    seen, update = [], StopState.update

    def watched(self, batch, batch_id):
        seen.append(len(glob(f"{self.root.removeprefix('file:').rsplit('/', 1)[0]}/arriving/*.parquet")))
        update(self, batch, batch_id)

    monkeypatch.setattr(StopState, "update", watched)
    assert scale_queries.streamed_stops(spark, "/root/testdata/sf0.01").count()
    assert seen == [3 * scale_queries.ARRIVING_FILES] * 3
