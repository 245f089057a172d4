"""Snapshots of what a stream has done, for those who watch it."""

from __future__ import annotations

import json
import uuid

from pyarrow import fs
from pyspark.sql.streaming import StreamingQueryListener


def put_whole(path: str, text: str) -> None:
    """Writes ``text`` beside ``path`` and moves it there, so that a reader sees the old file or the new one."""
    store, name = fs.FileSystem.from_uri(path)
    top, _, last = name.rpartition("/")
    store.create_dir(top, recursive=True)
    part = f"{top}/.{last}-{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(text.encode())
    store.move(part, name)


def get(path: str) -> dict | None:
    store, name = fs.FileSystem.from_uri(path)
    if store.get_file_info(name).type != fs.FileType.File:
        return None
    with store.open_input_stream(name) as f:
        return json.loads(f.read())


class Snapshots(StreamingQueryListener):
    """Adds up what ``observe`` counts as ``name`` and keeps the sums as JSON at ``path``, a URI, from trigger to trigger and over restarts.

    A trigger is counted once, by its number: one that is reported again, or was counted before a restart, isn't counted again.
    """

    def __init__(self, path: str, name: str = "scan"):
        super().__init__()
        self.path, self.name = path, name
        self.now = get(path) or {"state": "waiting", "trigger": -1, "counts": {}}

    def _put(self, **more) -> None:
        self.now = {**self.now, **more}
        put_whole(self.path, json.dumps(self.now, sort_keys=True, indent=2) + "\n")

    def onQueryStarted(self, event) -> None:
        self._put(state="running", query=str(event.id))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        found = (p.observedMetrics or {}).get(self.name)
        if found is None or p.batchId <= self.now["trigger"] or str(p.id) != self.now.get("query"):
            return
        counts = {k: self.now["counts"].get(k, 0) + v for k, v in found.asDict().items()}
        self._put(trigger=p.batchId, counts=counts, at=p.timestamp)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.id) == self.now.get("query"):
            self._put(state="failed" if event.exception else "done")
