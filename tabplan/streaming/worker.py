"""Workers claim jobs from a folder: the oldest queued one, else a running one whose worker went silent."""

from __future__ import annotations

import contextlib
import json
import threading
import time
import uuid
from collections.abc import Callable, Iterator

from ..sources.files import Files
from .jobs import Job, State

#: Seconds of silence after which a running job is taken over, and between two signs of life.
STALE_SECONDS, BEAT_SECONDS = 90.0, 15.0


class Worker:
    """open_job makes a Job of a folder; several workers can share one root."""

    def __init__(self, root: str, open_job: Callable[[str], Job], clock: Callable[[], float] = time.time):
        self.root, self.open_job, self.clock, self.id, self.files = root, open_job, clock, uuid.uuid4().hex, Files()

    def _read(self, folder: str, file: str) -> dict:
        return json.loads(self.files.read(f"{folder}/{file}") or "{}")

    def _beat(self, folder: str) -> None:
        self.files.write(f"{folder}/worker.json", json.dumps({"worker": self.id, "at": self.clock()}))

    def claim(self) -> str | None:
        """The folder of a job that is this worker's from now on."""
        found = []
        for folder in (f"{self.root}/{n}" for n in self.files.names(self.root)):
            state, last = self._read(folder, "state.json").get("state"), self._read(folder, "worker.json")
            if state in ("queued", "running") and self.clock() - last.get("at", 0) > STALE_SECONDS:
                found.append((state == "running", self.files.modified(f"{folder}/state.json"), folder, last.get("worker", "none")))
        for _, _, folder, last in sorted(found):
            if self.files.create(f"{folder}/claimed_after.{last}"):  # of two workers, one makes the file that follows the last claim
                self._beat(folder)
                return folder
        return None

    @contextlib.contextmanager
    def _alive(self, folder: str) -> Iterator[None]:
        """Signs of life also while a chunk takes long."""
        ended = threading.Event()

        def beat() -> None:
            while not ended.wait(BEAT_SECONDS):
                self._beat(folder)

        thread = threading.Thread(target=beat, daemon=True)
        thread.start()
        try:
            yield
        finally:
            ended.set()
            thread.join()

    def work(self) -> State | None:
        """Run one job, or None if there is none to claim."""
        folder = self.claim()
        if folder is None:
            return None
        with self._alive(folder):
            return self.open_job(folder).run()
