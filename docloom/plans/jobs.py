"""Jobs and uploads of one driver: look-ups, one generation at a time, and cancelling that wins."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from threading import Lock

#: States in which a job no longer changes.
ENDED = frozenset({"completed", "failed", "cancelled"})


@dataclass(frozen=True)
class Job:
    """What is known of a generation."""

    job_id: str
    file_id: str
    status: str = "queued"
    percent: int = 0
    step: str = "queued"
    error: str | None = None


@dataclass
class Jobs:
    """Jobs and files by id, for one process; every change is made under a lock.

    A cancelled job stays cancelled whatever its worker reports later, an ended one does not change
    again, and the percentage done never falls.
    """

    files: dict[str, object] = field(default_factory=dict)
    _jobs: dict[str, Job] = field(default_factory=dict)
    _running: str | None = None
    _lock: Lock = field(default_factory=Lock)

    def start(self, job_id: str, file_id: str) -> Job | None:
        """A new job, or None while another one runs; raises KeyError for an unknown file."""
        with self._lock:
            if file_id not in self.files:
                raise KeyError(file_id)
            if self._running is not None and self._jobs[self._running].status not in ENDED:
                return None
            self._running = job_id
            self._jobs[job_id] = Job(job_id, file_id)
            return self._jobs[job_id]

    def get(self, job_id: str) -> Job | None:
        with self._lock:
            return self._jobs.get(job_id)

    def update(self, job_id: str, **changes: object) -> Job | None:
        """The job after a change; one that has ended stays as it is."""
        with self._lock:
            job = self._jobs.get(job_id)
            if job is None or job.status in ENDED:
                return job
            changes["percent"] = max(job.percent, int(changes.get("percent", 0)))
            self._jobs[job_id] = replace(job, **changes)
            return self._jobs[job_id]

    def cancel(self, job_id: str) -> Job | None:
        return self.update(job_id, status="cancelled", step="cancelled", error="GENERATION_CANCELLED")

    def cancelled(self, job_id: str) -> bool:
        job = self.get(job_id)
        return job is not None and job.status == "cancelled"
