"""A provider behind a job service: submit once, poll, map states, cancel.

A submission costs money, so it is never repeated; only status polls of the same job are. The
transport and the clock are given, which keeps this free of any network library.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from docloom.plans.generation import GenerationError

#: (status code, decoded body) of a request; a transport raises OSError where the network fails.
Transport = Callable[[str, str, dict | None], tuple[int, dict]]

# How HTTP statuses and job states map to errors; the flag says whether a poll may be repeated.
STATUS_ERRORS = {401: ("PROVIDER_AUTH_FAILED", False), 403: ("PROVIDER_AUTH_FAILED", False), 429: ("PROVIDER_RATE_LIMITED", True)}
WAITING, RUNNING, DONE = ("IN_QUEUE",), ("IN_PROGRESS",), ("COMPLETED",)
FAILED = {"FAILED": "PROVIDER_FAILED", "CANCELLED": "PROVIDER_CANCELLED", "TIMED_OUT": "PROVIDER_TIMED_OUT"}


@dataclass(frozen=True)
class ProviderOptions:
    """Limits of a provider; numbers are checked when the options are made."""

    endpoint: str
    model: str
    max_model_len: int = 32768
    queue_seconds: float = 300
    execution_seconds: float = 600
    poll_seconds: float = 1
    records_per_batch: int = 4
    max_dataset_records: int = 20
    temperature: float = 0.2
    poll_retries: int = 2

    def __post_init__(self) -> None:
        if not self.endpoint.strip() or not self.model.strip():
            raise GenerationError("PROVIDER_CONFIGURATION_REQUIRED")
        numbers = (self.max_model_len, self.queue_seconds, self.execution_seconds, self.poll_seconds, self.records_per_batch, self.max_dataset_records)
        if any(n <= 0 for n in numbers) or self.poll_retries < 0:
            raise GenerationError("PROVIDER_CONFIGURATION_INVALID")

    @classmethod
    def from_mapping(cls, values: dict[str, str]) -> ProviderOptions:
        """Options from text values, such as an environment's; a number that is none is an invalid configuration."""
        kinds = {"endpoint": str, "model": str, "max_model_len": int, "queue_seconds": float, "execution_seconds": float, "poll_seconds": float, "records_per_batch": int, "max_dataset_records": int, "temperature": float, "poll_retries": int}
        try:
            return cls(**{"endpoint": "", "model": "", **{k: kind(values[k]) for k, kind in kinds.items() if values.get(k)}})
        except ValueError as e:
            raise GenerationError("PROVIDER_CONFIGURATION_INVALID", str(e)) from e


def schema_digest(schema: dict) -> str:
    """SHA-256 of a schema's compact JSON with sorted keys."""
    return hashlib.sha256(json.dumps(schema, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def build_request(options: ProviderOptions, messages: list[dict[str, str]], schema: dict, max_tokens: int) -> dict:
    """Body of a submission: a chat request with structured output, nested in a job's input (names are fixed values of the contract)."""
    chat = {"model": options.model, "messages": messages, "max_tokens": max_tokens, "temperature": options.temperature, "stream": False, "structured_outputs": {"json": schema}}
    return {"input": {"openai_route": "/v1/chat/completions", "openai_input": chat}}


class Clock(Protocol):
    def monotonic(self) -> float: ...

    def sleep(self, seconds: float) -> None: ...


@dataclass
class JobProvider:
    """A provider over a job service, with counters of what it did."""

    options: ProviderOptions
    transport: Transport
    clock: Clock = time
    cancelled: Callable[[], bool] = lambda: False
    on_state: Callable[[str], None] = lambda state: None
    on_job_created: Callable[[str], None] = lambda job: None
    counters: Counter = field(default_factory=Counter)
    last_job: str | None = None

    def _request(self, method: str, path: str, body: dict | None = None) -> dict:
        try:
            status, answer = self.transport(method, f"{self.options.endpoint.rstrip('/')}/{path}", body)
        except OSError as e:
            raise _Retryable("PROVIDER_NETWORK_ERROR") from e
        if status in STATUS_ERRORS or status >= 400:
            code, again = STATUS_ERRORS.get(status, ("PROVIDER_ERROR", True) if status >= 500 else ("PROVIDER_REQUEST_INVALID", False))
            raise (_Retryable if again else GenerationError)(code)
        if not isinstance(answer, dict):
            raise GenerationError("PROVIDER_INVALID_RESPONSE")
        return answer

    def health(self) -> bool:
        """Whether the service answers."""
        try:
            self._request("GET", "health")
        except GenerationError:
            return False
        return True

    def cancel(self, job_id: str) -> bool:
        """Ask for a job's end; says whether the service took it."""
        self.counters["cancels"] += 1
        try:
            self._request("POST", f"cancel/{job_id}")
        except GenerationError:
            return False
        return True

    def _poll(self, job: str) -> dict:
        """The state of a job; a failed poll is repeated a few times."""
        for attempt in range(self.options.poll_retries + 1):
            self.counters["polls"] += 1
            try:
                return self._request("GET", f"status/{job}")
            except _Retryable:
                if attempt == self.options.poll_retries:
                    raise
                self.counters["retries"] += 1
                self.clock.sleep(min(0.25, self.options.poll_seconds))
        raise AssertionError

    def generate(self, messages: list[dict[str, str]], schema: dict, max_tokens: int) -> str:
        """The output of one job as JSON text; submitted once, whatever happens. Both time limits count from the submission."""
        self.counters["submitted"] += 1
        began = self.clock.monotonic()
        job = self._request("POST", "run", build_request(self.options, messages, schema, max_tokens)).get("id")
        if not job or not isinstance(job, str):
            raise GenerationError("PROVIDER_MISSING_JOB_ID")
        self.last_job = job
        self.counters["created"] += 1
        self.on_job_created(job)
        try:
            return json.dumps(self._finished(job, began))
        except GenerationError:
            self.counters["failed"] += 1
            raise

    def _finished(self, job: str, began: float) -> object:
        limits = {WAITING: ("PROVIDER_QUEUE_TIMEOUT", self.options.queue_seconds), RUNNING: ("PROVIDER_EXECUTION_TIMEOUT", self.options.queue_seconds + self.options.execution_seconds)}
        while True:
            if self.cancelled():
                self.cancel(job)
                raise GenerationError("GENERATION_CANCELLED")
            answer = self._poll(job)
            state = str(answer.get("status", "")).upper()
            self.on_state(state)
            if state in DONE:
                output = answer.get("output")
                if isinstance(output, dict) and isinstance(output.get("error"), dict):
                    raise GenerationError("WORKER_ERROR")
                self.counters["completed"] += 1
                return output
            if state in FAILED:
                raise GenerationError(FAILED[state])
            held = next((limit for states, limit in limits.items() if state in states), None)
            if held is None:
                raise GenerationError("PROVIDER_UNKNOWN_STATUS", state[:40])
            if self.clock.monotonic() - began > held[1]:
                self.cancel(job)
                raise GenerationError(held[0])
            self.clock.sleep(self.options.poll_seconds)


class _Retryable(GenerationError):
    """An error after which a poll may be repeated."""
