"""Driver-side job helpers: status and checkpoint files, freshness, an exclusive lock, retries, a stage runner."""

from __future__ import annotations

import contextlib
import json
import os
import random
import re
import threading
import time
from collections.abc import Callable, Iterable
from datetime import datetime, timedelta
from email.utils import parsedate_to_datetime
from pathlib import Path

STATUS_DEFAULT = {"status": "idle", "phase": None, "message": "", "current": 0, "total": 0, "errors": [], "updated_at": None, "completed_at": None}
#: HTTP answers and error names that are worth another try.
RETRY_STATUS = frozenset({408, 425, 429, 500, 502, 503, 504})
PHASES = {"queued": 2, "preparing": 5, "downloading": 10, "parsing": 18, "reviewing": 22, "validating": 95, "completed": 100}


def read_json(path: str | Path, default):
    """The file's value; the default if it is missing or broken."""
    try:
        value = json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return default
    return {**default, **value} if isinstance(default, dict) and isinstance(value, dict) else value


def write_json(path: str | Path, value) -> None:
    """Written beside and renamed, so that readers never see half a file."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    temporary = path.with_suffix(f"{path.suffix}.{os.getpid()}.tmp")
    temporary.write_text(json.dumps(value, ensure_ascii=False, indent=1))
    os.replace(temporary, path)


def update_status(path: str | Path, now: float, **patch) -> dict:
    status = read_json(path, STATUS_DEFAULT) | patch | {"updated_at": now}
    write_json(path, status)
    return status


def start_status(path: str | Path, total: int, now: float) -> dict:
    return update_status(path, now, **(STATUS_DEFAULT | {"status": "running", "total": total, "updated_at": now}))


def record_error(path: str | Path, message: str, now: float, keep: int = 20) -> dict:
    return update_status(path, now, errors=[*read_json(path, STATUS_DEFAULT)["errors"], message][-keep:])


def write_checkpoint(path: str | Path, source: str, direction: str, now: float, **fields) -> list[dict]:
    """One record per (source, direction); a new one replaces the old."""
    old = [c for c in read_json(path, []) if (c["source"], c["direction"]) != (source, direction)]
    rows = [*old, {"source": source, "direction": direction, "completed_at": now, **fields}]
    write_json(path, rows)
    return rows


def is_fresh(status: dict, hours: float, now: float) -> bool:
    """Completed, and not longer ago than that."""
    return status.get("status") == "completed" and bool(status.get("completed_at")) and now - status["completed_at"] < hours * 3600


@contextlib.contextmanager
def exclusive(path: str | Path):
    """A lock file with the owner's PID; one of a dead process is taken over. Raises if a live one holds it."""
    path = Path(path)
    for _ in range(2):
        try:
            handle = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            os.write(handle, str(os.getpid()).encode())
            os.close(handle)
            break
        except FileExistsError:
            owner = path.read_text().strip()
            if owner.isdigit() and Path(f"/proc/{owner}").exists():
                raise RuntimeError(f"locked by process {owner}") from None
            path.unlink(missing_ok=True)
    try:
        yield
    finally:
        with contextlib.suppress(OSError):
            if path.read_text().strip() == str(os.getpid()):
                path.unlink()


def backoff(attempt: int, base: float = 0.5, most: float = 60.0, retry_after: float | None = None, rng: Callable[[], float] = random.random) -> float:
    """Seconds to wait: what the server asked for, else exponential with jitter; never above most."""
    return min(most, retry_after if retry_after is not None else base * 2**attempt * (0.5 + rng() / 2))


class ServiceError(Exception):
    """An answer with a status that is no success; retry_after as the server wrote it."""

    def __init__(self, status: int, retry_after: str | None = None):
        super().__init__(f"status {status}")
        self.status, self.retry_after = status, retry_after


def retry_after_seconds(value: str | None, now: float) -> float | None:
    """Seconds of a Retry-After header: a number, or a date; null for anything else, never below 0."""
    if not value:
        return None
    if re.fullmatch(r"\s*\d+(?:\.\d+)?\s*", value):
        return float(value)
    try:
        return max(0.0, parsedate_to_datetime(value).timestamp() - now)
    except (TypeError, ValueError):
        return None


def is_retryable(e: Exception) -> bool:
    """Broken connections, timeouts and the statuses that are worth another try."""
    return e.status in RETRY_STATUS if isinstance(e, ServiceError) else isinstance(e, (OSError, TimeoutError))


def with_retries(call: Callable, attempts: int = 3, retryable: Callable[[Exception], bool] = is_retryable, sleep: Callable[[float], None] = time.sleep, now: Callable[[], float] = time.time):
    for k in range(attempts):
        try:
            return call()
        except Exception as e:
            if k + 1 == attempts or not retryable(e):
                raise
            sleep(backoff(k, retry_after=retry_after_seconds(getattr(e, "retry_after", None), now())))


@contextlib.contextmanager
def heartbeat(beat: Callable[[], bool], every: float = 60.0):
    """Beats in a thread while a job runs; the event that it yields is set once a beat says that the lease is lost."""
    lost, done = threading.Event(), threading.Event()

    def run():
        while not done.wait(every):
            try:
                if not beat():
                    lost.set()
                    return
            except Exception:  # a beat that fails is tried again; the lease decides
                continue

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    try:
        yield lost
    finally:
        done.set()
        thread.join()


def next_run(now: datetime, hour: int = 8, minute: int = 0) -> datetime:
    """When a daily job runs next."""
    at = now.replace(hour=hour, minute=minute, second=0, microsecond=0)
    return at if at > now else at + timedelta(days=1)


def run_stages(stages: Iterable[tuple[str, Callable[[], object]]], publish: Callable[..., object] = lambda **_: None) -> bool:
    """Stages in order up to the first that fails; publishes the state of each."""
    for name, stage in stages:
        publish(status="running", phase=name)
        try:
            stage()
        except Exception as e:
            publish(status="failed", phase=name, message=str(e))
            return False
    publish(status="completed", phase=None, message="")
    return True


def progress_percent(phase: str, current: int = 0, total: int = 0) -> int:
    """By phase; translating goes from 25 to 92 with the chunks done."""
    if phase == "translating":
        return min(92, round(25 + 67 * current / max(1, total)))
    return PHASES.get(phase, 0)
