"""Calls of a remote service: what a failure means, waiting out limits, resuming a paged scan.

Nothing here opens a connection; callers pass functions, sleeps and clocks.
"""

from __future__ import annotations

import math
import re
import time
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from email.utils import parsedate_to_datetime
from itertools import islice
from typing import Any

# Costs and limits of the service.
PAGE = 100
LEAST_CALLS = 10
CALLS_PER_REPO = 5
ANONYMOUS_LIMIT = 60
MAX_WAITS = 5
RESET_MARGIN_S = 5
SECONDARY_WAIT_S = 60
UNKNOWN_WAIT_S = 60
SHORT_RESET_S = 60
LOW_SHARE, PACE_S = 0.10, 1.0
TRIES, FIRST_PAUSE_S = 3, 0.5


class RemoteError(Exception):
    """A failed call: status (None: no answer), headers and the service's message."""

    def __init__(self, status: int | None = None, message: str = "", headers: Mapping[str, Any] | None = None):
        super().__init__(message)
        self.status, self.message = status, message
        self.headers = {str(k).lower(): str(v) for k, v in (headers or {}).items()}


class QuotaError(RuntimeError):
    """Too few calls are left to start."""


@dataclass(frozen=True)
class Limit:
    kind: str  # primary or secondary
    reset: datetime | None = None
    retry_after: float | None = None


def reset_time(headers: Mapping[str, str]) -> datetime | None:
    """An epoch header as UTC time; anything but digits is none."""
    value = {k.lower(): v for k, v in headers.items()}.get("x-ratelimit-reset")
    return datetime.fromtimestamp(int(value), UTC) if value is not None and re.fullmatch(r"[0-9]+", str(value)) else None


def retry_after(headers: Mapping[str, str], now: datetime | None = None) -> float | None:
    """Seconds, or an HTTP date from now; at least 0; invalid is none."""
    value = {k.lower(): v for k, v in headers.items()}.get("retry-after")
    if value is None:
        return None
    try:
        seconds = float(value)
        return max(seconds, 0.0) if math.isfinite(seconds) else None
    except ValueError:
        pass
    try:
        when = parsedate_to_datetime(str(value))
    except (TypeError, ValueError):
        return None
    return max(((when if when.tzinfo else when.replace(tzinfo=UTC)) - (now or datetime.now(UTC))).total_seconds(), 0.0)


def limit_of(error: BaseException) -> Limit | None:
    """The rate limit behind an error, if it is one."""
    if not isinstance(error, RemoteError) or error.status == 401:
        return None
    after, said = retry_after(error.headers), error.message.lower()
    if "secondary rate limit" in said or error.status == 429 or error.status == 403 and after is not None:
        return Limit("secondary", retry_after=after)
    if error.status == 403 and ("rate limit" in said or error.headers.get("x-ratelimit-remaining") == "0"):
        return Limit("primary", reset=reset_time(error.headers))
    return None


def is_transient(error: BaseException) -> bool:
    """Server errors, lost connections and timeouts may pass."""
    if isinstance(error, RemoteError):
        return error.status is None or error.status >= 500
    return isinstance(error, ConnectionError | TimeoutError)


def fails_fast(error: RemoteError, now: datetime | None = None) -> bool:
    """A primary limit that resets late, or at no known time, is not slept through by a retry."""
    limit = limit_of(error)
    if limit is None or limit.kind != "primary":
        return False
    return limit.reset is None or (limit.reset - (now or datetime.now(UTC))).total_seconds() > SHORT_RESET_S


def retried(call: Callable[[], Any], sleep: Callable[[float], None] = time.sleep, tries: int = TRIES) -> Any:
    """call(), again after transient failures, with doubling pauses."""
    for n in range(tries):
        try:
            return call()
        except Exception as e:
            if not is_transient(e) or n + 1 == tries:
                raise
        sleep(FIRST_PAUSE_S * 2**n)


class Waiter:
    """Waits out rate limits, at most MAX_WAITS in a row, and resumes."""

    def __init__(self, enabled: bool = False, say: Callable[[str], None] = lambda _: None, sleep: Callable[[float], None] = time.sleep, now: Callable[[], datetime] = lambda: datetime.now(UTC)):
        self.enabled, self.say, self.sleep, self.now = enabled, say, sleep, now
        self.waits, self.seconds = 0, 0.0

    def stats(self) -> dict:
        return {"count": self.waits, "seconds": round(self.seconds, 1)}

    def call(self, fn: Callable, *args, **kwargs) -> Any:
        return next(self.iterate(lambda: iter([fn(*args, **kwargs)])))

    def iterate(self, pages: Callable[[], Iterable]) -> Iterator:
        """Items of pages(); after a wait it goes on with the first item not yet given out."""
        given = row = 0
        while True:
            try:
                for item in islice(iter(pages()), given, None):
                    given, row = given + 1, 0
                    yield item
                return
            except RemoteError as e:
                limit = limit_of(e)
                if not self.enabled or limit is None or row >= MAX_WAITS:
                    raise
            self.wait(limit)
            row += 1

    def wait(self, limit: Limit) -> None:
        if limit.kind == "secondary":
            delay = SECONDARY_WAIT_S if limit.retry_after is None else limit.retry_after
        elif limit.reset is None:
            delay = UNKNOWN_WAIT_S
        else:
            delay = max((limit.reset - self.now()).total_seconds(), 0.0) + RESET_MARGIN_S
        self.say(f"The service's {limit.kind} rate limit is reached; waiting {duration(delay)}, until about {clock(self.now() + timedelta(seconds=delay))}.")
        self.waits += 1
        self.seconds += delay
        self.sleep(delay)


def pace(remaining: Any, limit: Any, sleep: Callable[[float], None] = time.sleep) -> float:
    """A pause when little quota is left; its seconds."""
    if not isinstance(remaining, int) or not isinstance(limit, int) or limit <= 0 or remaining < 0 or remaining / limit > LOW_SHARE:
        return 0.0
    sleep(PACE_S)
    return PACE_S


def check_quota(remaining: int, reset: datetime | None, waiter: Waiter, authenticated: bool) -> None:
    """Stops a start with too few calls left, or waits for more."""
    if remaining < LEAST_CALLS:
        if not waiter.enabled:
            raise QuotaError(exhausted(reset, authenticated))
        waiter.wait(Limit("primary", reset=reset))


def contributor_pages(n: int) -> int:
    return max(1, -(-n // PAGE))


def calls_for_repo(contributors: int) -> int:
    return contributor_pages(contributors) + 1


def estimate_repos(calls: int) -> int:
    return max(calls, 0) // CALLS_PER_REPO


def duration(seconds: float) -> str:
    total = max(0, math.ceil(seconds - 1e-9))
    h, m, s = total // 3600, total % 3600 // 60, total % 60
    return f"{h}h {m:02d}m {s:02d}s" if h else f"{m}m {s:02d}s" if m else f"{s}s"


def clock(at: datetime | None) -> str:
    return at.astimezone(UTC).strftime("%H:%M UTC") if at else "an unknown time"


def exhausted(reset: datetime | None, authenticated: bool) -> str:
    more = "Run again then, or ask for fewer repositories." if authenticated else f"Without a token it allows {ANONYMOUS_LIMIT} calls an hour, about {estimate_repos(ANONYMOUS_LIMIT)} repositories."
    return f"The service's rate limit is reached; it resets at {clock(reset)}. {more}"


def partial(reset: datetime | None, authenticated: bool) -> str:
    return f"The results are partial: the rate limit was reached, and resets at {clock(reset)}." + ("" if authenticated else " A token allows full runs.")


def without_secret(message: str, secret: str | None) -> str:
    return message.replace(secret, "***") if secret else message
