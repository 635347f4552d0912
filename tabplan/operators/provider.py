"""Calls to services that answer requests: several routes, each with rates of its own, and failover between them."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from .judge import RequestFailed, tokens_of

# Fixed values of the client: attempts of a request, seconds of the first and the longest pause, rates of a route.
ATTEMPTS, FIRST_PAUSE, LONGEST_PAUSE = 5, 0.5, 16.0
REQUESTS_PER_MINUTE, TOKENS_PER_SECOND = 1_200, 250_000


class TryAgain(Exception):
    """A route can't answer now; after says in how many seconds it might."""

    def __init__(self, message: str, after: float | None = None):
        super().__init__(message)
        self.after = after


class Bucket:
    """Lets `rate` units a second pass, and twice as many at once."""

    def __init__(self, rate: float, clock: Callable[[], float]):
        self.rate, self.clock, self.room, self.at = rate, clock, 2 * rate, clock()

    def wait(self, amount: float) -> float:
        """Take an amount; the seconds until it may go."""
        now = self.clock()
        self.room = min(2 * self.rate, self.room + (now - self.at) * self.rate)
        self.at = now
        self.room -= min(amount, 2 * self.rate)
        return max(0.0, -self.room / self.rate)


@dataclass
class Route:
    """call(texts, questions) answers or raises TryAgain, or RequestFailed where no other try would help."""

    name: str
    call: Callable[[list[str], list[dict[str, Any]]], list[dict[str, Any] | None]]
    requests_per_minute: float = REQUESTS_PER_MINUTE
    tokens_per_second: float = TOKENS_PER_SECOND


@dataclass
class _Load:
    requests: Bucket
    tokens: Bucket
    running: int = 0
    made: int = 0
    failures: int = 0
    resting_until: float = 0.0


@dataclass
class Routes:
    """The `answer` of a BatchJudge: each request goes to the route with the least to do, and to another one if that fails.

    A route that failed rests as long as it asked for, or for a pause that doubles. Rates hold
    for each Python worker; `share` of them is what it takes, so 1 / number of workers keeps
    the whole within a route's limits.
    """

    routes: list[Route]
    share: float = 1.0
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    _loads: dict[str, _Load] = field(default_factory=dict, repr=False)
    _lock: Any = field(default=None, repr=False)

    def __getstate__(self) -> dict[str, Any]:
        return self.__dict__ | {"_loads": {}, "_lock": None}

    def loads(self) -> dict[str, _Load]:
        if not self._loads:
            self._lock = threading.Lock()
            self._loads = {r.name: _Load(Bucket(r.requests_per_minute / 60 * self.share, self.clock), Bucket(r.tokens_per_second * self.share, self.clock)) for r in self.routes}
        return self._loads

    def _pick(self, last: str | None) -> Route:
        loads, now = self.loads(), self.clock()
        others = [r for r in self.routes if r.name != last] or self.routes
        return min(others, key=lambda r: (loads[r.name].resting_until > now, loads[r.name].running, loads[r.name].made))

    def __call__(self, texts: list[str], questions: list[dict[str, Any]]) -> list[dict[str, Any] | None]:
        if not self.routes:
            raise RequestFailed("there is no route")
        loads, pause, last, why = self.loads(), FIRST_PAUSE, None, None
        tokens = sum(map(tokens_of, texts)) + sum(tokens_of(json.dumps(q)) for q in questions)
        for attempt in range(ATTEMPTS):
            if attempt:
                self.sleep(max(0.0, min(load.resting_until for load in loads.values()) - self.clock()))
            with self._lock:
                route = self._pick(last)
                load = loads[route.name]
                load.running += 1
                until = max(load.requests.wait(1), load.tokens.wait(tokens))
            try:
                if until:
                    self.sleep(until)
                return route.call(texts, questions)
            except TryAgain as e:
                load.failures += 1
                load.resting_until = max(load.resting_until, self.clock() + (pause if e.after is None else e.after))
                last, pause, why = route.name, min(2 * pause, LONGEST_PAUSE), e
            finally:
                load.running -= 1
                load.made += 1
        raise RequestFailed(f"no answer after {ATTEMPTS} attempts: {why}")
