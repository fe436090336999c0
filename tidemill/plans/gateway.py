"""What stands between the state machine and its models, and around the stores: routing, readiness, wiring."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor, wait
from contextlib import ExitStack
from dataclasses import dataclass, field
from typing import Any

from ..errors import LLMProviderExhausted, RateLimited


@dataclass(frozen=True)
class Route:
    """A model of one provider under one or several keys; ``call`` takes (key, role, request) and must pickle."""

    provider: str
    call: Callable[[str, str, dict], dict]
    keys: tuple[str, ...] = ("",)


@dataclass
class Gateway:
    """A language model over several routes: roles name an alias, an alias its routes in the order to try.

    A call that is refused goes on with the next key of the route, other retryable errors are tried again up to
    ``retries`` times, and a route that gives no answer yields to the next one.  What no route answers is
    LLMProviderExhausted.  Errors that a retry cannot help pass through.
    """

    aliases: dict[str, tuple[Route, ...]]
    roles: dict[str, str]
    retries: int = 2
    refused: dict[str, int] = field(default_factory=dict)

    def __call__(self, role: str, request: dict[str, Any]) -> dict[str, Any]:
        last: Exception | None = None
        for route in self.aliases[self.roles.get(role, role)]:
            start = self.refused.get(route.provider, 0)  # begin with the key that was not refused last
            turn, failed = start, 0
            while turn - start < len(route.keys) and failed <= self.retries:
                try:
                    return route.call(route.keys[turn % len(route.keys)], role, request) | {"provider": route.provider}
                except RateLimited as e:
                    last, turn = e, turn + 1
                    self.refused[route.provider] = turn % len(route.keys)
                except Exception as e:
                    if not getattr(e, "retryable", False):
                        raise
                    last, failed = e, failed + 1
        raise LLMProviderExhausted(f"no provider answered for {role}", details={"last": type(last).__name__}) from last


class Readiness:
    """Probes of the stores: all at once, each with a deadline, their answers kept for a while."""

    def __init__(self, probes: dict[str, Callable[[], object]], deadline_s: float = 2, keep_s: float = 5, clock: Callable[[], float] = time.monotonic):
        self.probes, self.deadline_s, self.keep_s, self.clock = probes, deadline_s, keep_s, clock
        self._at, self._last = float("-inf"), {}

    def check(self) -> dict[str, str]:
        """"ok", "timeout" or the kind of error, by probe."""
        if self.clock() - self._at < self.keep_s:
            return self._last
        pool = ThreadPoolExecutor(max(1, len(self.probes)))
        running = {name: pool.submit(probe) for name, probe in self.probes.items()}
        wait(running.values(), timeout=self.deadline_s)
        found = {}
        for name, run in running.items():
            error = run.exception() if run.done() else None
            found[name] = "timeout" if not run.done() else type(error).__name__ if error else "ok"
        pool.shutdown(wait=False, cancel_futures=True)  # a probe that hangs does not hold the answer up
        self._at, self._last = self.clock(), found
        return found

    def ready(self) -> bool:
        return all(v == "ok" for v in self.check().values())


class Wiring:
    """Parts by name, made once on demand, closed in the reverse order; one that fails to close does not keep the others open."""

    def __init__(self, makers: dict[str, Callable[[Wiring], Any]]):
        self._makers, self._made, self._stack, self._making = makers, {}, ExitStack(), []

    def __getitem__(self, name: str) -> Any:
        if name not in self._made:
            if name in self._making:
                raise ValueError(f"{' -> '.join([*self._making, name])}: parts need each other")
            self._making.append(name)
            try:
                part = self._makers[name](self)
            finally:
                self._making.pop()
            self._made[name] = part
            close = getattr(part, "close", None) or getattr(part, "stop", None)
            if close:
                self._stack.callback(close)
        return self._made[name]

    def __enter__(self) -> Wiring:
        return self

    def __exit__(self, *error) -> bool | None:
        self._made.clear()
        return self._stack.__exit__(*error)
