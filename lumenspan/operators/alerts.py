"""Alerts beyond the comparison: rules evaluated tick by tick, messages, and the places they are sent to."""

from __future__ import annotations

import json
import threading
import time
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from ..sources.config import Rule
from .anomaly import COMPARE


@dataclass(frozen=True)
class Notification:
    """A rule that began to fire, or ceased to."""

    rule: str
    service: str
    metric: str
    firing: bool
    message: str
    time_ns: int

    def webhook(self) -> dict:
        """The field names of the generic message."""
        at = datetime.fromtimestamp(self.time_ns // 1_000_000_000, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        return {"Rule": self.rule, "Service": self.service, "Metric": self.metric, "Firing": self.firing, "Message": self.message, "Time": at}

    def slack(self) -> dict:
        """The form of the chat message."""
        return {"text": f"[{'FIRING' if self.firing else 'RESOLVED'}] {self.rule} ({self.service}/{self.metric}): {self.message}"}


def post(url: str, body: dict, timeout_s: float = 10) -> None:
    """Send a message as JSON; an answer of 300 or more is an error."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout_s) as answer:
        if answer.status >= 300:
            raise OSError(f"{url} answered {answer.status}")


def send(rule: Rule, n: Notification, to: Callable[[str, dict], None] = post) -> list[Exception]:
    """Send to each place that the rule names; one that fails doesn't keep the others from theirs. Returns what failed."""
    errors: list[Exception] = []
    for url, body in ((rule.webhook, n.webhook()), (rule.slack_webhook, n.slack())):
        if url:
            try:
                to(url, body)
            except Exception as e:  # any sender's failure is reported, none stops the rest
                errors.append(e)
    return errors


@dataclass
class _State:
    firing: bool = False
    sent_ns: int | None = None


@dataclass
class Evaluator:
    """Rules and what is known of each between ticks.

    ``fetch`` gives a rule's (value, time in ns); ``anomalous`` says for an anomaly rule whether it fires with that value, and why.
    A change is sent unless one was sent less than the cooldown before; the state follows in any case, so that the next
    change is seen.
    """

    rules: list[Rule]
    fetch: Callable[[Rule], tuple[float, int]]
    anomalous: Callable[[Rule, float, int], tuple[bool, str]] | None = None
    to: Callable[[str, dict], None] = post
    states: dict[str, _State] = field(default_factory=dict)

    def tick(self) -> tuple[list[Notification], list[Exception]]:
        """Evaluate each rule once: what was sent, and what failed. A rule whose value can't be had keeps its state."""
        sent, errors = [], []
        for rule in self.rules:
            try:
                value, at = self.fetch(rule)
                if rule.kind == "anomaly":
                    if self.anomalous is None:
                        raise ValueError(f"no detector for {rule.name!r}")
                    firing, why = self.anomalous(rule, value, at)
                else:
                    firing, why = COMPARE[rule.op](value, rule.threshold), f"value={value:.4f} {rule.op} {rule.threshold:.4f}"
            except Exception as e:  # the other rules go on
                errors.append(e)
                continue
            state = self.states.setdefault(rule.name, _State())
            if firing == state.firing:
                continue
            state.firing = firing
            if state.sent_ns is not None and at - state.sent_ns < rule.cooldown_s * 1_000_000_000:
                continue
            state.sent_ns = at
            n = Notification(rule.name, rule.service, rule.metric, firing, why, at)
            errors += send(rule, n, self.to)
            sent.append(n)
        return sent, errors

    def run(self, every_s: float, stop: threading.Event) -> None:
        """Tick until ``stop`` is set."""
        while not stop.wait(every_s):
            self.tick()


def error_band(rate: float) -> str:
    """The bands of error rates that a service map shows."""
    return "red" if rate >= 0.1 else "amber" if rate >= 0.02 else "green"


def whole_ms(ns: int) -> int:
    """Nanoseconds as milliseconds, the rest cut off, as rules on durations compare them."""
    return ns // 1_000_000


def retried(run: Callable[[], object], attempts: int = 5, base_s: float = 0.1, most_s: float = 5.0, permanent: tuple[type[Exception], ...] = (), sleep: Callable[[float], None] = time.sleep, draw: Callable[[], float] | None = None) -> object:
    """Run until it succeeds, waiting a random part of a doubling delay in between; errors of a ``permanent`` kind and the last one are raised."""
    import random

    draw, delay = draw or random.random, base_s
    for attempt in range(attempts):
        try:
            return run()
        except permanent:
            raise
        except Exception:
            if attempt + 1 == attempts:
                raise
        sleep(draw() * delay)
        delay = min(most_s, 2 * delay)
    raise ValueError("no attempt was allowed")
