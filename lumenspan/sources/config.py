"""Policies, budgets and alert rules from YAML; anything unknown is an error when it is loaded."""

from __future__ import annotations

from dataclasses import dataclass

from ..operators.anomaly import COMPARE
from ..operators.cardinality import Budget
from ..operators.sampling import Policy
from ..plans.language import duration_ns
from ..schema import DEFAULTS


def _yaml(text: str) -> dict:
    import yaml

    loaded = yaml.safe_load(text) or {}
    if not isinstance(loaded, dict):
        raise ValueError("a mapping is expected at the top")
    return loaded


def _duration(text, what: str) -> int:
    ns = duration_ns(str(text))
    if ns is None:
        raise ValueError(f"{what}: invalid duration {text!r}")
    return ns


def policies(text: str) -> tuple[Policy, ...]:
    out = []
    for i, p in enumerate(_yaml(text).get("policies", [])):
        kind = p.get("type")
        if kind == "always_sample_errors":
            out.append(Policy("errors"))
        elif kind == "always_sample_slow" and p.get("mode") == "threshold":
            out.append(Policy("slow", threshold_ns=_duration(p.get("threshold"), f"policy {i}")))
        elif kind == "always_sample_slow" and p.get("mode") == "rolling_p99":
            out.append(Policy("rolling_p99", window=int(p.get("window", 200))))
        elif kind == "attribute_match" and p.get("key"):
            out.append(Policy("attribute", key=str(p["key"]), value=str(p.get("value", ""))))
        elif kind == "rate_limiting" and float(p.get("rate_per_second", 0)) > 0:
            out.append(Policy("rate_limit", per_second=float(p["rate_per_second"])))
        elif kind == "probabilistic" and 0 <= float(p.get("rate", -1)) <= 1:
            out.append(Policy("probabilistic", rate=float(p["rate"])))
        else:
            raise ValueError(f"policy {i}: invalid {p}")
    return tuple(out)


class PolicyFile:
    """A chain that follows its file: read again when the file has changed, looked at every ``every_s`` seconds. One that can't be read or has a mistake leaves the chain before as it is.

    Every process that decides has its own copy, so the file must lie where all can read it (any URI that Arrow's file systems know).
    """

    def __init__(self, uri: str, every_s: float = 5.0):
        self.uri, self.every_s = uri, every_s
        self._changed, self._next, self.error = None, 0.0, ""
        self._chain: tuple[Policy, ...] = ()
        self.current()
        if self.error:
            raise ValueError(self.error)

    def current(self) -> tuple[Policy, ...]:
        import time

        from pyarrow import fs

        if time.monotonic() >= self._next:
            self._next = time.monotonic() + self.every_s
            try:
                store, path = fs.FileSystem.from_uri(self.uri)
                changed = store.get_file_info(path).mtime
                if changed is None or changed != self._changed:
                    with store.open_input_stream(path) as f:
                        self._chain = policies(f.read().decode())
                    self._changed, self.error = changed, ""
            except Exception as e:  # whatever is wrong with the new file, deciding goes on with the old chain
                self.error = f"{self.uri}: {e}"
        return self._chain

    def __getstate__(self):
        return {**self.__dict__, "_next": 0.0}


def budgets(text: str) -> tuple[Budget, dict[str, Budget]]:
    """The default budget and those by key."""
    loaded = _yaml(text)

    def one(x: dict, what: str) -> Budget:
        action = x.get("action", "bucket")
        if action not in ("drop", "bucket", "keep_and_alert"):
            raise ValueError(f"{what}: unknown action {action!r}")
        return Budget(int(x.get("budget", DEFAULTS["cardinality_budget"])), action, int(x.get("buckets", DEFAULTS["cardinality_buckets"])))

    return one(loaded.get("default", {}), "default"), {k: one(v, k) for k, v in loaded.get("overrides", {}).items()}


@dataclass(frozen=True)
class Rule:
    name: str
    service: str
    metric: str
    kind: str
    operation: str = ""
    op: str = ">"
    threshold: float = 0.0
    cooldown_s: int = DEFAULTS["cooldown_s"]
    webhook: str = ""
    slack_webhook: str = ""


def rules(text: str) -> list[Rule]:
    out: dict[str, Rule] = {}
    for i, r in enumerate(_yaml(text).get("rules", [])):
        for needed in ("name", "service", "metric"):
            if not r.get(needed):
                raise ValueError(f"rule {i}: {needed} is required")
        if r["name"] in out:
            raise ValueError(f"rule {r['name']!r} is there twice")
        if not (r.get("webhook") or r.get("slack_webhook")):
            raise ValueError(f"rule {r['name']!r}: a webhook is required")
        if r.get("type") not in ("anomaly", "threshold"):
            raise ValueError(f"rule {r['name']!r}: unknown type {r.get('type')!r}")
        if r["type"] == "threshold" and r.get("op") not in COMPARE:
            raise ValueError(f"rule {r['name']!r}: unknown comparison {r.get('op')!r}")
        cooldown = _duration(r["cooldown"], f"rule {r['name']!r}") // 1_000_000_000 if r.get("cooldown") else DEFAULTS["cooldown_s"]
        out[r["name"]] = Rule(r["name"], r["service"], r["metric"], r["type"], r.get("operation") or "", r.get("op") or ">", float(r.get("threshold") or 0), cooldown, r.get("webhook") or "", r.get("slack_webhook") or "")
    return list(out.values())
