"""Settings of an agent as dataclasses: defaults, loading, saving and validation."""

from __future__ import annotations

import json
import os
import re
import secrets
import tempfile
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from typing import Any

from edgelens.operators.alerts import AlertRule, AnomalyConfig
from edgelens.streaming import notify

# What holds where a setting is empty, not readable or not positive, in seconds.
DEFAULTS = {"retention": 86_400, "snapshot": 120, "ban": 900, "window": 60, "cooldown": 600, "baseline": 3_600, "eval": 120, "anomaly_cooldown": 900}
UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}


def duration(text: str | None, default: float) -> float:
    """Seconds of a text like ``1h30m`` or ``500ms``; ``default`` if it can't be read or isn't positive."""
    text = (text or "").strip()
    parts = re.findall(r"([0-9]+(?:\.[0-9]*)?|\.[0-9]+)(ns|us|µs|ms|s|m|h)", text)
    if not parts or "".join(a + b for a, b in parts) != text.lstrip("+"):
        return default
    return sum(float(a) * UNITS[b] for a, b in parts) or default


@dataclass
class Site:
    name: str = ""
    path: str = ""

    def label(self) -> str:
        return self.name or self.path


@dataclass
class Rule:
    id: str = ""
    metric: str = "status_count"
    site: str = ""
    status_classes: list[int] = field(default_factory=list)
    window: str = ""
    threshold: int = 0
    cooldown: str = ""
    channels: list[str] = field(default_factory=list)


@dataclass
class Mail:
    host: str = ""
    port: int = 587
    sender: str = ""
    to: list[str] = field(default_factory=list)
    user: str = ""
    password: str = ""


@dataclass
class Anomaly:
    """Empty texts and numbers of 0 or less stand for the defaults."""

    enabled: bool = False
    baseline: str = ""
    eval: str = ""
    cooldown: str = ""
    min_samples: int = 0
    sensitivity: float = 0.0
    floor: float = 0.0


@dataclass
class Guard:
    """What becomes of requests: the score that blocks, the bucket (a rate of 0: none), bans; ``observe`` only flags."""

    mode: str = "observe"
    threshold: int = 10
    rate: float = 0.0
    burst: float = 0.0
    ban: str = ""
    line_score: int = 15


@dataclass
class Config:
    sites: list[Site] = field(default_factory=list)
    retention: str = ""
    route_patterns: list[str] = field(default_factory=list)
    ignore_paths: list[str] = field(default_factory=list)
    rules: list[Rule] = field(default_factory=list)
    webhook_url: str = ""
    webhook_secret: str = ""
    viewer_token: str = ""
    admin_token: str = ""
    mail: Mail = field(default_factory=Mail)
    anomaly: Anomaly = field(default_factory=Anomaly)
    guard: Guard = field(default_factory=Guard)

    def retention_s(self) -> float:
        return duration(self.retention, DEFAULTS["retention"])

    def alert_rules(self) -> list[AlertRule]:
        """The rules as ``streaming.alerting.Tick`` takes them."""
        return [
            AlertRule(r.id, r.metric, r.site, tuple(r.status_classes), int(duration(r.window, DEFAULTS["window"])), r.threshold, int(duration(r.cooldown, DEFAULTS["cooldown"])), tuple(r.channels))
            for r in self.rules
        ]

    def anomaly_config(self) -> AnomalyConfig | None:
        """None where the detector is off."""
        a = self.anomaly
        if not a.enabled:
            return None
        told = {k: v for k in ("min_samples", "sensitivity", "floor") if (v := getattr(a, k)) > 0}
        baseline, last = (max(1, int(duration(t, DEFAULTS[k]) // 60)) for t, k in ((a.baseline, "baseline"), (a.eval, "eval")))
        return AnomalyConfig(baseline, last, int(duration(a.cooldown, DEFAULTS["anomaly_cooldown"])), **told)

    def decision_options(self) -> dict[str, Any]:
        """Rate, burst, ban and mode as ``enforce.decision_step`` takes them."""
        return {"rate": self.guard.rate, "burst": self.guard.burst, "ban_s": int(duration(self.guard.ban, DEFAULTS["ban"])), "enforce": self.guard.mode == "enforce"}

    def channels(self) -> dict[str, Callable[[dict], None]]:
        """The channels that are set up, by name, as ``notify.deliver`` takes them."""
        out: dict[str, Callable[[dict], None]] = {}
        if self.webhook_url:
            out["webhook"] = lambda alert: notify.webhook(self.webhook_url, alert, self.webhook_secret)
        m = self.mail
        if m.host and m.to:
            out["email"] = lambda alert: notify.email(alert, m.host, m.port, m.sender, m.to, m.user, m.password)
        return out

    def problems(self) -> list[tuple[str, str]]:
        """(field, message) of all that can't work."""
        out = []
        for i, s in enumerate(self.sites):
            if not s.path.strip():
                out.append((f"sites[{i}].path", "is empty"))
        names = [s.label() for s in self.sites]
        out += [(f"sites[{i}].name", "is there twice") for i, n in enumerate(names) if n in names[:i]]
        out += [(f"route_patterns[{i}]", "must start with /") for i, p in enumerate(self.route_patterns) if not p.strip().startswith("/")]
        out += [(f"ignore_paths[{i}]", "must start with /") for i, p in enumerate(self.ignore_paths) if not p.strip().startswith("/")]
        for i, r in enumerate(self.rules):
            if not r.id:
                out.append((f"rules[{i}].id", "is empty"))
            elif r.id in [x.id for x in self.rules[:i]]:
                out.append((f"rules[{i}].id", "is there twice"))
            if r.metric not in ("status_count", "ip_request_count"):
                out.append((f"rules[{i}].metric", "is not known"))
            if r.threshold <= 0:
                out.append((f"rules[{i}].threshold", "must be above 0"))
            if r.metric == "status_count" and not r.status_classes:
                out.append((f"rules[{i}].status_classes", "is empty"))
            out += [(f"rules[{i}].status_classes", f"{c} is none of 1 to 5") for c in r.status_classes if c not in range(1, 6)]
        if self.webhook_url and not re.match(r"https?://[^/]+", self.webhook_url):
            out.append(("webhook_url", "must be an http or https url"))
        if self.guard.mode not in ("observe", "enforce"):
            out.append(("guard.mode", "is neither observe nor enforce"))
        if self.mail.host and not (self.mail.sender and self.mail.to):
            out.append(("mail", "needs a sender and someone to send to"))
        return out


def made(raw: dict[str, Any]) -> Config:
    """Settings of JSON; missing tokens are made up. Raises ValueError with all problems."""
    out = Config(**{k: v for k, v in raw.items() if k in Config.__dataclass_fields__ and v is not None})
    out.sites = [s if isinstance(s, Site) else Site(**s) for s in out.sites]
    out.rules = [r if isinstance(r, Rule) else Rule(**r) for r in out.rules]
    for name, kind in (("mail", Mail), ("anomaly", Anomaly), ("guard", Guard)):
        if isinstance(told := getattr(out, name), dict):
            setattr(out, name, kind(**told))
    out.viewer_token = out.viewer_token or secrets.token_hex(24)
    out.admin_token = out.admin_token or secrets.token_hex(24)
    if found := out.problems():
        raise ValueError("; ".join(f"{a}: {b}" for a, b in found))
    return out


def load(path: str) -> Config:
    """The settings of a JSON file, see ``made``."""
    with open(path) as f:
        return made(json.load(f))


def save(config: Config, path: str) -> None:
    """Replaces the file at once."""
    folder = os.path.dirname(os.path.abspath(path))
    handle, name = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "w") as f:
        json.dump(asdict(config), f, indent=2)
    os.replace(name, path)
