import json

import pytest

from edgelens.operators import alerts
from edgelens.plans import config
from edgelens.streaming import notify


def test_durations():
    assert [config.duration(t, 9) for t in ("1h30m", "500ms", "", "x", "-5s", "0s", None, "1.5h")] == [5400, 0.5, 9, 9, 9, 9, 9, 5400]


def test_load_save_and_problems(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"sites": [{"name": "", "path": "/var/log/a"}], "rules": [{"id": "r", "status_classes": [5], "threshold": 3}], "route_patterns": None}))
    made = config.load(str(path))
    assert made.sites[0].label() == "/var/log/a" and made.retention_s() == 86400 and len(made.admin_token) == 48 and made.route_patterns == []
    config.save(made, str(path))
    assert config.load(str(path)) == made
    bad = config.Config(sites=[config.Site("a", ""), config.Site("a", "/x")], rules=[config.Rule("r", threshold=0, status_classes=[7])], ignore_paths=["x"], webhook_url="ftp://x")
    assert [f for f, _ in bad.problems()] == ["sites[0].path", "sites[1].name", "ignore_paths[0]", "rules[0].threshold", "rules[0].status_classes", "webhook_url"]
    path.write_text(json.dumps({"rules": [{"id": "r"}]}))
    with pytest.raises(ValueError, match="threshold"):
        config.load(str(path))


class Answer:
    def __init__(self, status):
        self.status = status

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False


def test_webhooks():
    alert = {"id": "r5", "site": "shop", "message": "five"}
    assert json.loads(notify.payload("https://chat.googleapis.com/v1/x", alert)) == {"text": "*r5* [shop]\nfive"}
    assert json.loads(notify.payload("https://example.org/h", alert)) == alert
    sent = []
    notify.webhook("https://example.org/h", alert, "key", lambda r, timeout: sent.append(r) or Answer(204))
    assert sent[0].get_header("X-signature") == notify.signature(sent[0].data, "key")
    with pytest.raises(OSError, match="500"):
        notify.webhook("https://example.org/h", alert, "", lambda r, timeout: Answer(500))
    assert notify.mail(alert, "a@x", ["b@y"])["Subject"] == "[alert] r5 shop"


def test_settings_of_alerts_and_enforcement(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({
        "rules": [{"id": "r", "status_classes": [5], "threshold": 3, "window": "2m", "cooldown": "x", "channels": ["email"]}],
        "anomaly": {"enabled": True, "baseline": "30m", "sensitivity": 2.5}, "mail": {"host": "mx", "sender": "a@x", "to": ["b@y"]},
        "guard": {"mode": "enforce", "rate": 5, "burst": 10, "ban": "1h"}, "webhook_url": "https://example.org/h",
    }))
    made = config.load(str(path))
    assert made.alert_rules() == [alerts.AlertRule("r", classes=(5,), window_s=120, threshold=3, cooldown_s=600, channels=("email",))]
    assert made.anomaly_config() == alerts.AnomalyConfig(baseline_min=30, sensitivity=2.5)
    assert made.decision_options() == {"rate": 5, "burst": 10, "ban_s": 3600, "enforce": True}
    assert list(made.channels()) == ["webhook", "email"] and made.guard.line_score == 15
    config.save(made, str(path))
    assert config.load(str(path)) == made
    empty = config.Config()
    assert (empty.anomaly_config(), empty.channels(), empty.decision_options()) == (None, {}, {"rate": 0.0, "burst": 0.0, "ban_s": 900, "enforce": False})
    bad = config.Config(mail=config.Mail("mx"), guard=config.Guard("maybe"))
    assert [f for f, _ in bad.problems()] == ["guard.mode", "mail"]


def test_test_alerts():
    def down(alert):
        raise OSError("no route")

    got = []
    assert notify.send_test({"webhook": got.append, "email": down}) == {"webhook": "", "email": "no route"}
    assert got[0]["id"] == "test" and notify.send_test({"webhook": got.append, "email": down}, ["email", "fax"]) == {"email": "no route"}
