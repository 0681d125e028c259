"""Alerts to a webhook or by mail, from the driver: a micro-batch has few of them."""

from __future__ import annotations

import hashlib
import hmac
import json
import smtplib
import urllib.request
from email.message import EmailMessage
from urllib.parse import urlsplit

from pyspark.sql import DataFrame

TIMEOUT_S = 5
CHAT_HOST = "chat.googleapis.com"


def payload(url: str, alert: dict) -> bytes:
    """A chat message for a chat's webhook, else the alert as JSON."""
    if (urlsplit(url).hostname or "").lower() == CHAT_HOST:
        where = f" [{alert['site']}]" if alert.get("site") else ""
        return json.dumps({"text": f"*{alert.get('id', '')}*{where}\n{alert.get('message', '')}"}).encode()
    return json.dumps(alert, default=str).encode()


def signature(body: bytes, secret: str) -> str:
    return hmac.new(secret.encode(), body, hashlib.sha256).hexdigest()


def webhook(url: str, alert: dict, secret: str = "", send=urllib.request.urlopen) -> None:
    """Raises where the answer isn't below 300. Chats get no signature."""
    body = payload(url, alert)
    request = urllib.request.Request(url, body, {"Content-Type": "application/json"}, method="POST")
    if secret and (urlsplit(url).hostname or "").lower() != CHAT_HOST:
        request.add_header("X-Signature", signature(body, secret))
    with send(request, timeout=TIMEOUT_S) as answer:
        if answer.status >= 300:
            raise OSError(f"webhook answered {answer.status}")


def mail(alert: dict, sender: str, to: list[str]) -> EmailMessage:
    out = EmailMessage()
    out["From"], out["To"], out["Subject"] = sender, ", ".join(to), f"[alert] {alert.get('id', '')} {alert.get('site') or 'all sites'}"
    out.set_content(alert.get("message", ""))
    return out


def email(alert: dict, host: str, port: int, sender: str, to: list[str], user: str = "", password: str = "") -> None:
    """By implicit TLS on port 465, else by STARTTLS where the server offers it."""
    with smtplib.SMTP_SSL(host, port, timeout=8) if port == 465 else smtplib.SMTP(host, port, timeout=8) as server:
        if port != 465:
            server.ehlo()
            if server.has_extn("starttls"):
                server.starttls()
        if user:
            server.login(user, password)
        server.send_message(mail(alert, sender, to))


def deliver(routed: DataFrame, channels: dict) -> list[str]:
    """Sends each routed alert (see alerts.routed) by its channel's function; the failures, as text. Nothing is sent again."""
    failed = []
    for row in routed.toLocalIterator():
        alert = row.asDict()
        try:
            channels[alert.pop("channel")](alert)
        except Exception as e:  # a channel that is down doesn't keep the others from being used
            failed.append(f"{alert.get('id')}: {e}")
    return failed


def send_test(channels: dict, wanted: list[str] | None = None) -> dict[str, str]:
    """A test alert by each channel that is wanted and set up, or by all: its error as text, empty where it arrived."""
    out = {}
    for name in [c for c in channels if not wanted or c in wanted]:
        try:
            channels[name]({"id": "test", "kind": "test", "site": "", "message": "This is a test alert."})
            out[name] = ""
        except Exception as e:  # each channel is tried
            out[name] = str(e) or type(e).__name__
    return out
