"""Signed page cursors and webhook signatures."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json


def cursor(high: int, last: int, filters: dict, secret: bytes) -> str:
    """A token for the next page, bound to the filters of the first."""
    body = json.dumps({"h": high, "l": last, "f": hashlib.sha256(json.dumps(filters, sort_keys=True).encode()).hexdigest()[:16]}).encode()
    mark = hmac.new(secret, body, hashlib.sha256).digest()[:16]
    return base64.urlsafe_b64encode(mark + body).decode().rstrip("=")


def opened(token: str, filters: dict, secret: bytes) -> tuple[int, int]:
    """(high, last) of a token, or ValueError if it is forged or of other filters."""
    try:
        raw = base64.urlsafe_b64decode(token + "=" * (-len(token) % 4))
        mark, body = raw[:16], raw[16:]
        if not hmac.compare_digest(mark, hmac.new(secret, body, hashlib.sha256).digest()[:16]):
            raise ValueError
        found = json.loads(body)
    except ValueError as e:
        raise ValueError("invalid cursor") from e
    if cursor(found["h"], found["l"], filters, secret) != token:
        raise ValueError("the cursor belongs to other filters")
    return found["h"], found["l"]


def signature(timestamp: int, body: bytes, secret: bytes) -> str:
    return "sha256=" + hmac.new(secret, f"{timestamp}.".encode() + body, hashlib.sha256).hexdigest()
