"""Password hashes and signed tokens. These are made one at a time, where a user logs in; no plan has them as a step."""

from __future__ import annotations

import base64
import hashlib
import hmac
import os

# The cost of a password's hash.
COST = {"n": 16384, "r": 8, "p": 1, "dklen": 32}


def base64url(data: bytes) -> str:
    return base64.urlsafe_b64encode(data).decode().rstrip("=")


def signature(message: str, key: str) -> str:
    """HMAC-SHA256 of a message."""
    return base64url(hmac.digest(key.encode(), message.encode(), "sha256"))


def signed(message: str, key: str, mark: str) -> bool:
    return hmac.compare_digest(signature(message, key), mark)


def password_hash(password: str, salt: bytes | None = None) -> str:
    """scheme$salt$hash, by scrypt."""
    salt = os.urandom(16) if salt is None else salt
    parts = (salt, hashlib.scrypt(password.encode(), salt=salt, **COST))
    return "$".join(["scrypt", *(base64.b64encode(p).decode() for p in parts)])


def password_matches(password: str, stored: str) -> bool:
    """Whether a password has this hash; what isn't one matches nothing."""
    scheme, *parts = stored.split("$")
    if scheme != "scrypt" or len(parts) != 2:
        return False
    try:
        salt = base64.b64decode(parts[0], validate=True)
    except ValueError:
        return False
    return hmac.compare_digest(password_hash(password, salt), stored)
