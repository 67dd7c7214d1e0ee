"""Users in a JSON file: names with salted, slow password hashes."""

from __future__ import annotations

import hashlib
import hmac
import json
import os
import secrets
from pathlib import Path

ROUNDS = 200_000


def _hashed(password: str, salt: str, rounds: int) -> str:
    return hashlib.pbkdf2_hmac("sha256", password.encode(), bytes.fromhex(salt), rounds).hex()


def _load(path: str | Path) -> dict:
    return json.loads(Path(path).read_text()) if Path(path).exists() else {}


def create_user(path: str | Path, name: str, password: str, rounds: int = ROUNDS) -> None:
    """Adds a user or changes its password; names are without `:`, which ends them in a token."""
    if not name or ":" in name:
        raise ValueError("a user needs a name without `:`")
    users, salt = _load(path), secrets.token_hex(16)
    users[name] = {"salt": salt, "rounds": rounds, "hash": _hashed(password, salt, rounds)}
    part = Path(f"{path}.part")
    part.write_text(json.dumps(users, indent=1))
    part.chmod(0o600)
    os.replace(part, path)


def authenticate(path: str | Path, token: str) -> str | None:
    """The user's name if the token `name:password` is right, else None; the password may hold `:`."""
    name, _, password = token.partition(":")
    user = _load(path).get(name)
    known = user or {"salt": "00" * 16, "rounds": ROUNDS, "hash": ""}
    right = hmac.compare_digest(_hashed(password, known["salt"], known["rounds"]), known["hash"])
    return name if user and right else None
