"""What a client of a local model server must hold to; the transport is the caller's."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from typing import Protocol
from urllib.parse import urlsplit, urlunsplit

#: fixed values: seconds to connect, to read, in all, and to load a model; bytes of an answer
TIMEOUTS = {"connect": 5, "read": 30, "total": 60, "preload": 120}
MOST_BYTES = 2 * 1024 * 1024


class Client(Protocol):
    def post(self, url: str, body: dict) -> tuple[int, Iterable[bytes]]: ...


def root_url(url: str) -> str:
    """The server's root of an endpoint such as .../v1."""
    parts = urlsplit(url.rstrip("/"))
    return urlunsplit((parts.scheme, parts.netloc, parts.path.removesuffix("/v1").rstrip("/"), "", ""))


def limited_json(chunks: Iterable[bytes], most: int = MOST_BYTES) -> object:
    """Strict UTF-8 JSON of a body read piece by piece, given up as soon as it is too long."""
    body = bytearray()
    for c in chunks:
        body += c
        if len(body) > most:
            raise ValueError("the answer is too long")
    return json.loads(body.decode("utf-8", "strict"))


def complete(client: Client, url: str, body: dict, must_stop: bool = False) -> str:
    """The answer's text. A server that refuses `reasoning_effort` (400, 422) is asked once more without it."""
    status, chunks = client.post(url, body)
    if status in (400, 422) and "reasoning_effort" in body:
        status, chunks = client.post(url, {k: v for k, v in body.items() if k != "reasoning_effort"})
    if status != 200:
        raise ConnectionError(f"status {status}")
    choice = limited_json(chunks)["choices"][0]
    if must_stop and choice.get("finish_reason") != "stop":
        raise ValueError("the answer is incomplete")
    return choice["message"]["content"]


def model_status(fetch: Callable[[], tuple[int, Iterable[bytes]]], valid: Callable[[str], bool]) -> tuple[str, list[str]]:
    """(success, empty, unreachable, timeout, invalid_response or unsupported; names of usable models)."""
    try:
        status, chunks = fetch()
        if status in (404, 405):
            return "unsupported", []
        names = [m["name"] for m in limited_json(chunks)["models"]]
    except TimeoutError:
        return "timeout", []
    except OSError:
        return "unreachable", []
    except (ValueError, KeyError, TypeError):
        return "invalid_response", []
    usable = [n for n in dict.fromkeys(names) if isinstance(n, str) and valid(n)]
    return ("success" if usable else "empty"), usable
