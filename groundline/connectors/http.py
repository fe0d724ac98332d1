"""Clients for the chat and embedding endpoints. They are plain callables and easy to replace."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

TIMEOUT = 240


def send(url: str, body: dict | None = None, timeout: float = TIMEOUT) -> dict:
    """GET, or POST of a JSON body; returns the decoded JSON reply ({} when it is empty)."""
    data = None if body is None else json.dumps(body, ensure_ascii=False).encode()
    request = urllib.request.Request(url, data=data, headers={"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as reply:
        raw = reply.read()
    return json.loads(raw) if raw.strip().startswith((b"{", b"[")) else {}


@dataclass
class ChatClient:
    """Chat completions without streaming. Call it with (system prompt, user prompt)."""

    base: str
    model: str
    temperature: float = 0.1
    max_tokens: int = 2048
    timeout: float = TIMEOUT
    transport: Callable[..., dict] = field(default=send, repr=False)

    def url(self, path: str) -> str:
        return self.base.rstrip("/") + path

    def is_healthy(self) -> bool:
        """The health page decides when it can be reached, else the model list."""
        for path in ("/health", "/v1/models"):
            try:
                self.transport(self.url(path), None, self.timeout)
                return True
            except urllib.error.HTTPError:
                return False
            except (OSError, ValueError):
                continue
        return False

    def __call__(self, system: str, user: str) -> str:
        body = {
            "model": self.model,
            "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}],
            "temperature": self.temperature, "max_tokens": self.max_tokens, "stream": False,
        }
        try:
            reply = self.transport(self.url("/v1/chat/completions"), body, self.timeout)
        except (OSError, ValueError) as error:
            raise RuntimeError(f"chat endpoint {self.url('/v1/chat/completions')}: {error}") from error
        choices = reply.get("choices") or [{}]
        return (choices[0].get("message") or {}).get("content") or ""


@dataclass
class EmbeddingClient:
    """Vector of one question from an embedding endpoint."""

    url: str
    timeout: float = TIMEOUT
    transport: Callable[..., dict] = field(default=send, repr=False)

    def embed_query(self, text: str) -> list[float]:
        reply = self.transport(self.url, {"input": [text], "mode": "query"}, self.timeout)
        try:
            return [float(v) for v in reply["data"][0]["embedding"]]
        except (KeyError, IndexError, TypeError) as error:
            raise ValueError("embedding reply without data[0].embedding") from error
