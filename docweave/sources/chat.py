"""Chat services: a prompt to JSON over HTTP, with retries.  Nothing calls out unless it is given one of these."""

from __future__ import annotations

import base64
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from docweave.functions import plain
from docweave.operators import enrichment


@dataclass(frozen=True)
class Chat:
    url: str
    model: str
    api_key: str = ""
    temperature: float = 0.0
    timeout: float = 120.0
    retries: int = 2
    backoff: float = 0.5
    retried: frozenset[int] = frozenset((429, 500, 502, 503, 504))
    options: dict = field(default_factory=dict)

    @property
    def endpoint(self) -> str:
        base = self.url.rstrip("/")
        return base if base.endswith("/chat/completions") else f"{base}/chat/completions" if base.endswith("/v1") else f"{base}/v1/chat/completions"


def may_retry(error: Exception, chat: Chat) -> bool:
    if isinstance(error, urllib.error.HTTPError):
        return error.code in chat.retried
    return isinstance(error, (urllib.error.URLError, TimeoutError, ConnectionError))


def persistent(call: Callable[[], str], chat: Chat, sleep: Callable[[float], None] = time.sleep) -> str:
    """call, again after failures that may pass, each time waiting twice as long."""
    for attempt in range(chat.retries + 1):
        try:
            return call()
        except Exception as error:
            if attempt == chat.retries or not may_retry(error, chat):
                raise
            sleep(chat.backoff * 2**attempt)
    raise AssertionError


def ask(prompt: str | list[dict], chat: Chat) -> Any:
    """What a service answers, as JSON; a prompt may be a list of texts and pictures."""
    return plain.loose_json(answer(prompt, chat, "Answer with JSON and nothing else."))


def answer(prompt: str | list[dict], chat: Chat, rule: str) -> str:
    body = {"model": chat.model, "temperature": chat.temperature, "messages": [{"role": "system", "content": rule}, {"role": "user", "content": prompt}], **chat.options}
    request = urllib.request.Request(chat.endpoint, json.dumps(body, ensure_ascii=False).encode(), {"Authorization": f"Bearer {chat.api_key}", "Content-Type": "application/json"}, method="POST")

    def read() -> str:
        with urllib.request.urlopen(request, timeout=chat.timeout) as response:
            return response.read().decode()

    return json.loads(persistent(read, chat))["choices"][0]["message"]["content"]


def picture_reader(chat: Chat) -> Callable[[bytes, int], str]:
    """Reads the text of a page's picture (PNG), for ``layout.parse_with``; a page without a picture has none."""

    def read(picture: bytes, number: int) -> str:
        if not picture:
            return ""
        shown = {"type": "image_url", "image_url": {"url": f"data:image/png;base64,{base64.b64encode(picture).decode()}"}}
        told = {"type": "text", "text": f"Write down all text of page {number + 1} in reading order; tables as lines of cells between bars."}
        return answer([told, shown], chat, "Answer with the text of the picture and nothing else.")

    return read


def _unit(n: int, u: dict) -> dict:
    facts, held = u["metadata"].get("table", {}), u["metadata"].get("asset", {})
    table = {k: [str(h)[:80] for h in v[:12]] if k == "headers" else v for k, v in facts.items() if k in ("table_id", "headers", "row_count")}
    return {"id": u["id"], "index": n, "type": u["type"], "format": u["format"], "section_path": u["metadata"].get("common", {}).get("section_path", []), "source_preview": plain.clipped(u["source"]["text"], 900), "table": table, "asset": {k: plain.clipped(v, 300) if isinstance(v, str) else v for k, v in held.items()}}


def planner(chat: Chat) -> Callable[[list[dict], int], Any]:
    """A planner for ``chunking.chunks`` that asks a service."""

    def plan(window: list[dict], most: int) -> Any:
        units = json.dumps([_unit(n, u) for n, u in enumerate(window, 1)], ensure_ascii=False)
        return ask(f"Group these units, in order, into chunks of at most {most} that each answer one question. Return a list of objects with unit_ids, operations (unit_id, action include or include_rows, row_ranges), context_unit_ids and title. Every unit once.\n{units}", chat)

    return plan


def merger(chat: Chat) -> Callable[[dict, dict, int], Any]:
    def decide(left: dict, right: dict, most: int) -> Any:
        told = json.dumps([enrichment.payload(left), enrichment.payload(right)], ensure_ascii=False)
        return ask(f"Do these two neighbouring chunks belong together (at most {most} units)? Return action merge or keep, reason, title, summary, keywords, questions.\n{told}", chat)

    return decide


def enricher(chat: Chat) -> Callable[[dict], Any]:
    return lambda chunk: ask(f"Return summary, keywords and two to five questions that this chunk answers.\n{json.dumps(enrichment.payload(chunk), ensure_ascii=False)}", chat)


def batch_enricher(chat: Chat) -> Callable[[list[dict]], Any]:
    return lambda chunks: ask(f"For each chunk return id, summary, keywords and two to five questions that it answers, in an object with a list named chunks.\n{json.dumps({'chunks': [enrichment.payload(c) for c in chunks]}, ensure_ascii=False)}", chat)
