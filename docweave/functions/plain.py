"""The text rules of ``functions.text`` for one Python string, for code that walks trees."""

from __future__ import annotations

import json
import re
from typing import Any

_DASH, _COUNT = "[‐‑–—-]", "[0-9]{1,9}"
FORM = rf"[\[(][^\])]*별지\s*(?:제\s*)?{_COUNT}(?:{_DASH}{_COUNT})?\s*호(?:\s*서식)?[^\])]*[\])]"
_SIDE = r"\d{2,3}\s*m{1,3}"
_BACK_PAGE = re.compile(r"\(?\s*(?:[앞뒤]\s*쪽|앞면|뒷면|을지)\s*\)?")
_WORD = re.compile("[0-9A-Za-z가-힣]{2,}")
_PIECE = re.compile(r"[A-Za-z0-9_]{1,4}|[^\sA-Za-z0-9_]")
_HEADING = re.compile(rf"\d{{1,2}}\.\s+\S|[가-힣]\.\s+\S|{FORM}\s*$|{FORM}\s*[^.?!]{{1,60}}$")
STOPS = frozenset("table rows columns context row col chunk".split())


def flat(text: Any) -> str:
    return " ".join(str(text).split())


def clipped(text: str, limit: int) -> str:
    text = text.strip()
    return f"{text[: limit - 1]}…" if len(text) > limit else text


def clipped_clean(text: str, limit: int) -> str:
    return f"{text[: max(0, limit - 1)].rstrip()}…" if len(text) > limit else text


def tokens(text: str) -> int:
    return len(_PIECE.findall(text or ""))


def keywords(text: str, without: frozenset[str] = frozenset(), limit: int = 8) -> list[str]:
    found: dict[str, None] = {}
    for m in _WORD.finditer(text):
        if len(found) >= limit:
            break
        if (w := m[0]).lower() not in without:
            found[w] = None
    return list(found)


def first_line(text: str, limit: int = 100) -> str:
    return next((x[:limit] for line in text.splitlines() if (x := line.strip())), "")


def topic(text: str) -> str:
    return next((clipped_clean(x, 80) for line in text.splitlines() if (x := flat(line))), "")


def flat_summary(text: str) -> str:
    return " ".join(text.strip().split("\n"))[:500]


def first_sentence(text: str) -> str:
    return clipped_clean(re.split(r"(?<=[.!?。！？])\s+", flat(text))[0], 300)


def question_about(text: str) -> list[str]:
    return [f"{text.strip() or '이 청크'}에 대해 무엇을 알 수 있나요?"]


def clean_question(text: str) -> str:
    text = flat(text)
    return text if not text or text[-1] in "?？" else text.rstrip(".。") + "?"


def is_heading(text: str) -> bool:
    short = flat(text)
    return bool(short) and len(short) <= 120 and "\n" not in text.strip() and bool(_HEADING.match(short))


def is_deleted_form(text: str) -> bool:
    return bool(re.fullmatch(rf"{FORM}\s*<[^>]*삭\s*제[^>]*>", flat(text)))


def is_form_heading(text: str) -> bool:
    return len(flat(text)) <= 120 and bool(re.match(FORM, flat(text)))


def is_back_page(text: str) -> bool:
    return bool(_BACK_PAGE.fullmatch(flat(text)[:20]))


def starts_form(text: str) -> bool:
    return not is_back_page(text) and bool(re.search(FORM, flat(text)[:300]))


def starts_case(text: str) -> bool:
    return bool(re.match(r"[○●]?\s*사례\s*\d+(?:\D|$)", flat(text)))


def ends_form(text: str) -> bool:
    text = flat(text)
    return bool(re.search("신문용지|일반용지|재활용품|g/m|g/㎡", text) and re.search(rf"{_SIDE}\s*[xX×]\s*{_SIDE}", text))


def is_question_label(label: str) -> bool:
    low = label.lower()
    return "질의" in label or "질문" in label or low in "q qa q&a question".split() or low.startswith("q ")


def texts_in(value: Any) -> str:
    """All texts of a tree, outermost first."""
    out: list[str] = []

    def walk(x: Any) -> None:
        if isinstance(x, str):
            out.append(x.strip())
        elif isinstance(x, dict):
            if isinstance(x.get("text"), str):
                out.append(x["text"].strip())
            for child in x.values():
                if isinstance(child, (dict, list)):
                    walk(child)
        elif isinstance(x, list):
            for child in x:
                walk(child)

    walk(value)
    return " ".join(x for x in out if x)


def loose_json(text: str) -> Any:
    """As JSON, or what lies between the first opening and last closing brace or bracket as JSON."""
    try:
        return json.loads(text)
    except ValueError:
        at = [i for c in "{[" if (i := text.find(c)) >= 0]
        end = max(text.rfind("}"), text.rfind("]"))
        if not at or end < min(at):
            raise
        return json.loads(text[min(at) : end + 1])


def bounded(value: Any, limit: int = 8000) -> Any:
    """value, or the beginning of its JSON if that is long."""
    text = json.dumps(value, ensure_ascii=False, default=repr)
    return {"truncated": True, "preview": text[:limit]} if len(text) > limit else json.loads(text)
