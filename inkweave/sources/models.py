"""What an outside model does: a reader of page images is a function that the caller gives. Nothing here opens a connection."""

from __future__ import annotations

import importlib
import json
import re
from collections.abc import Callable, Iterable
from pathlib import Path

MODES = ("verse", "prose", "dictionary")


def read_page(image: str, model: Callable[[str, str], dict], mode: str = "verse") -> dict:
    """What ``model(image, mode)`` answers, for a known mode."""
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    return model(image, mode)


def coerce_json(text: str) -> dict:
    """The object in a JSON text; of a list, the first object."""
    value = json.loads(text)
    if isinstance(value, list):
        value = next((x for x in value if isinstance(x, dict)), None)
    if not isinstance(value, dict):
        raise ValueError("no JSON object")
    return value


def read_pages(images: Iterable[str], state: Callable[[str], str], model: Callable[[str, str], dict], record: Callable[[str, dict], str], mode: str = "verse", force: bool = False) -> dict[str, str]:
    """Asks for each page once, and only for pending ones unless forced. One page's failure doesn't end the batch."""
    out = {}
    for image in dict.fromkeys(images):
        if not force and (was := state(image)) != "pending":
            out[image] = was
            continue
        try:
            out[image] = record(image, read_page(image, model, mode))
        except Exception as e:  # noqa: BLE001
            out[image] = f"error: {e}"
    return out


def reader(name: str) -> Callable:
    """The function that ``module:function`` names."""
    module, _, function = name.partition(":")
    if not function:
        raise ValueError(f"a reader is module:function, not {name}")
    return getattr(importlib.import_module(module), function)


def request_parts(images: Iterable[str]) -> list[dict]:
    """What a reader of consecutive dictionary pages is given: the task, and each page's image and first reading. Pages have names of three digits."""
    parts: list[dict] = [{"text": "Extract the entries of these consecutive dictionary pages."}]
    for image in map(Path, images):
        if not re.fullmatch(r"\d{3}", image.stem):
            raise ValueError(f"a page's name has three digits: {image}")
        text = image.with_suffix(".txt").read_text(encoding="utf-8")
        parts += [{"text": f"Image of page {image.stem}:"}, {"image": str(image)}, {"text": f"First reading of page {image.stem}, with mistakes:\n{text}"}]
    return parts


def extract_once(images: list[str], response: Path, model: Callable[[list[dict]], dict]) -> dict:
    """What ``model`` answers for the pages, kept in ``response``. A response that is there is never asked for again, nor replaced."""
    if response.exists():
        raise FileExistsError(f"there is a response already: {response}")
    answer = dict(model(request_parts(images)))
    answer["request"] = {"model": answer.get("model"), "pages": [Path(x).stem for x in images]}
    response.parent.mkdir(parents=True, exist_ok=True)
    new = response.with_suffix(response.suffix + ".new")
    new.write_text(json.dumps(answer, ensure_ascii=False), encoding="utf-8")
    new.replace(response)
    return answer
