"""Settings as text made into typed parameters, with their defaults; and the small lookup tables of providers."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from textquarry.functions.text import PROVIDER_ALIASES, bind, looked_up

#: Defaults of the settings.
SEARCH_FIELDS = ("title", "description", "content", "author", "place")
SEARCH_SOURCE = "/query-index.json"
LIMIT, FUZZINESS, TEXT_THRESHOLD, IMAGE_THRESHOLD, TOP_K, PAGE_CHARS = 10, 2, 3, 8, 8, 8000
LOCAL_SERVER = "http://localhost:11434"
#: Download sizes of models, the model with and without 16-bit shaders, and the text for other models.
SIZE_HINTS = {
    "Qwen2.5-0.5B-Instruct-q4f16_1-MLC": "~380 MB",
    "Qwen2.5-0.5B-Instruct-q4f32_1-MLC": "~530 MB",
    "Qwen2.5-1.5B-Instruct-q4f16_1-MLC": "~950 MB",
    "Llama-3.2-1B-Instruct-q4f16_1-MLC": "~730 MB",
    "Llama-3.2-1B-Instruct-q4f32_1-MLC": "~1.1 GB",
    "Phi-3.5-mini-instruct-q4f16_1-MLC": "~2.2 GB",
    "gemma-2-2b-it-q4f16_1-MLC": "~1.6 GB",
}
MODEL_F16, MODEL_F32 = "Qwen2.5-0.5B-Instruct-q4f16_1-MLC", "Qwen2.5-0.5B-Instruct-q4f32_1-MLC"
OTHER_SIZE = "a large one-time download"


def text_of(value) -> str:
    """A setting as text: lists are joined, nothing is empty."""
    return (", ".join(map(str, value)) if isinstance(value, (list, tuple)) else "" if value is None else str(value)).strip()


def whole(value) -> int | None:
    """The whole number that the text begins with."""
    m = re.match(r"\s*([+-]?\d+)", text_of(value))
    return int(m[1]) if m else None


def at_least_zero(value, default: int) -> int:
    n = whole(value)
    return n if n is not None and n >= 0 else default


def above_zero(value, default: int) -> int:
    n = whole(value)
    return n if n is not None and n > 0 else default


def source_or_link(source, links: list[str]) -> str:
    """The source, or else the first linked JSON file."""
    return text_of(source) or next((u for u in links if u.endswith(".json")), "")


@dataclass(frozen=True)
class SearchSettings:
    source: str = SEARCH_SOURCE
    fields: tuple[str, ...] = SEARCH_FIELDS
    limit: int = LIMIT
    fuzziness: int = FUZZINESS

    @staticmethod
    def of(raw: dict) -> SearchSettings:
        fields = tuple(f.strip() for f in text_of(raw.get("fields")).split(",") if f.strip())
        edits = whole(raw.get("fuzziness"))
        return SearchSettings(
            text_of(raw.get("source") or raw.get("index")) or SEARCH_SOURCE,
            fields or SEARCH_FIELDS,
            whole(raw.get("limit")) or LIMIT,
            FUZZINESS if edits is None else max(0, min(2, edits)),
        )


def provider_mode(value: Column) -> Column:
    return looked_up(value, PROVIDER_ALIASES, "builtin")


def size_hint(model: Column) -> Column:
    pairs = [x for k, v in SIZE_HINTS.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), model), F.lit(OTHER_SIZE))


def default_model(has_f16: Column) -> Column:
    return F.when(has_f16, MODEL_F16).otherwise(MODEL_F32)


def error_source(stack: Column) -> Column:
    """Where an error came from: the first line of its stack with an address, as name@address."""
    lines = F.filter(F.split(F.coalesce(stack, F.lit("")), "\n"), lambda s: s.rlike("https?://"))
    first = lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, r"at ([^ ]+) \((.+)\)", "$1@$2"), "^( *) at ", "$1@"))
    return bind(F.try_element_at(lines, F.lit(1)), lambda s: F.coalesce(first(s), F.lit("undefined error")))
