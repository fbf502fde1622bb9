"""Folding of streamed text: deltas, cumulative chunks, and server-sent events cut anywhere.

The batch folds are DataFrame expressions; the streaming fold keeps, for each stream, the text of the line
that has not ended yet and the answer so far.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reconcile(chunks: Column) -> Column:
    """Running text: a chunk that begins with all text so far replaces it, any other is appended."""
    return F.aggregate(chunks, F.lit(""), lambda text, c: F.when((text != "") & c.startswith(text), c).otherwise(F.concat(text, c)))


def _ordered(value: str, seq_col: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq_col).alias("s"), F.coalesce(F.col(value), F.lit("")).alias("c")))), lambda x: x["c"])


def fold_deltas(chunks: DataFrame, *, stream_col: str = "stream_id", seq_col: str = "seq", chunk_col: str = "chunk") -> DataFrame:
    """(stream_id, text): the deltas of a stream one after another."""
    return chunks.groupBy(stream_col).agg(F.array_join(_ordered(chunk_col, seq_col), "").alias("text"))


def fold_chunks(chunks: DataFrame, *, stream_col: str = "stream_id", seq_col: str = "seq", chunk_col: str = "chunk") -> DataFrame:
    """(stream_id, text): chunks that may be deltas or the whole text so far."""
    return chunks.groupBy(stream_col).agg(_ordered(chunk_col, seq_col).alias("c")).select(stream_col, reconcile(F.col("c")).alias("text"))


def delta_of(line: Column) -> Column:
    """The text that a line of an event stream adds; empty for anything that is not data with content."""
    payload = F.trim(F.regexp_extract(line, r"^\s*data:(.*)$", 1))
    delta = F.when((payload != "") & (payload != "[DONE]"), F.get_json_object(payload, "$.choices[0].delta.content"))
    return F.coalesce(delta, F.lit(""))


def fold_events(raw: DataFrame, *, stream_col: str = "stream_id", seq_col: str = "seq", chunk_col: str = "chunk") -> DataFrame:
    """(stream_id, text) of event streams cut at arbitrary places; a last line without an end of line is dropped."""
    whole = fold_deltas(raw, stream_col=stream_col, seq_col=seq_col, chunk_col=chunk_col)
    lines = F.split(F.col("text"), "\n", -1)
    ended = F.slice(lines, F.lit(1), F.size(lines) - 1)
    return whole.select(stream_col, F.array_join(F.transform(ended, delta_of), "").alias("text"))


def last_usage(chunks: DataFrame, *, stream_col: str = "stream_id", seq_col: str = "seq", usage_col: str = "usage") -> DataFrame:
    """(stream_id, usage): what the last chunk that tells usage tells."""
    return chunks.groupBy(stream_col).agg(F.max_by(usage_col, F.when(F.col(usage_col).isNotNull(), F.col(seq_col))).alias("usage"))


def usage_status(tokens_per_second: Column) -> Column:
    """What is said at the end of an answer, with the speed where the last chunk tells one that isn't 0."""
    speed = F.round(tokens_per_second.cast("double")).cast("long").cast("string")
    return F.when(tokens_per_second != 0, F.concat(F.lit("Done · "), speed, F.lit(" tokens/s"))).otherwise("Done")


def latest(events: DataFrame, *, key_cols: list[str], value_col: str, time_col: str) -> DataFrame:
    """Of each key the latest value only, as bursts of key strokes and slider moves are folded."""
    return events.groupBy(*key_cols).agg(F.max_by(value_col, time_col).alias(value_col))


def add_line(line: str) -> str:
    """delta_of() for one line, in Python, for the streaming state."""
    import json

    line = line.strip()
    if not line.startswith("data:"):
        return ""
    payload = line[5:].strip()
    if payload in ("", "[DONE]"):
        return ""
    try:
        content = json.loads(payload)["choices"][0]["delta"].get("content")
    except (ValueError, LookupError, TypeError, AttributeError):
        return ""
    return content if isinstance(content, str) else ""


def stream_events(raw: DataFrame, *, stream_col: str = "stream_id", seq_col: str = "seq", chunk_col: str = "chunk") -> DataFrame:
    """Streaming: (stream_id, text) after every micro-batch. Chunks of one micro-batch are taken by seq.

    State is the unfinished line, the answer so far; there is no event time, so nothing is ever late.
    """

    def fold(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tail, text = state.get if state.exists else ("", "")
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        *lines, tail = (tail + "".join(rows["chunk"].fillna(""))).split("\n")
        text += "".join(map(add_line, lines))
        state.update((tail, text))
        yield pd.DataFrame({"stream_id": [key[0]], "text": [text]})

    rows = raw.select(F.col(stream_col).alias("stream_id"), F.col(seq_col).alias("seq"), F.col(chunk_col).alias("chunk"))
    kind = rows.schema["stream_id"].dataType.simpleString()
    return rows.groupBy("stream_id").applyInPandasWithState(fold, f"stream_id {kind}, text string", "tail string, text string", "update", "NoTimeout")


def sampled(events: DataFrame, weight: int, *, id_col: str = "event_id") -> DataFrame:
    """One of `weight` events, by a hash of the id, with its weight; 0 keeps none."""
    if weight <= 0:
        return events.where("false").withColumn("weight", F.lit(0))
    hashed = F.conv(F.substr(F.md5(F.col(id_col).cast("string")), F.lit(1), F.lit(8)), 16, 10).cast("long")
    return events.where(hashed % weight == 0).withColumn("weight", F.lit(weight))


def ping_json(columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns))


class Provider:
    """A source of answers. detect() says (usable, reason); run(prompt) yields chunks."""

    name = "none"
    #: It fetches a model first, which "auto" does only with consent.
    is_download = False

    def detect(self) -> tuple[bool, str]:
        return False, "no provider"

    def run(self, prompt: str) -> Iterator[str]:
        raise NotImplementedError


class EchoProvider(Provider):
    """Deterministic stand-in: gives the prompt back word by word."""

    name = "builtin"

    def detect(self) -> tuple[bool, str]:
        return True, ""

    def run(self, prompt: str) -> Iterator[str]:
        for k, word in enumerate(prompt.split(" ")):
            yield word if not k else " " + word


class ServerProvider(Provider):
    """A model server: `names` lists its models (a callable, so that no address is built in); the wanted one or the first is used."""

    name = "local"

    def __init__(self, names, answer, wanted: str | None = None):
        self.names, self.answer, self.wanted, self.model = names, answer, wanted, None

    def detect(self) -> tuple[bool, str]:
        try:
            found = list(self.names())
        except OSError as e:
            return False, f"server not reached: {e}"
        if not found:
            return False, "server has no models"
        self.model = self.wanted if self.wanted in found else found[0]
        return True, ""

    def run(self, prompt: str) -> Iterator[str]:
        return self.answer(self.model, prompt)


class Interrupted(Exception):
    """Raised by a provider whose answer was stopped on request."""


def answer(provider: Provider, prompt: str, stop: Callable[[], bool] = lambda: False) -> tuple[str, str]:
    """(text, state) of one question: done, stopped with what came before, or failed with the reason.

    Each question starts anew: a provider gets its own copy, so nothing of an earlier one is kept.
    """
    text, own = "", copy.copy(provider)
    try:
        for chunk in own.run(prompt):
            if stop():
                return text, "stopped"
            text += chunk
    except Interrupted:
        return text, "stopped"
    except Exception as e:  # noqa: BLE001 - whatever a provider raises is its answer's end
        return text, f"failed: {e}"
    return text, "done"


def first_usable(providers: list[Provider], mode: str = "auto", *, consent: bool = True, retries: int = 0) -> tuple[Provider | None, str]:
    """The first provider that works, or none and all reasons; a mode other than auto names the only candidate.

    Without consent auto passes over those that download. A named one is asked again up to `retries` times.
    """
    reasons = []
    for p in providers:
        if mode == "auto" and p.is_download and not consent:
            continue
        if mode in ("auto", p.name):
            for _ in range(1 if mode == "auto" else 1 + retries):
                ok, reason = p.detect()
                if ok:
                    break
            if ok:
                return p, ""
            reasons.append(reason)
    return None, " · ".join(r for r in reasons if r)
