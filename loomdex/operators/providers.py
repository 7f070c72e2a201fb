"""Model providers: message shapes, replies, retries, rate limits, and the operator that calls them.

The default is an offline stub. Others take a ``transport`` callable (url, headers, body) ->
(status, headers, text), so that no client library is needed and tests need no network.
"""

from __future__ import annotations

import json
import math
import os
import re
import time
from collections import deque
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, functions as F

# Output limits, retries and waits.
MAX_TOKENS_SINGLE, MAX_TOKENS_BATCH = 4096, 8192
TRIES, WAIT_STEP_MS, WAIT_MOST_MS = 3, 2000, 10_000
LOCAL_RETRY_MS, DEFAULT_RETRY_MS, RETRY_BUFFER_MS = 5000, 65_000, 2000
TEMPERATURE = 0.2
CONTEXT_ERROR = r"(?i)exceed_context_size|context.*(size|length)|too.?many.?tokens|prompt.*too.?long"
NETWORK_ERROR = r"(?i)terminated|econnreset|econnrefused|etimedout|und_err_socket|fetch failed|network|socket hang up"
SYSTEM_PROMPT = (
    "Describe source code for people and tools that search it. Say what it does, why it is there and what its limits are, "
    "in plain English and without repeating the code. Answer with one JSON object and nothing else."
)


@dataclass(frozen=True)
class Message:
    role: str
    content: str


@dataclass(frozen=True)
class Reply:
    content: str
    input_tokens: int | None = None
    output_tokens: int | None = None
    tokens_used: int | None = None


class RateLimited(Exception):
    def __init__(self, wait_ms: int):
        super().__init__(f"rate limited; wait {wait_ms} ms")
        self.wait_ms = wait_ms


class ProviderError(Exception):
    pass


class Provider(Protocol):
    def complete(self, messages: list[Message], max_tokens: int = MAX_TOKENS_SINGLE) -> Reply: ...


BATCH_HEAD = "Several files; answer with one object keyed by their paths."


NO_OVERVIEW = "\nFields: symbols; leave overview empty"


class Stub:
    """Answers from the prompt alone: an overview line and one symbol for each declared name, by file where there are several."""

    def complete(self, messages: list[Message], max_tokens: int = MAX_TOKENS_SINGLE) -> Reply:
        prompt = messages[-1].content
        entries = {}
        for part in re.split(r"(?m)^(?=File: )", prompt)[1:]:
            path, names = part.split("\n", 1)[0][6:], re.search(r"^Defines: (.*)$", part, re.M)
            symbols = [{"name": n, "kind": "symbol", "line": 0, "purpose": f"Defines {n}.", "behavior": ""} for n in names[1].split(", ")] if names and names[1] else []
            entries.setdefault(path, {"overview": "" if f"{NO_OVERVIEW}\n```\n" in part else f"Overview of {path}.", "symbols": symbols})
        whole = entries if prompt.startswith(BATCH_HEAD) else next(iter(entries.values()), {"overview": "Overview of a file.", "symbols": []})
        body = json.dumps(whole)
        return Reply(body, len(prompt) // 4, len(body) // 4)


def retry_after_ms(status_headers: dict, body: str, provider: str) -> int:
    """How long a provider asks to wait: its header, its body, or the provider's default."""
    if provider in ("local", "ollama", "openai-compat"):
        return LOCAL_RETRY_MS
    if provider == "gemini":
        try:
            details = json.loads(body)["error"]["details"]
            delay = next(d["retryDelay"] for d in details if d.get("@type", "").endswith("RetryInfo") and d.get("retryDelay"))
            return math.ceil(float(delay.rstrip("s"))) * 1000 + RETRY_BUFFER_MS
        except (ValueError, KeyError, TypeError, StopIteration):
            return DEFAULT_RETRY_MS
    try:
        return int(status_headers["retry-after"]) * 1000 + RETRY_BUFFER_MS
    except (KeyError, ValueError, TypeError):
        return DEFAULT_RETRY_MS


class JsonEnd:
    """Tells when a streamed object is complete; strings and escapes are honoured from the first character on."""

    def __init__(self):
        self.depth, self.in_string, self.escaped, self.begun = 0, False, False, False

    def feed(self, text: str) -> bool:
        for c in text:
            if self.escaped:
                self.escaped = False
            elif self.in_string and c == "\\":
                self.escaped = True
            elif c == '"':
                self.in_string = not self.in_string
            elif not self.in_string and c in "{}":
                self.depth += 1 if c == "{" else -1
                self.begun = self.begun or c == "{"
                if self.begun and not self.depth:
                    return True
        return False


def stream_text(lines: Iterable[str], kind: str) -> str:
    """Content of a stream of SSE ('sse') or newline-delimited JSON ('ndjson') lines, up to the end of its first object."""
    out, end = [], JsonEnd()
    for line in lines:
        line = line.strip()
        if kind == "sse":
            if not line.startswith("data:"):
                continue
            line = line[5:].strip()
            if line == "[DONE]":
                break
        if not line:
            continue
        try:
            event = json.loads(line)
        except ValueError:
            continue
        if event.get("error"):
            raise ProviderError(str(event["error"]))
        choices = event.get("choices") or [{}]
        piece = (event.get("message") or {}).get("content", "") if kind == "ndjson" else (choices[0].get("delta") or {}).get("content") or ""
        out.append(piece)
        if end.feed(piece) or event.get("done"):
            break
    if not "".join(out).strip():
        raise ProviderError("the model sent nothing")
    return "".join(out)


def request(provider: str, model: str, messages: list[Message], max_tokens: int) -> dict:
    """Body of a provider's request."""
    plain = [{"role": m.role, "content": m.content} for m in messages]
    system = "\n".join(m.content for m in messages if m.role == "system")
    rest = [m for m in messages if m.role != "system"]
    if provider == "claude":
        return {"model": model, "max_tokens": max_tokens, "messages": [{"role": m.role, "content": m.content} for m in rest], **({"system": system} if system else {})}
    if provider == "gemini":
        body = {"contents": [{"role": "model" if m.role == "assistant" else "user", "parts": [{"text": m.content}]} for m in rest], "generationConfig": {"maxOutputTokens": max_tokens, "temperature": TEMPERATURE}}
        return body | ({"systemInstruction": {"parts": [{"text": system}]}} if system else {})
    if provider == "ollama":
        return {"model": model, "messages": plain, "stream": True, "options": {"num_predict": max_tokens, "temperature": TEMPERATURE}}
    return {"model": model, "messages": plain, "max_tokens": max_tokens, "temperature": TEMPERATURE, **({"stream": True} if provider == "local" else {})}


def reply(provider: str, text: str) -> Reply:
    """A provider's answer in one shape. Streams tell no token counts."""
    if provider == "ollama":
        return Reply(stream_text(text.splitlines(), "ndjson"))
    if provider == "local" and text.lstrip().startswith("data:"):
        return Reply(stream_text(text.splitlines(), "sse"))
    body = json.loads(text)
    if provider == "claude":
        content = next((b["text"] for b in body.get("content", []) if b.get("type") == "text"), "")
        u = body.get("usage") or {}
        a, b = u.get("input_tokens"), u.get("output_tokens")
        out = Reply(content, a, b, a + b if a is not None and b is not None else None)
    elif provider == "gemini":
        parts = ((body.get("candidates") or [{}])[0].get("content") or {}).get("parts") or [{}]
        u = body.get("usageMetadata") or {}
        out = Reply(parts[0].get("text", ""), u.get("promptTokenCount"), u.get("candidatesTokenCount"), u.get("totalTokenCount"))
    else:
        u = body.get("usage") or {}
        a, b, t = u.get("prompt_tokens"), u.get("completion_tokens"), u.get("total_tokens")
        out = Reply(((body.get("choices") or [{}])[0].get("message") or {}).get("content") or "", a, b, t if t is not None else a + b if a is not None and b is not None else None)
    if not out.content:
        raise ProviderError(f"{provider} sent no content")
    return out


# Where each provider listens.
ENDPOINTS = {
    "openai": "https://api.openai.com/v1/chat/completions", "claude": "https://api.anthropic.com/v1/messages",
    "gemini": "https://generativelanguage.googleapis.com/v1beta/models/{model}:generateContent",
    "local": "{base}/chat/completions", "ollama": "{base}/api/chat", "openai-compat": "{base}/chat/completions",
}


@dataclass
class Http:
    """A provider behind a transport; keys come from the environment variable that ``key_variable`` names."""

    kind: str
    model: str
    transport: Callable[[str, dict, dict], tuple[int, dict, str]]
    base_url: str = ""
    key_variable: str = "LOOMDEX_API_KEY"

    def complete(self, messages: list[Message], max_tokens: int = MAX_TOKENS_SINGLE) -> Reply:
        key = os.environ.get(self.key_variable, "")
        headers = {"claude": {"x-api-key": key, "anthropic-version": "2023-06-01"}, "gemini": {"x-goog-api-key": key}, "ollama": {}}.get(self.kind, {"authorization": f"Bearer {key}"} if key else {})
        url = ENDPOINTS[self.kind].format(model=self.model, base=self.base_url.rstrip("/"))
        status, got, text = self.transport(url, headers, request(self.kind, self.model, messages, max_tokens))
        if status == 429:
            raise RateLimited(retry_after_ms(got, text, self.kind))
        if status >= 400:
            raise ProviderError(f"{status}: {text[:500]}")
        return reply(self.kind, text)


def make_provider(kind: str = "stub", model: str = "", transport=None, base_url: str = "", key_variable: str = "LOOMDEX_API_KEY") -> Provider:
    """ValueError where a provider lacks what it needs: a model, an address, a key or a transport."""
    if kind == "stub":
        return Stub()
    if kind not in ENDPOINTS:
        raise ValueError(f"no provider {kind!r}")
    missing = [n for n, ok in (("model", model), ("transport", transport), ("base_url", base_url or "{base}" not in ENDPOINTS[kind]), (key_variable, kind not in ("openai", "claude", "gemini") or os.environ.get(key_variable))) if not ok]
    if missing:
        raise ValueError(f"{kind} needs {', '.join(missing)}")
    return Http(kind, model, transport, base_url, key_variable)


class RateLimiter:
    """At most ``limit`` acquisitions in any window; one that is as old as the window counts no more."""

    def __init__(self, limit: int, window_ms: int = 60_000, buffer_ms: int = 500, now=time.monotonic, sleep=time.sleep):
        self.limit, self.window, self.buffer, self.now, self.sleep, self.taken = limit, window_ms / 1000, buffer_ms / 1000, now, sleep, deque()

    def acquire(self) -> None:
        while True:
            t = self.now()
            while self.taken and t - self.taken[0] >= self.window:
                self.taken.popleft()
            if len(self.taken) < self.limit:
                self.taken.append(t)
                return
            self.sleep(self.window - (t - self.taken[0]) + self.buffer)


def call_with_retry(provider: Provider, messages: list[Message], max_tokens: int = MAX_TOKENS_SINGLE, sleep=time.sleep) -> Reply:
    """Up to three tries after rate limits and network failures; other errors, context overflow among them, are final."""
    for attempt in range(1, TRIES + 1):
        try:
            return provider.complete(messages, max_tokens)
        except RateLimited as e:
            if attempt == TRIES:
                raise
            sleep(e.wait_ms / 1000)
        except Exception as e:
            if attempt == TRIES or re.search(CONTEXT_ERROR, str(e)) or not re.search(NETWORK_ERROR, str(e)):
                raise
            sleep(min(WAIT_STEP_MS * attempt, WAIT_MOST_MS) / 1000)
    raise AssertionError


def is_retryable(error: Column) -> Column:
    return F.coalesce(error.rlike(NETWORK_ERROR) & ~error.rlike(CONTEXT_ERROR), F.lit(False))


def prompt() -> Column:
    """The prompt of a group: columns path, language, group_no, n_groups, wants_overview, symbol_names, dep_context, combined_content."""
    c, line = F.col, lambda title, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"\n{title}: "), v)).otherwise("")
    part = F.when(c("n_groups") > 1, F.concat(F.lit("\nPart: "), (c("group_no") + 1).cast("string"), F.lit("/"), c("n_groups").cast("string"))).otherwise("")
    ask = F.when(c("wants_overview"), "\nFields: overview, symbols").otherwise(NO_OVERVIEW)
    return F.concat(F.lit("File: "), c("path"), F.lit("\nLanguage: "), c("language"), part, line("Dependencies", c("dep_context")), line("Defines", F.array_join("symbol_names", ", ")), ask, F.lit("\n```\n"), c("combined_content"), F.lit("\n```"))


def batch_section() -> Column:
    """One file of a batch prompt: columns path, language, symbol_names, dep_context, content."""
    line = lambda title, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"\n{title}: "), v)).otherwise("")
    return F.concat(F.lit("File: "), "path", F.lit("\nLanguage: "), "language", line("Dependencies", F.col("dep_context")), line("Defines", F.array_join("symbol_names", ", ")), F.lit("\n```\n"), "content", F.lit("\n```"))


def batch_prompt(sections: Column, paths: Column) -> Column:
    """The prompt of a batch; the first two paths show the form of the answer."""
    example = F.array_join(F.transform(F.slice(paths, 1, 2), lambda p: F.concat(F.lit('"'), p, F.lit('": {"overview": "...", "symbols": []}'))), ", ")
    return F.concat(F.lit(BATCH_HEAD + "\nPaths: "), F.array_join(paths, ", "), F.lit("\nForm: {"), example, F.lit("}\n\n"), F.array_join(sections, "\n\n"))


def call_model(rows: DataFrame, make: Callable[[], Provider] = Stub, rpm: int = 10_000, concurrency: int = 1, max_tokens: int = MAX_TOKENS_SINGLE) -> DataFrame:
    """``rows`` (with ``prompt``) plus reply, input_tokens, output_tokens, tokens_used, duration_ms and error.

    ``concurrency`` partitions, but no more than the rate allows calls, call at once and share the rate
    evenly; with one, all rows go through a single task. Write the result before using it twice: a
    second action would call again.
    """
    concurrency = max(1, min(concurrency, rpm))
    names = ["reply", "input_tokens", "output_tokens", "tokens_used", "duration_ms", "error"]

    def run(frames):
        provider, limiter = make(), RateLimiter(rpm // concurrency)
        for f in frames:
            out = []
            for text in f["prompt"]:
                limiter.acquire()
                t = time.monotonic()
                try:
                    r, error = call_with_retry(provider, [Message("system", SYSTEM_PROMPT), Message("user", text)], max_tokens), None
                except Exception as e:  # an error is this row's result
                    r, error = Reply(""), str(e)
                out.append((r.content if not error else None, r.input_tokens, r.output_tokens, r.tokens_used, int(1000 * (time.monotonic() - t)), error))
            for i, n in enumerate(names):
                import pandas as pd

                f[n] = pd.Series([o[i] for o in out], index=f.index, dtype=object if n in ("reply", "error") else "Int64")
            yield f

    from pyspark.sql.types import LongType, StringType, StructField, StructType

    kinds = [StringType(), LongType(), LongType(), LongType(), LongType(), StringType()]
    schema = StructType([*rows.schema.fields, *(StructField(n, k) for n, k in zip(names, kinds, strict=True))])
    return rows.repartition(concurrency, F.xxhash64("prompt")).mapInPandas(run, schema)


def shape_messages(conversations: DataFrame) -> DataFrame:
    """Each conversation as providers want it: system texts lifted out, the assistant's role renamed where asked."""
    c = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    rest = F.filter("m", lambda x: x["role"] != "system")
    return c.select(
        "conv_id", F.array_join(F.transform(F.filter("m", lambda x: x["role"] == "system"), lambda x: x["text"]), "\n").alias("system_text"), F.size(rest).cast("long").alias("n_messages"),
        F.nullif(F.array_join(F.transform(rest, lambda x: F.when(x["role"] == "assistant", "model").otherwise(x["role"])), ","), F.lit("")).alias("gemini_roles"),
    )
