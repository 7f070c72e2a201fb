import json

import pytest

from loomdex.operators import providers as P

ASK = [P.Message("system", "S"), P.Message("user", "U"), P.Message("assistant", "A")]


def test_requests():
    assert P.request("claude", "m", ASK, 5)["system"] == "S" and [m["role"] for m in P.request("claude", "m", ASK, 5)["messages"]] == ["user", "assistant"]
    g = P.request("gemini", "m", ASK, 5)
    assert [c["role"] for c in g["contents"]] == ["user", "model"] and g["systemInstruction"]["parts"][0]["text"] == "S"
    assert [m["role"] for m in P.request("openai", "m", ASK, 5)["messages"]] == ["system", "user", "assistant"] and P.request("local", "m", ASK, 5)["stream"]


def test_replies():
    assert P.reply("claude", json.dumps({"content": [{"type": "x"}, {"type": "text", "text": "hi"}], "usage": {"input_tokens": 2, "output_tokens": 3}})) == P.Reply("hi", 2, 3, 5)
    assert P.reply("gemini", json.dumps({"candidates": [{"content": {"parts": [{"text": "hi"}]}}], "usageMetadata": {"promptTokenCount": 1, "candidatesTokenCount": 2, "totalTokenCount": 4}})) == P.Reply("hi", 1, 2, 4)
    assert P.reply("openai-compat", json.dumps({"choices": [{"message": {"content": "hi"}}], "usage": {"prompt_tokens": 1, "completion_tokens": 2}})) == P.Reply("hi", 1, 2, 3)
    with pytest.raises(P.ProviderError):
        P.reply("openai", json.dumps({"choices": []}))
    sse = "\n".join(["data: " + json.dumps({"choices": [{"delta": {"content": c}}]}) for c in ('{"a"', ":1}", " never read")] + ["data: [DONE]"])
    assert P.reply("local", sse) == P.Reply('{"a":1}')
    lines = "\n".join(json.dumps({"message": {"content": c}, "done": c == "end"}) for c in ("x", '{"b":"}"', "}", "end"))
    assert P.reply("ollama", lines).content == 'x{"b":"}"}'
    with pytest.raises(P.ProviderError):
        P.reply("ollama", json.dumps({"error": "no model"}))


@pytest.mark.parametrize("headers,body,kind,want", [
    ({"retry-after": "3"}, "", "openai", 5000), ({}, "", "claude", 65_000), ({}, "", "local", 5000), ({}, '{"error":{"details":[{"@type":"a/RetryInfo","retryDelay":"35.748s"}]}}', "gemini", 38_000), ({}, "no", "gemini", 65_000),
])
def test_waits(headers, body, kind, want):
    assert P.retry_after_ms(headers, body, kind) == want


class Flaky:
    def __init__(self, *errors):
        self.errors, self.calls = list(errors), 0

    def complete(self, messages, max_tokens=1):
        self.calls += 1
        if self.errors:
            raise self.errors.pop(0)
        return P.Reply("ok")


def test_retries():
    waits = []
    assert P.call_with_retry(Flaky(P.RateLimited(7000), OSError("ECONNRESET")), ASK, sleep=waits.append).content == "ok" and waits == [7, 4]
    for error in (OSError("prompt is too long"), OSError("context length exceeded"), OSError("bad key")):
        f = Flaky(error)
        with pytest.raises(OSError):
            P.call_with_retry(f, ASK, sleep=waits.append)
        assert f.calls == 1
    f = Flaky(*[P.RateLimited(1)] * 5)
    with pytest.raises(P.RateLimited):
        P.call_with_retry(f, ASK, sleep=waits.append)
    assert f.calls == 3


def test_limiter():
    clock = [0.0]
    limiter = P.RateLimiter(2, now=lambda: clock[0], sleep=lambda s: clock.__setitem__(0, clock[0] + s))
    times = []
    for _ in range(5):
        limiter.acquire()
        times.append(clock[0])
    assert times == [0, 0, 60.5, 60.5, 121.0]


def test_factory(monkeypatch):
    assert isinstance(P.make_provider(), P.Stub)
    for args in (("other",), ("openai", "m"), ("local", "m", print), ("claude", "m", print)):
        with pytest.raises(ValueError):
            P.make_provider(*args)
    monkeypatch.setenv("LOOMDEX_API_KEY", "k")
    seen = []
    http = P.make_provider("openai", "m", lambda *a: (seen.append(a), (200, {}, json.dumps({"choices": [{"message": {"content": "hi"}}]})))[1])
    assert http.complete(ASK).content == "hi" and seen[0][1] == {"authorization": "Bearer k"}
    with pytest.raises(P.RateLimited):
        P.make_provider("openai", "m", lambda *a: (429, {"retry-after": "1"}, "")).complete(ASK)
    with pytest.raises(P.ProviderError):
        P.make_provider("ollama", "m", lambda *a: (500, {}, "x"), "http://h/").complete(ASK)


def test_call_model(spark):
    class Half:
        def complete(self, messages, max_tokens=1):
            if "bad" in messages[-1].content:
                raise OSError("bad key")
            return P.Stub().complete(messages)

    rows = P.call_model(spark.createDataFrame([(1, "File: a\nDefines: x, y"), (2, "bad")], "id int, prompt string"), Half, concurrency=2).collect()
    by = {r.id: r for r in rows}
    assert json.loads(by[1].reply)["symbols"][1]["name"] == "y" and by[1].input_tokens is not None and by[2].reply is None and by[2].error == "bad key"
