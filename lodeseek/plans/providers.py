"""Models over HTTP, by the form of their requests and replies (M2).

Three forms cover the services in use: "chat" (a list of messages with roles, which local servers speak too),
"messages" (a system text beside the messages) and "contents" (contents made of parts). Keys are given by the
caller or read from the environment, and stand in headers only.
"""

import json
import os
import urllib.request
from collections.abc import Callable, Mapping

from lodeseek.sources.connect import redact

TIMEOUT = 60


def _post(url: str, headers: Mapping[str, str], body: dict, timeout: float = TIMEOUT) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers}, method="POST")
    with urllib.request.urlopen(request, timeout=timeout) as reply:
        return json.loads(reply.read())


def _chat(model: str, system: str, prompt: str, most: int) -> dict:
    return {"model": model, "max_tokens": most, "temperature": 0, "messages": [{"role": "system", "content": system}, {"role": "user", "content": prompt}]}


def _messages(model: str, system: str, prompt: str, most: int) -> dict:
    return {"model": model, "max_tokens": most, "system": system, "messages": [{"role": "user", "content": prompt}]}


def _contents(model: str, system: str, prompt: str, most: int) -> dict:
    return {"systemInstruction": {"parts": [{"text": system}]}, "contents": [{"role": "user", "parts": [{"text": prompt}]}], "generationConfig": {"maxOutputTokens": most, "temperature": 0}}


#: form: how a request is made, where the text of a reply stands, and the header that has the key.
FORMS: dict[str, tuple[Callable, Callable[[dict], str], Callable[[str], dict]]] = {
    "chat": (_chat, lambda r: r["choices"][0]["message"]["content"], lambda key: {"Authorization": f"Bearer {key}"}),
    "messages": (_messages, lambda r: "".join(p.get("text", "") for p in r["content"]), lambda key: {"x-api-key": key}),
    "contents": (_contents, lambda r: "".join(p.get("text", "") for p in r["candidates"][0]["content"]["parts"]), lambda key: {"x-goog-api-key": key}),
}


class HttpProvider:
    """A provider of one of FORMS. headers go with each request; post can be replaced, for signed requests or tests."""

    def __init__(self, url: str, model: str, form: str = "chat", key: str | None = None, headers: Mapping[str, str] | None = None, embed_url: str | None = None, embed_model: str | None = None, post: Callable = _post):
        if form not in FORMS:
            raise ValueError(f"form is one of {sorted(FORMS)}")
        self.url, self.model, self.form, self.embed_url, self.embed_model, self.post = url, model, form, embed_url, embed_model or model, post
        self.key, self.headers = key, dict(headers or {}) | (FORMS[form][2](key) if key else {})

    def _ask(self, url: str, body: dict) -> dict:
        try:
            return self.post(url, self.headers, body)
        except Exception as e:
            # The key may stand in an error's text.
            raise RuntimeError(redact(f"{type(e).__name__}: {e}", self.key) if self.key else f"{type(e).__name__}: {e}") from None

    def complete(self, system: str, prompt: str, max_tokens: int = 2000) -> str:
        make, text, _ = FORMS[self.form]
        reply = self._ask(self.url, make(self.model, system, prompt, max_tokens))
        try:
            return text(reply) or ""
        except (KeyError, IndexError, TypeError):
            raise RuntimeError(f"the model's reply has another form than {self.form}") from None

    def embed(self, texts: list[str]) -> list[list[float]]:
        if not self.embed_url:
            raise NotImplementedError("this provider has no embeddings")
        found = self._ask(self.embed_url, {"model": self.embed_model, "input": list(texts)})["data"]
        return [x["embedding"] for x in sorted(found, key=lambda x: x.get("index", 0))]


class LocalProvider:
    """A model of the transformers library in this process, loaded at its first use."""

    def __init__(self, name: str):
        self.name, self._pipe = name, None

    def complete(self, system: str, prompt: str, max_tokens: int = 2000) -> str:
        if self._pipe is None:
            from transformers import pipeline

            self._pipe = pipeline("text-generation", model=self.name)
        said = self._pipe([{"role": "system", "content": system}, {"role": "user", "content": prompt}], max_new_tokens=max_tokens)
        return said[0]["generated_text"][-1]["content"]


#: Settings of the environment by name of provider: what has to be there, in the order in which they are tried.
SETTINGS = {"http": ("LODESEEK_MODEL_URL", "LODESEEK_MODEL"), "local": ("LODESEEK_LOCAL_MODEL",)}


def available_providers(env: Mapping[str, str] | None = None) -> list[str]:
    """Names of the providers whose settings are there."""
    env = os.environ if env is None else env
    return [n for n, needed in SETTINGS.items() if all(env.get(x) for x in needed)]


def auto_provider(env: Mapping[str, str] | None = None):
    """The first provider that the environment has the settings of, or None.

    LODESEEK_MODEL_URL and LODESEEK_MODEL name a model over HTTP; LODESEEK_MODEL_FORM (chat if unset),
    LODESEEK_MODEL_KEY and LODESEEK_EMBED_URL go with them. LODESEEK_LOCAL_MODEL names one to be loaded here.
    """
    env = os.environ if env is None else env
    for name in available_providers(env):
        if name == "http":
            return HttpProvider(env["LODESEEK_MODEL_URL"], env["LODESEEK_MODEL"], env.get("LODESEEK_MODEL_FORM") or "chat", env.get("LODESEEK_MODEL_KEY"), embed_url=env.get("LODESEEK_EMBED_URL"))
        return LocalProvider(env["LODESEEK_LOCAL_MODEL"])
    return None
