"""From a question to rows with a model that the caller supplies (M1, M5, M6)."""

from collections.abc import Callable
from typing import Protocol

from lodeseek.plans.guard import MAX_QUESTION, UnsafeSQL, check_read_only, strip_fences

ATTEMPTS = 3
TOKENS = 2000
REFUSAL = "INSUFFICIENT"


class Provider(Protocol):
    def complete(self, system: str, prompt: str, max_tokens: int) -> str: ...


class CallableProvider:
    """A provider from one callable (M1)."""

    def __init__(self, call: Callable[[str, str, int], str], embed: Callable[[list[str]], list[list[float]]] | None = None):
        self._call, self._embed = call, embed

    def complete(self, system: str, prompt: str, max_tokens: int = TOKENS) -> str:
        return self._call(system, prompt, max_tokens)

    def embed(self, texts: list[str]) -> list[list[float]]:
        if self._embed is None:
            raise NotImplementedError("this provider has no embeddings")
        return self._embed(texts)


def sql_prompt(question: str, fragment: str, dialect: str = "Spark SQL") -> tuple[str, str]:
    """System text and prompt for one SELECT, for use with or without a provider."""
    system = f"You write one read-only {dialect} SELECT. Use only the tables and columns given. If they do not suffice, reply {REFUSAL}. Reply with SQL only."
    return system, f"{fragment}\n\nQuestion: {question[:MAX_QUESTION]}"


def generate_sql(spark, provider: Provider, question: str, fragment: str, dialect: str = "Spark SQL", max_tokens: int = TOKENS, attempts: int = ATTEMPTS) -> str:
    """One checked SELECT (M6). A refusal is asked again, up to attempts times; anything unsafe raises at once."""
    system, prompt = sql_prompt(question, fragment, dialect)
    for _ in range(max(1, attempts)):
        text = strip_fences(provider.complete(system, prompt, max_tokens))
        if not text.upper().startswith(REFUSAL):
            return check_read_only(spark, text)
    raise UnsafeSQL("the tables do not suffice for this question")
