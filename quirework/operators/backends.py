"""Adapters of translation and language-model services. They run in the tasks and need a network; requests and replies
are plain functions, so that they can be tested without one."""

from __future__ import annotations

import json
import re
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .translate import ConfigurationError, LengthMismatch, MockBackend, QuotaError, RateLimited, TranslationError, batches

# Names of languages in prompts.
LANGUAGES = {
    "en": "English", "ja": "Japanese", "zh": "Chinese", "ko": "Korean", "de": "German", "fr": "French", "es": "Spanish", "it": "Italian", "pt": "Portuguese", "ru": "Russian",
    "ar": "Arabic", "hi": "Hindi", "th": "Thai", "vi": "Vietnamese", "id": "Indonesian", "ms": "Malay", "nl": "Dutch", "pl": "Polish", "tr": "Turkish", "uk": "Ukrainian",
    "auto": "the source language",
}
# Tokens of context by the beginning of a model's name; the longest that fits decides.
CONTEXT = {
    "gpt-5": 400_000, "gpt-5-chat": 128_000, "gpt-5.1": 400_000, "gpt-5.1-chat": 128_000, "gpt-5.2": 400_000, "gpt-5.2-chat": 128_000, "gpt-4.1": 1_000_000, "gpt-4o": 128_000, "o3": 200_000, "o1": 200_000,
    "gpt-4": 8_000, "gpt-4-32k": 32_000, "gpt-4-turbo": 128_000, "gpt-4-1106-preview": 128_000, "gpt-4-0125-preview": 128_000, "gpt-4-vision-preview": 128_000, "gpt-3.5-turbo": 16_000,
}
DEFAULT_CONTEXT = 8_000
#: A text may take a quarter of the context, a batch of texts a half.
TEXT_SHARE, BATCH_SHARE = 4, 2
Post = Callable[[str, bytes, dict[str, str]], tuple[int, str]]


def language(code: str) -> str:
    return LANGUAGES.get(code.lower(), code)


def context_of(model: str) -> int:
    return next((CONTEXT[p] for p in sorted(CONTEXT, key=len, reverse=True) if model.startswith(p)), DEFAULT_CONTEXT)


def post(url: str, body: bytes, headers: dict[str, str]) -> tuple[int, str]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=60) as r:
            return r.status, r.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode(errors="replace")
    except OSError as e:
        raise TranslationError(str(e)) from e


def check_status(status: int) -> None:
    if status in (401, 403):
        raise ConfigurationError("the key was refused")
    if status == 429:
        raise RateLimited("too many requests")
    if status == 456:
        raise QuotaError("the quota is used up")
    if status != 200:
        raise TranslationError(f"status {status}")


def byte_chunks(texts: list[str], count: int = 50, size: int = 128 << 10) -> list[list[str]]:
    return list(batches(texts, count, size, lambda t: len(t.encode())))


@dataclass
class FormBackend:
    """A service that takes form fields: several texts, a key and languages; ``auto`` leaves the source out."""

    url: str
    key: str
    name: str = "deepl"
    max_text_length: int | None = 30_000
    send: Post = post

    def fields(self, texts: list[str], source: str, target: str) -> list[tuple[str, str]]:
        out = [*(("text", t) for t in texts), ("auth_key", self.key), ("target_lang", target.upper())]
        return out if source.lower() == "auto" else [*out, ("source_lang", source.upper())]

    def translate_batch(self, texts: list[str], source: str, target: str) -> list[str]:
        out: list[str] = []
        for chunk in byte_chunks(texts):
            status, reply = self.send(self.url, urllib.parse.urlencode(self.fields(chunk, source, target)).encode(), {})
            check_status(status)
            got = [t["text"] for t in json.loads(reply)["translations"]]
            if len(got) != len(chunk):
                raise LengthMismatch(f"{len(got)} texts for {len(chunk)}")
            out += got
        return out


def restore_order(items: list[dict], n: int) -> list[str]:
    """Indexed translations in order; a missing or repeated index is a mismatch."""
    ordered = sorted(items, key=lambda x: x["index"])
    if [x["index"] for x in ordered] != list(range(n)):
        raise LengthMismatch(f"{len(items)} indexed texts for {n}")
    return [x["translation"] for x in ordered]


def prompt(texts: list[str], source: str, target: str) -> str:
    items = json.dumps([{"index": i, "text": t} for i, t in enumerate(texts)], ensure_ascii=False)
    return f"Translate {len(texts)} texts from {language(source)} to {language(target)}. Return one translation for each index.\n{items}"


#: What a reply must look like.
REPLY = {
    "type": "object", "required": ["translations"], "additionalProperties": False,
    "properties": {"translations": {"type": "array", "items": {
        "type": "object", "required": ["index", "translation"], "additionalProperties": False,
        "properties": {"index": {"type": "integer"}, "translation": {"type": "string"}},
    }}},
}


@dataclass
class ChatBackend:
    """A chat service that returns {"translations": [{"index", "translation"}]}. Texts are asked for in batches of half
    the model's context, and a text of more than a quarter of it is to be split before."""

    url: str
    key: str
    model: str
    name: str = "openai"
    max_text_length: int | None = None
    send: Post = post
    tokens: Callable[[str], int] = len

    def __post_init__(self) -> None:
        if self.max_text_length is None:
            self.max_text_length = context_of(self.model) // TEXT_SHARE

    def ask(self, content: str, schema: dict | None = None) -> str:
        body: dict = {"model": self.model, "messages": [{"role": "user", "content": content}]}
        if schema:
            body["response_format"] = {"type": "json_schema", "json_schema": {"name": "reply", "strict": True, "schema": schema}}
        status, reply = self.send(self.url, json.dumps(body).encode(), {"Authorization": f"Bearer {self.key}", "Content-Type": "application/json"})
        check_status(status)
        return json.loads(reply)["choices"][0]["message"]["content"]

    def translate_batch(self, texts: list[str], source: str, target: str) -> list[str]:
        out: list[str] = []
        for batch in batches(texts, len(texts) or 1, context_of(self.model) // BATCH_SHARE, self.tokens):
            found = extract_json(self.ask(prompt(batch, source, target), REPLY))
            if found is None:
                raise TranslationError("empty reply")
            out += restore_order(found["translations"], len(batch))
        return out


@dataclass
class QueryBackend:
    """A service asked for one text at a time by parameters; its reply is nested arrays, of which the first has the
    translated sentences, each first in an array of its own."""

    url: str
    name: str = "google"
    max_text_length: int | None = 5000
    send: Post = post
    #: One text a request, so five requests in flight are five texts.
    concurrency: int = 5
    batch_size: int = 1

    def translate_batch(self, texts: list[str], source: str, target: str) -> list[str]:
        out = []
        for t in texts:
            fields = {"client": "gtx", "dt": "t", "sl": source, "tl": target, "q": t}
            status, reply = self.send(f"{self.url}?{urllib.parse.urlencode(fields)}", b"", {})
            check_status(status)
            out.append(translated_sentences(reply))
        return out


def translated_sentences(reply: str) -> str:
    """A reply that is no such JSON is the translation itself."""
    try:
        found = json.loads(reply)
        return "".join(sentence[0] for sentence in found[0] if sentence[0]) if isinstance(found, list) else reply
    except (ValueError, TypeError, IndexError, KeyError):
        return reply


def backend(name: str, key: str = "", model: str = "gpt-4o-mini", url: str | None = None):
    """The adapter called ``name``; services that need a key refuse to go without."""
    if name == "mock":
        return MockBackend()
    if name == "google":
        return QueryBackend(url or "https://translate.googleapis.com/translate_a/single")
    if name not in ("deepl", "openai"):
        raise ConfigurationError(f"no backend is called {name}")
    if not key:
        raise ConfigurationError(f"{name} needs a key")
    if name == "deepl":
        return FormBackend(url or f"https://api{'-free' if key.endswith(':fx') else ''}.deepl.com/v2/translate", key)
    return ChatBackend(url or "https://api.openai.com/v1/chat/completions", key, model)


FENCED = r"(?s)```(?:json)?\s*(.*?)\s*(?:```|$)"
WIDELY_FENCED = r"(?s)```(?:json)?\s*(.*)\s*```"


def reply_json(text: Column) -> Column:
    """The JSON in a reply as text, from its first fenced block if it has one; null where it is none."""
    inner = F.regexp_extract(text, FENCED, 1)
    body = F.trim(F.when(text.contains("```"), inner).otherwise(text))
    return F.to_json(F.try_parse_json(F.nullif(body, F.lit(""))))


def extract_json(text: str):
    """:func:`reply_json` of one reply, parsed; None where it is none. Fences in the JSON's own texts don't end it."""
    for body in (text, *(m[1] for x in (FENCED, WIDELY_FENCED) if (m := re.search(x, text)))):
        try:
            return json.loads(body)
        except ValueError:
            continue
    return None


def summary_text(markdown: Column, most: int = 500_000) -> Column:
    """Markdown without images, cut to what a model is sent."""
    return F.substring(F.regexp_replace(markdown, r"!\[.*?\]\(.*?\)", ""), 1, most)


def summary_prompt(target: str | None = None) -> str:
    """What a model is asked before a document's text."""
    where = f" in {language(target)}" if target else ""
    return f"Sum up the following paper{where} in three to five sentences: what it is after, how it goes about it, and what it finds.\n\n"


METADATA_PROMPT = "The text below is a paper's first page. Reply with a JSON object of the keys title, abstract and organization (the authors' institutions), null where the page doesn't say.\n\n"


def generated(docs: DataFrame, ask: Callable[[str], str], target: str | None = None) -> DataFrame:
    """(doc_id, title, abstract, organization, summary): what a language model says of ``markdown`` (the summary) and of
    ``first_page`` (the rest). ``ask`` runs in the tasks. A null text isn't sent; what fails is null, and so is what a
    reply leaves out; a refused key or a used-up quota is an error. An empty table gives no rows. A task that is run again asks again: write the
    result before using it twice."""
    keys = ("title", "abstract", "organization")

    def attempt(head: str, text: str | None) -> str | None:
        try:
            return ask(head + text) if text else None
        except (ConfigurationError, QuotaError):
            raise
        except Exception:
            return None

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            said = [attempt(summary_prompt(target), x) for x in b.column(1).to_pylist()]
            found = [extract_json(x) if x else None for x in (attempt(METADATA_PROMPT, x) for x in b.column(2).to_pylist())]
            fields = [[str(v) if isinstance(x, dict) and (v := x.get(k)) is not None else None for x in found] for k in keys]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(f, pa.string()) for f in fields], pa.array(said, pa.string())], names=["doc_id", *keys, "summary"])

    rows = docs.select("doc_id", summary_text(F.col("markdown")).alias("markdown"), "first_page")
    return rows.mapInArrow(run, T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("title string, abstract string, organization string, summary string")]))


def summary_content(markdown: str, most: int = 500_000) -> str:
    return re.sub(r"!\[.*?\]\(.*?\)", "", markdown)[:most]
