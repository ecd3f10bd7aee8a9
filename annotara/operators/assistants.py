"""Generation by outside models: the protocol, a deterministic stand-in, and the drivers around them."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class Assistant(Protocol):
    """Answers chat messages; made once per worker by the function that a driver gets."""

    def generate(self, messages: list[dict[str, str]], **options) -> str: ...


class Echo:
    """Answers with the last message, changed by a function: for tests and dry runs."""

    def __init__(self, change: Callable[[str], str] = str):
        self.change = change

    def generate(self, messages: list[dict[str, str]], **options) -> str:
        return self.change(messages[-1]["content"])


class Endpoint:
    """A chat endpoint of the common HTTP protocol (POST {base}/chat/completions)."""

    def __init__(self, model: str, base: str, key: str = "", temperature: float = 1.0, seconds: float = 120.0, tries: int = 3):
        self.model, self.base, self.key, self.temperature, self.seconds, self.tries = model, base.rstrip("/"), key, temperature, seconds, tries

    def generate(self, messages: list[dict[str, str]], **options) -> str:
        body = json.dumps({"model": self.model, "messages": messages, "temperature": self.temperature} | options).encode()
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        for left in reversed(range(self.tries)):
            try:
                with urllib.request.urlopen(urllib.request.Request(f"{self.base}/chat/completions", body, head), timeout=self.seconds) as answer:
                    return json.load(answer)["choices"][0]["message"]["content"]
            except (urllib.error.URLError, TimeoutError):
                if not left:
                    raise
        return ""


class Weights:
    """A chat model whose weights are at hand, by the transformers library, loaded on first use."""

    def __init__(self, path: str, system_role: bool = True, temperature: float = 1.0, most: int = 2048, channels: bool = False, **load):
        self.path, self.system_role, self.temperature, self.most, self.channels, self.load, self._made = path, system_role, temperature, most, channels, load, None

    def generate(self, messages: list[dict[str, str]], **options) -> str:
        if self._made is None:
            try:
                import transformers
            except ImportError as e:
                raise RuntimeError(f"{self.path} needs the library transformers, which isn't installed; echo needs none") from e
            self._made = transformers.pipeline("text-generation", model=self.path, **self.load)
        if not self.system_role and messages[0]["role"] == "system":
            system, first, *rest = messages
            messages = [first | {"content": f"{system['content']}\n\n{first['content']}"}, *rest]
        got = self._made(messages, max_new_tokens=self.most, do_sample=self.temperature > 0, temperature=self.temperature or None, **options)
        return got[0]["generated_text"][-1]["content"]


#: Assistants by name; weights and endpoints are loaded or called on first use only.
REGISTRY: dict[str, Callable[..., Assistant]] = {
    "echo": Echo,
    "endpoint": Endpoint,
    "qwen2.5-7b": lambda path="Qwen/Qwen2.5-7B-Instruct", **o: Weights(path, **o),
    "qwen2.5-32b": lambda path="Qwen/Qwen2.5-32B-Instruct", **o: Weights(path, **o),
    "saullm-7b": lambda path="Equall/Saul-7B-Instruct-v1", **o: Weights(path, system_role=False, **o),
    "saullm-54b": lambda path="Equall/SaulLM-54B-Instruct", **o: Weights(path, system_role=False, **o),
    "phi-4": lambda path="microsoft/phi-4", **o: Weights(path, **o),
    "mistral-7b": lambda path="mistralai/Mistral-7B-Instruct-v0.1", **o: Weights(path, system_role=False, **o),
}


def assistant(name: str, **options) -> Assistant:
    if name not in REGISTRY:
        raise ValueError(f"no assistant named {name}; there are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name](**options)


#: What each label stands for, in the words of this package.
DEFINITIONS = {
    "legislation": "a statute, regulation, constitution or other enacted text",
    "decision": "a judgment or order of a court or tribunal",
    "secondary sources": "a book, article, report or other writing about the law",
    "title": "the name by which the referenced text is called",
    "citation": "the place where it is published: volume, reporter, page, neutral citation or chapter",
    "source": "the journal, collection or publisher that a writing appeared in",
    "authors": "the people or bodies that wrote it",
    "fragment": "the part that is referred to: a section, article, paragraph or page",
}


def definitions(labels: list[str], known: dict[str, str] | None = None) -> str:
    known = DEFINITIONS if known is None else known
    if missing := [x for x in labels if x not in known]:
        raise ValueError(f"no definition of {', '.join(missing)}")
    return "\n".join(f"- <{x}>: {known[x]}" for x in labels)


def annotation_prompt(labels: list[str], parents: list[str] | None = None, examples: list[tuple[str, str]] = (), known: dict[str, str] | None = None) -> str:
    """A system prompt that asks for labels in the simple syntax, nothing else changed."""
    where = f" Only text within <{'>, <'.join(parents)}> gets them." if parents else ""
    shown = "".join(f"\n\nText:\n{a}\nAnswer:\n{b}" for a, b in examples)
    return f"Copy the text and put tags around every reference to a legal source.{where} Change no character of the text.\nTags:\n{definitions(labels, known)}{shown}"


def linking_prompt(examples: list[tuple[str, str]] = ()) -> str:
    """A system prompt that asks which known source a mention refers to."""
    shown = "".join(f"\n\nInput:\n{a}\nAnswer:\n{b}" for a, b in examples)
    return 'The input holds a mention, the text before it and the profiles of the sources met so far, as JSON. Answer with docid="..." of the profile that the mention refers to, or with a new docid that names the source.' + shown


def messages(system: str, examples: list[tuple[str, str]], text: str, system_role: bool = True) -> list[dict[str, str]]:
    """Chat messages; without a system role its text goes before the first user message."""
    turns = [m for a, b in examples for m in ({"role": "user", "content": a}, {"role": "assistant", "content": b})] + [{"role": "user", "content": text}]
    if system_role:
        return [{"role": "system", "content": system}, *turns]
    return [turns[0] | {"content": f"{system}\n\n{turns[0]['content']}"}, *turns[1:]]


def generated(chunks: DataFrame, make: Callable[[], Assistant], system: str, text: str = "text", out: str = "output") -> DataFrame:
    """chunks with the model's answer to each; the model is made once per task."""
    from pyspark.sql.types import StringType, StructType

    schema = StructType([*chunks.schema.fields]).add(out, StringType())

    def run(batches):
        model = make()
        many = getattr(model, "generate_all", None)  # models that take a batch at once
        for pdf in batches:
            asked = [messages(system, [], t) for t in pdf[text]]
            pdf[out] = many(asked) if many else [model.generate(m) for m in asked]
            yield pdf

    return chunks.mapInPandas(run, schema)


def resolved_in_order(mentions: DataFrame, predict: Callable[[dict, list[dict]], str | None], most: int | None = None, passes: int | None = None) -> DataFrame:
    """doc_id, mention_id, docid, pass: each document's mentions in order, every prediction seeing the
    profiles before it.  With a bound on the registry, mentions of entities that find it full wait for the
    next pass, which begins with an empty one; a pass that resolves nothing is the last."""
    doc, mention = (mentions.schema[c].dataType.simpleString() for c in ("doc_id", "mention_id"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        waiting = pdf.sort_values("mention_id").to_dict("records")
        out, n = [], 0
        while waiting and (passes is None or n < passes):
            registry: list[dict] = []
            later, done = [], 0
            for m in waiting:
                docid = predict(m, registry)
                known = docid is not None and any(p["docid"] == docid for p in registry)
                if docid is not None and not known and most is not None and len(registry) >= most:
                    later.append(m)
                    continue
                if docid is not None and not known:
                    registry.append({"docid": docid, "first": m["mention_id"]})
                out.append((m["doc_id"], m["mention_id"], docid, n))
                done += 1
            waiting, n = later, n + 1
            if not done:
                break
        out += [(m["doc_id"], m["mention_id"], None, None) for m in waiting]
        return pd.DataFrame(out, columns=["doc_id", "mention_id", "docid", "pass"]).astype({"pass": "Int64"})

    return mentions.groupBy("doc_id").applyInPandas(fold, f"doc_id {doc}, mention_id {mention}, docid string, pass long")
