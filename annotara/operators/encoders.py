"""Encoders and retrievers as plug-ins, and indexes kept as Parquet.

Model encoders load their libraries when first used, once per worker; without them a hashing encoder
stands in, which needs no files and gives the same vectors everywhere.
"""

from __future__ import annotations

import importlib
import re
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import retrieval


class Encoder(Protocol):
    name: str
    similarity: str  # "cosine" or "dot"

    def documents(self, texts: list[str]) -> np.ndarray: ...

    def queries(self, texts: list[str]) -> np.ndarray: ...


class Hashing:
    """Signed hashed counts of words, dampened by log1p."""

    similarity = "cosine"

    def __init__(self, width: int = 256):
        self.name, self.width = f"hashing-{width}", width

    def documents(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width))
        for row, t in zip(out, texts, strict=True):
            for w in re.findall("[a-z0-9]+", (t or "").lower()):
                h = zlib.crc32(w.encode())
                row[h % self.width] += 1.0 if h >> 31 else -1.0
        return np.sign(out) * np.log1p(np.abs(out))

    queries = documents


class SentenceModel:
    """A dense model of the sentence_transformers library; queries may carry an instruction."""

    similarity = "cosine"

    def __init__(self, name: str, path: str, instruction: str = ""):
        self.name, self.path, self.instruction, self._model = name, path, instruction, None

    def _encode(self, texts: list[str]) -> np.ndarray:
        if self._model is None:
            self._model = needed("sentence_transformers", self.name).SentenceTransformer(self.path)
        return np.asarray(self._model.encode(texts), np.float64)

    def documents(self, texts: list[str]) -> np.ndarray:
        return self._encode(texts)

    def queries(self, texts: list[str]) -> np.ndarray:
        return self._encode([self.instruction + t for t in texts])


def sparse_weights(logits: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """max over a text's tokens of log(1 + relu(logit)): logits (texts, tokens, vocabulary), mask (texts, tokens)."""
    return (np.log1p(np.maximum(logits, 0.0)) * mask[:, :, None]).max(1)


def mean_pooled(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    return (states * mask[:, :, None]).sum(1) / np.maximum(mask.sum(1, keepdims=True), 1e-9)


class TokenModel:
    """A model of the transformers library: mean-pooled states (dense), or max-pooled weights of its vocabulary
    (sparse)."""

    def __init__(self, name: str, path: str, sparse: bool = False, batch: int = 16):
        self.name, self.path, self.sparse, self.batch, self._model = name, path, sparse, batch, None
        self.similarity = "dot" if sparse else "cosine"

    def documents(self, texts: list[str]) -> np.ndarray:
        torch, transformers = needed("torch", self.name), needed("transformers", self.name)
        if self._model is None:
            kind = transformers.AutoModelForMaskedLM if self.sparse else transformers.AutoModel
            self._model = transformers.AutoTokenizer.from_pretrained(self.path), kind.from_pretrained(self.path).eval()
        tokenizer, model = self._model
        out = []
        with torch.no_grad():
            for i in range(0, len(texts), self.batch):
                own = tokenizer(texts[i : i + self.batch], padding=True, truncation=True, return_tensors="pt")
                mask = own["attention_mask"].numpy().astype(np.float64)
                got = model(**own)
                out.append(sparse_weights(got.logits.numpy(), mask) if self.sparse else mean_pooled(got.last_hidden_state.numpy(), mask))
        return np.concatenate(out) if out else np.zeros((0, 1))

    queries = documents


def needed(module: str, model: str):
    """A library that is loaded on first use."""
    try:
        return importlib.import_module(module)
    except ImportError as e:
        raise RuntimeError(f"the encoder {model} needs the library {module}, which isn't installed; hashing needs none") from e


#: What dense models want before a query.
PASSAGES = "Represent this sentence for searching relevant passages: "
INSTRUCTED = "Instruct: Given a web search query, retrieve relevant passages that answer the query\nQuery:"

#: Encoders by name; model encoders take the folder or name of their files, and load them on first use.
ENCODERS: dict[str, Callable[..., Encoder]] = {
    "hashing": Hashing,
    "bge-s": lambda path="BAAI/bge-small-en-v1.5": SentenceModel("bge-s", path, PASSAGES),
    "bge-l": lambda path="BAAI/bge-large-en-v1.5": SentenceModel("bge-l", path, PASSAGES),
    "legal-bert": lambda path="nlpaueb/legal-bert-base-uncased": TokenModel("legal-bert", path),
    "qwen3-0.6b": lambda path="Qwen/Qwen3-Embedding-0.6B": SentenceModel("qwen3-0.6b", path, INSTRUCTED),
    "qwen3-8b": lambda path="Qwen/Qwen3-Embedding-8B": SentenceModel("qwen3-8b", path, INSTRUCTED),
    "splade": lambda path="naver/splade-v3": TokenModel("splade", path, sparse=True),
}


def encoder(name: str, **options) -> Encoder:
    if name not in ENCODERS:
        raise ValueError(f"no encoder named {name}; there are {', '.join(sorted(ENCODERS))}")
    return ENCODERS[name](**options)


def encoded(rows: DataFrame, make: Callable[[], Encoder], key: str, text: str, role: str = "documents", out: str = "embedding") -> DataFrame:
    """key and the vector of text; the encoder is made once per task."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for b in batches:
            vectors = getattr(model, role)([t or "" for t in b.column(1).to_pylist()]) if b.num_rows else np.zeros((0, 1))
            flat = pa.array(np.ascontiguousarray(vectors, np.float32).ravel())
            at = pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * vectors.shape[1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(at, flat)], [key, out])

    return rows.select(key, text).mapInArrow(run, f"`{key}` {kind}, `{out}` array<float>")


VERSION = 1


def save_index(pool: DataFrame, path: str, name: str, make: Callable[[], Encoder] | None = None) -> None:
    """Candidates with their postings, and vectors where an encoder is given, under one versioned path."""
    root = f"{path}/v{VERSION}"
    pool.write.mode("overwrite").parquet(f"{root}/candidates")
    saved = pool.sparkSession.read.parquet(f"{root}/candidates")
    retrieval.postings(saved).write.mode("overwrite").parquet(f"{root}/postings")
    if make:
        encoded(saved, make, "row_idx", "text").write.mode("overwrite").parquet(f"{root}/vectors")
    config = pool.sparkSession.createDataFrame([(name, VERSION, saved.count())], "retriever string, version int, size long")
    config.write.mode("overwrite").parquet(f"{root}/config")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """candidates and postings; an error if their number isn't the one that was saved."""
    root = f"{path}/v{VERSION}"
    pool, config = spark.read.parquet(f"{root}/candidates"), spark.read.parquet(f"{root}/config").first()
    if (n := pool.count()) != config["size"]:
        raise ValueError(f"the index was made of {config['size']} candidates, there are {n}")
    return pool, spark.read.parquet(f"{root}/postings")


def by_vectors(name: str) -> Callable[..., DataFrame]:
    """A retriever with the arguments of bm25_topk that encodes both sides."""

    def search(pool: DataFrame, queries: DataFrame, k: int, qkey: str, key: str = "row_idx", text: str = "text", qtext: str = "qtext", **options) -> DataFrame:
        model = encoder(name, **options)
        v = encoded(pool, lambda: model, key, text).withColumnRenamed(key, "vec_id")
        q = encoded(queries, lambda: model, qkey, qtext, "queries").withColumnRenamed(qkey, "vec_id")
        found = retrieval.vector_topk(v, q, k, cosine=model.similarity == "cosine")
        return found.select(F.col("query_id").alias(qkey), F.col("vec_id").alias(key), "score", "rank")

    return search


RETRIEVERS: dict[str, Callable[..., DataFrame]] = {
    "bm25": retrieval.bm25_topk,
    "bm25-by-type": retrieval.bm25_topk_by_type,
    "vector": retrieval.vector_topk,
    **{name: by_vectors(name) for name in ENCODERS},
}


def retriever(name: str) -> Callable[..., DataFrame]:
    if name not in RETRIEVERS:
        raise ValueError(f"no retriever named {name}; there are {', '.join(sorted(RETRIEVERS))}")
    return RETRIEVERS[name]


def texts_of(pool: DataFrame) -> DataFrame:
    """row_idx and the text by which a candidate is found."""
    return pool.select("row_idx", F.concat_ws(" | ", "docType", "docTitle", "metadata_text").alias("text"))
