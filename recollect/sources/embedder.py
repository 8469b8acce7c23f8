"""Vectors for texts, from any function of a list of texts."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.functions.arrow import task_mapper

#: Characters of a text that are embedded, and texts of a call.
CHARS, BATCH = 2000, 32


def embed(docs: DataFrame, make: Callable[[], Callable[[list[str]], list[list[float]]]], size: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, vector): one vector per text, zeros where the embedder fails.

    ``make`` runs once per task and returns the embedder.
    """

    def start():
        model = make()

        def f(keys: list, texts: list):
            out: list[list[float]] = []
            for i in range(0, len(texts), BATCH):
                part = [(t or "")[:CHARS] for t in texts[i : i + BATCH]]
                try:
                    out += [[float(x) for x in v] for v in model(part)]
                except Exception:  # noqa: BLE001 - a failing batch gets zero vectors, the others their own
                    out += [[0.0] * size for _ in part]
            return keys, out

        return f

    kind = docs.schema[key].dataType.simpleString()
    return task_mapper(docs, [F.col(key), F.col(text)], f"{key} {kind}, vector array<float>", start)


def http_embedder(url: str, model: str, token: str = "", timeout: float = 30.0) -> Callable:
    """An embedder that posts to a service with the usual ``/embeddings`` interface."""

    def make():
        def call(texts: list[str]) -> list[list[float]]:
            body = json.dumps({"model": model, "input": texts}).encode()
            request = urllib.request.Request(url, body, {"Content-Type": "application/json", **({"Authorization": f"Bearer {token}"} if token else {})})
            with urllib.request.urlopen(request, timeout=timeout) as reply:
                data = json.load(reply)["data"]
            return [x["embedding"] for x in sorted(data, key=lambda x: x.get("index", 0))]

        return call

    return make
