"""Model connectors over HTTP for columns: one client per partition, retries, no plain text beyond this machine.

They are optional; the default provider and embedder need no network.
"""

from __future__ import annotations

import ipaddress
import json
import math
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame

TRIES, LONGEST_WAIT = 4, 8.0


def guard(url: str) -> str:
    """The address, if it is safe to send texts to: https, or http to this very machine."""
    parts = urlsplit(url)
    try:
        local = parts.hostname == "localhost" or ipaddress.ip_address(parts.hostname or "").is_loopback
    except ValueError:
        local = False
    if parts.scheme != "https" and not (parts.scheme == "http" and local):
        raise ValueError(f"refusing to send texts to {parts.scheme}://{parts.hostname} in plain text")
    return url


def post(url: str, body: dict, key: str = "", wait: float = 1.0) -> dict:
    """POST JSON; server errors, rate limits and broken connections are tried again after a growing wait."""
    request = urllib.request.Request(guard(url), json.dumps(body).encode(), {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {}))
    for n in range(TRIES):
        try:
            with urllib.request.urlopen(request, timeout=60) as answer:
                return json.loads(answer.read())
        except urllib.error.HTTPError as problem:
            if problem.code != 429 and problem.code < 500 or n + 1 == TRIES:
                raise
        except OSError:
            if n + 1 == TRIES:
                raise
        time.sleep(wait * min(2.0**n, LONGEST_WAIT))
    raise AssertionError


def complete(rows: DataFrame, url: str, model: str, key: str = "", wait: float = 1.0) -> DataFrame:
    """``id, system, user`` to ``id, answer, error``: a failing call is a row with an error, never a failing job."""
    guard(url)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples():
                messages = [{"role": "system", "content": row.system}, {"role": "user", "content": row.user}]
                try:
                    found = post(f"{url}/chat/completions", {"model": model, "messages": messages, "response_format": {"type": "json_object"}}, key, wait)
                    out.append((row.id, found["choices"][0]["message"]["content"], None))
                except Exception as problem:  # noqa: BLE001
                    out.append((row.id, None, f"{type(problem).__name__}: {problem}"[:200]))
            yield pd.DataFrame(out, columns=["id", "answer", "error"]).astype({"answer": object, "error": object})

    return rows.select("id", "system", "user").mapInPandas(run, "id long, answer string, error string")


def embed(rows: DataFrame, url: str, model: str, dim: int, key: str = "", wait: float = 1.0) -> DataFrame:
    """``id, text`` to ``id, embedding`` of length 1; a vector of another width is an error."""
    guard(url)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = {"model": model, "dimensions": dim}
        for frame in frames:
            texts = frame["text"].fillna("").tolist()
            try:
                found = post(f"{url}/embeddings", {**asked, "input": texts}, key, wait)
            except urllib.error.HTTPError as problem:
                if problem.code != 400 or "dimensions" not in asked:
                    raise
                del asked["dimensions"]  # a model that doesn't know the parameter
                found = post(f"{url}/embeddings", {**asked, "input": texts}, key, wait)
            vectors = [x["embedding"] for x in sorted(found["data"], key=lambda x: x["index"])]
            if any(len(v) != dim for v in vectors):
                raise ValueError(f"the model's vectors don't have {dim} numbers")
            yield pd.DataFrame({"id": frame["id"], "embedding": [[x / (math.hypot(*v) or 1.0) for x in v] for v in vectors]})

    return rows.select("id", "text").mapInPandas(run, "id long, embedding array<float>")
