"""Tagging by a language model: prompts, answers, retries. The model is a function from prompt to text."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .maintenance import discovery_sample, merge_tags, untagged

Model = Callable[[str], str]
ATTEMPTS, FIRST_WAIT = 5, 1.0


class ModelError(RuntimeError):
    """The model's service failed; worth another attempt."""


def ask(model: Model, prompt: str, attempts: int = ATTEMPTS, wait: Callable[[float], None] = time.sleep) -> str:
    """The model's answer; service errors are tried again after 1, 2, 4, ... seconds."""
    for k in range(attempts):
        try:
            return model(prompt)
        except ModelError:
            if k + 1 == attempts:
                raise
            wait(FIRST_WAIT * 2**k)
    raise ModelError("no attempts")


def json_array(answer: str) -> list:
    """The JSON array in an answer; ValueError if there is none."""
    found = re.search(r"\[.*\]", answer, re.DOTALL)
    if not found:
        raise ValueError("no JSON array in the answer")
    return json.loads(found[0])


def discover_projects(messages: DataFrame, registry: DataFrame, model: Model, reset: bool = False, seed: int = 0) -> DataFrame:
    """The registry with the projects that a model finds in a sample of 500 messages: 30 subjects and 10
    beginnings of texts. New ones replace those of the same name; an answer that can't be read raises and leaves the registry."""
    sample = discovery_sample(messages, 500, seed).select("subject", F.substring("body_text", 1, 500).alias("text")).limit(30).collect()
    prompt = "Name the projects in these messages as a JSON array of {name, aliases, summary}.\n" + "\n".join(r.subject or "" for r in sample) + "\n" + "\n---\n".join(r.text or "" for r in sample[:10])
    found = [(p["name"], json.dumps(p.get("aliases") or []), p.get("summary"), p.get("created_at")) for p in json_array(ask(model, prompt)) if p.get("name")]
    new = messages.sparkSession.createDataFrame(found, registry.schema)
    return new if reset else registry.join(new.select("name"), "name", "left_anti").unionByName(new)


def tag_batch(messages: DataFrame, model: Model, after: tuple[str, str] | None = None, size: int = 100) -> tuple[DataFrame, tuple[str, str] | None]:
    """messages with the next batch of untagged ones tagged, and the key to go on from (None: nothing was left).
    The model is called where the rows are, once a message."""
    batch = untagged(messages, after, size).select("id", "ts_raw", "subject", F.substring(F.coalesce("body_text", F.lit("")), 1, 1000).alias("text"))
    last = batch.orderBy(F.desc("ts_raw"), F.desc("id")).select("ts_raw", "id").first()
    if last is None:
        return messages, None

    def run(batches):
        for pdf in batches:
            out = []
            for i, subject, text in zip(pdf["id"], pdf["subject"], pdf["text"]):
                answer = json_array(ask(model, f"Tag as a JSON array [categories, projects].\n{subject}\n{text}"))
                out.append((i, sorted({str(x) for x in (answer[0] if answer else [])}), [str(x) for x in (answer[1] if len(answer) > 1 else [])]))
            yield pd.DataFrame(out, columns=["id", "categories", "projects"])

    kind = messages.schema["id"].dataType.simpleString()
    answers = batch.select("id", "subject", "text").mapInPandas(run, f"id {kind}, categories array<string>, projects array<string>")
    return merge_tags(messages, answers), (last.ts_raw, last.id)
