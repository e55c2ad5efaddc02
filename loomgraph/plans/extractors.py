"""Model-backed extraction: the contract, prompts, readers of the services' answers, and a stub.

An extractor is a function from a chunk's prompt to JSON text ``{nodes, edges}``. Nothing here opens
a connection; a caller passes a function that does.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Selection

Extractor = Callable[[str], str]
RESPONSES = "chunk_seq long, response string, warning string"


def prompts(chunks: DataFrame, summaries: DataFrame, selection: Selection, phase: int = 0, registry: str = "", frozen: bool = False) -> DataFrame:
    """(chunk_seq, prompt): what an extractor is asked for each chunk."""
    rules = {
        1: "Phase 1: only definitions, notations and basic constructions. Names must be stable; use an existing id again wherever it means the same.",
        2: "Phase 2: everything else. Refer to existing concepts by their ids." + (" The names are frozen: make no new node for a concept that is listed." if frozen else ""),
    }.get(phase, "")
    parts: list[Column] = [
        F.lit("Extract a knowledge graph of mathematics from the LaTeX below. Answer with JSON only."),
        F.lit("Entity types: " + ", ".join(selection.entities)),
        F.lit("Relation types: " + ", ".join(selection.relations)),
        *([F.lit(rules)] if rules else []),
        *([F.lit("Registered concepts:\n" + registry)] if registry else []),
        F.lit("Take only what the text states: named environments and displayed formulas. Copy contents whole, without ellipses. Keep an example or exercise and its solution in one node."),
        F.concat(F.lit("Known graph:\n"), F.coalesce("summary", F.lit(""))),
        *([F.lit("Notes: " + selection.notes.strip())] if selection.notes.strip() else []),
        F.concat(F.lit("Chunk "), "id", F.lit(" of "), "file", F.lit(", section "), F.array_join("section_path", " / "), F.lit(", title "), "title"),
        F.concat(F.lit("LaTeX:\n"), "text"),
        F.lit('Format: {"nodes": [{"id": "tex:<label> or <chunk id>:<type>:<number>", "type", "title", "content", "source": {"file", "latexLabel", "sectionPath"}, "meta": {"chunkId", "confidence"}}], "edges": [{"type", "source", "target", "evidence", "meta"}]}. Ends of edges are ids of nodes here or in the known graph.'),
    ]
    return chunks.join(summaries, "chunk_seq", "left").select("chunk_seq", F.concat_ws("\n\n", *parts).alias("prompt"))


def responses(asked: DataFrame, extractor: Extractor, parallelism: int = 4, strict: bool = False) -> DataFrame:
    """(chunk_seq, response, warning) of each prompt; with ``strict`` a failure fails the run, else it is the row's warning.

    At most ``parallelism`` (1 to 32) prompts are open at a time. Write the result before it is
    used: a task that runs again asks again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for place, prompt in zip(b["chunk_seq"], b["prompt"], strict=True):
                try:
                    rows.append((place, extractor(prompt), None))
                except Exception as e:
                    if strict:
                        raise
                    rows.append((place, None, f"chunk {place >> 16} failed: {e}"))
            yield pd.DataFrame(rows, columns=["chunk_seq", "response", "warning"])

    n = max(1, min(32, int(parallelism or 1)))
    return asked.repartition(n, "chunk_seq").mapInPandas(run, RESPONSES)


def remembered(extractor: Extractor, folder: str, model: str = "") -> Extractor:
    """``extractor`` with its answers kept in ``folder``, a file for each model and prompt, so no prompt is answered twice.

    A task looks for a prompt's file before it asks, and writes it as soon as it has the answer, so neither a task that runs
    again nor a run that was ended and is started anew asks again. Failures are not kept. The folder is in
    a store that pyarrow opens and all executors share.
    """

    def ask(prompt: str) -> str:
        import pyarrow.fs as pf

        key = hashlib.sha256(f"{model}\0{prompt}".encode()).hexdigest()
        fs, root = pf.FileSystem.from_uri(folder if "://" in folder else "file://" + os.path.abspath(folder))
        at = f"{root.rstrip('/')}/{key[:2]}/{key}.json"
        if fs.get_file_info(at).type == pf.FileType.File:
            with fs.open_input_stream(at) as f:
                return f.read().decode()
        answer = extractor(prompt)
        fs.create_dir(os.path.dirname(at), recursive=True)
        own = f"{at}.{uuid.uuid4().hex}"
        with fs.open_output_stream(own) as f:
            f.write(answer.encode())
        fs.move(own, at)  # whole or not at all
        return answer

    return ask


def stub(answers: dict[str, str]) -> Extractor:
    """An extractor for tests: the answer whose key the prompt holds, else an empty graph."""
    return lambda prompt: next((v for k, v in answers.items() if k in prompt), '{"nodes": [], "edges": []}')


# ---- answers of services -----------------------------------------------------------------------------


def looks_like_html(text: str) -> bool:
    head = text.strip()[:200].lower()
    return head.startswith(("<!doctype", "<html")) or "<head" in head or "<body" in head


def answer_json(text: str) -> dict:
    """A service's answer as an object, with a plain message where it is a page or cut off."""
    if looks_like_html(text):
        raise ValueError(f"the service sent a page, not JSON: {text.strip()[:120]}")
    try:
        return json.loads(text)
    except ValueError as e:
        raise ValueError(f"the answer is not JSON: {text.strip()[:120]}") from e


def answer_text(protocol: str, body: dict) -> str:
    """The model's text in an answer of one of the three protocols."""
    if protocol == "openai":
        if isinstance(body.get("output_text"), str):
            return body["output_text"]
        parts = [c.get("text", "") for o in body.get("output") or [] for c in o.get("content") or [] if isinstance(c.get("text"), str)]
        choices = body.get("choices") or [{}]
        return "".join(parts) or (choices[0].get("message") or {}).get("content") or ""
    if protocol == "anthropic":
        return next((c.get("text", "") for c in body.get("content") or [] if c.get("type") == "text"), "")
    if protocol == "gemini":
        found = (body.get("candidates") or [{}])[0].get("content") or {}
        return "".join(p.get("text", "") for p in found.get("parts") or [])
    raise ValueError(f"unknown protocol {protocol}")


def safe_text(read: Callable[[], str]) -> str:
    """What ``read`` gives of an answer's body; nothing if it can't be read."""
    try:
        return read()
    except Exception:
        return ""


def requests_of(protocol: str, config, prompt: str) -> list[tuple[str, dict]]:
    """(path, body) of what to post to a service of one of the three protocols; where there are two, the second if the first fails."""
    if protocol == "openai":
        common = {"model": config.model, "temperature": config.temperature, "top_p": config.top_p, "response_format": {"type": "json_object"}}
        chat = {**common, "messages": [{"role": "user", "content": prompt}], "max_tokens": config.max_tokens}
        return [("responses", {**common, "input": prompt, "max_output_tokens": config.max_tokens}), ("chat/completions", chat)]
    if protocol == "anthropic":
        return [("messages", {"model": config.model, "max_tokens": config.max_tokens, "temperature": config.temperature, "top_p": config.top_p, "messages": [{"role": "user", "content": prompt}]})]
    if protocol == "gemini":
        return [("generateContent", {"contents": [{"role": "user", "parts": [{"text": prompt}]}], "generationConfig": {"temperature": config.temperature, "topP": config.top_p, "maxOutputTokens": config.max_tokens, "responseMimeType": "application/json"}})]
    raise ValueError(f"unknown protocol {protocol}")


def service(config, post: Callable[[str, dict], str]) -> Extractor:
    """An extractor over ``post``, which sends a body to a path of the service and returns its answer's text.

    Any failure of the first request, an answer that is no JSON included, leads to the second; the last one's failure is raised.
    """

    def ask(prompt: str) -> str:
        tries = requests_of(config.protocol, config, prompt)
        for i, (path, body) in enumerate(tries):
            try:
                return json.dumps(answer_json(answer_text(config.protocol, answer_json(post(path, body)))))
            except Exception:
                if i == len(tries) - 1:
                    raise
        raise ValueError("nothing to post")

    return ask
