"""Model hook (C21) and prompt blocks.

Inference is a user callable over prompts, set up once a task; its raw outputs
land in ``model_outputs(doc_id, stage, raw, error, attempts)`` and go through the
same parsers as any stored output.  A prompt the callable can't answer becomes a
row with the error, so the document stays in the results.  Prompts are plain
string columns.
"""

from __future__ import annotations

from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab


ENTITY_HEAD = "List every piece of personal data in the text that follows.\nReport these categories and no others:\n"
ENTITY_TEXT = "\n\nText:\n"
ROLE_HEAD = "Say which role each of these people and organisations plays in the text.\n\nNames:\n"
ROLE_TEXT = "\n\nStart of the text:\n"
OWNER_HEAD = "Say whose each piece of data is, by the role of its owner.\n\nRoles:\n"
OWNER_DATA = "\n\nData:\n"


def category_block(categories=None) -> Column:
    cats = categories or vocab.CATEGORIES
    return F.lit("\n".join(f"  - {c}" for c in cats))


def entity_prompt(content: Column, categories=None) -> Column:
    """Entity-extraction user message: category list, then the document."""
    return F.concat(F.lit(ENTITY_HEAD), category_block(categories), F.lit(ENTITY_TEXT), content)


def role_prompt_lines(ents: Column) -> Column:
    """Bulleted actor list ``  - "value" (category)`` in entity order."""
    return F.array_join(F.transform(ents, lambda e: F.concat(
        F.lit('  - "'), e["value"], F.lit('" ('), e["category"], F.lit(")"))), "\n")


def role_prompt(ents: Column, content: Column) -> Column:
    """Role-stage user message over the first 3000 characters."""
    return F.concat(
        F.lit(ROLE_HEAD), role_prompt_lines(ents), F.lit(ROLE_TEXT), F.substring(content, 1, vocab.ROLE_PROMPT_HEAD_CHARS))


def ownership_prompt(actors: Column, data: Column, content: Column) -> Column:
    """Ownership user message: the roles found, the data without an owner, and the
    first 2000 characters (B13).  ``actors`` (value, semantic_role), ``data`` (value, entity_type)."""
    roles = F.array_join(F.transform(actors, lambda e: F.concat(F.lit('  - "'), e["value"], F.lit('" is '), e["semantic_role"])), "\n")
    items = F.array_join(F.transform(data, lambda e: F.concat(F.lit('  - "'), e["value"], F.lit('" ('), e["entity_type"], F.lit(")"))), "\n")
    return F.concat(F.lit(OWNER_HEAD), roles, F.lit(OWNER_DATA), items, F.lit(ROLE_TEXT), F.substring(content, 1, vocab.OWNERSHIP_PROMPT_HEAD_CHARS))


def run_model(prompts: DataFrame, make_model: Callable[[], Callable[[list[str]], list[str]]], stage: str, retries: int = 2, batch: int = 64) -> DataFrame:
    """The answers to ``prompts(doc_id, prompt)`` as doc_id, stage, raw, error, attempts.

    ``make_model`` is called once a task and returns the callable, which answers a
    list of prompts.  A list that fails is asked again prompt by prompt, each up
    to ``retries`` times and once at least; what still fails has a null ``raw`` and
    the kind of the error (never its text, which may hold the document).  A null prompt isn't
    asked.  The callable must answer alike when a lost task is run again.
    """
    def answer(model, asked: list[str]) -> list[tuple]:
        try:
            out = list(model(asked))
            if len(out) != len(asked):
                raise ValueError("one answer a prompt is needed")
            return [(raw, None, 1) for raw in out]
        except Exception:  # noqa: BLE001 - any failure of the user's callable is a row
            rows = []
            for prompt in asked:
                row = None
                for attempt in range(2, max(retries, 1) + 2):
                    try:
                        row = (model([prompt])[0], None, attempt)
                        break
                    except Exception as e:  # noqa: BLE001
                        row = (None, type(e).__name__, attempt)
                rows.append(row or (None, "failed", 1))
            return rows

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for part in parts:
            for at in range(0, len(part), batch):
                some = part.iloc[at:at + batch]
                asked = some[some["prompt"].notna()]
                if len(asked) and model is None:
                    model = make_model()
                found = dict(zip(asked.index, answer(model, asked["prompt"].tolist()) if len(asked) else []))
                rows = [found.get(i, (None, "no prompt", 0)) for i in some.index]
                yield pd.DataFrame({"doc_id": some["doc_id"], "stage": stage, "raw": [r[0] for r in rows], "error": [r[1] for r in rows], "attempts": [r[2] for r in rows]})

    return prompts.select("doc_id", "prompt").mapInPandas(run, f"doc_id {prompts.schema['doc_id'].dataType.simpleString()}, stage string, raw string, error string, attempts int")
