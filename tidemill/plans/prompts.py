"""Prompts as expressions: a version header, then the parts that a step needs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VERSION = "1"
TASKS = {
    "route": "Choose how to answer the question: vector, graph or hybrid.",
    "grade": "Say for every chunk whether it helps to answer the question.",
    "rewrite": "Rewrite the query so that a search finds what the question asks for.",
    "answer": "Answer the question from the chunks alone and cite the ids that you used.",
    "judge": "Score from 0 to 1 how well the chunks support the answer.",
    "extract": "List entities and relations in every chunk with their places.",
}


def chunk_lines(chunks: Column) -> Column:
    """``chunks`` array<struct<chunk_id, text>> as numbered blocks."""
    return F.array_join(F.transform(chunks, lambda c: F.concat(F.lit("["), c["chunk_id"], F.lit("]\n"), c["text"])), "\n\n")


def render(task: str, **parts: Column) -> Column:
    """A prompt; a part that is null fails rather than vanish from it."""
    lines = [F.lit(f"# {task} v{VERSION}\n{TASKS[task]}")]
    for name, part in parts.items():
        lines.append(F.concat(F.lit(f"\n\n## {name}\n"), F.coalesce(part, F.raise_error(F.lit(f"prompt part {name} is null")).cast("string"))))
    return F.concat(*lines)
