"""A stage that asks an outside service for every row. Saved answers are the default input of all later stages."""

from __future__ import annotations

import time

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ask_all(articles: DataFrame, ask, attempts: int = 2, per_minute: float | None = None, base: float = 1.0, cap: float = 900.0) -> DataFrame:
    """(id, answer) of rows (id, text): ask(text) returns the answer or raises; after the last attempt the answer is
    `Error: ...`. Waits between attempts double up to `cap`; `per_minute` limits the calls of one task. Null texts are
    not asked and have a null answer."""

    def run(frames):
        last = 0.0
        for pdf in frames:
            out = []
            for text in pdf["text"]:
                answer = None
                for attempt in range(attempts if text is not None else 0):
                    if per_minute:
                        time.sleep(max(0.0, last + 60 / per_minute - time.monotonic()))
                        last = time.monotonic()
                    try:
                        answer = ask(text)
                        break
                    except Exception as e:  # noqa: BLE001
                        answer = f"Error: {e}"
                        if attempt + 1 < attempts:
                            time.sleep(min(cap, base * 2**attempt))
                out.append(answer)
            yield pd.DataFrame({"id": pdf["id"], "answer": pd.Series(out, dtype=object)})

    kind = articles.schema["id"].dataType.simpleString()
    return articles.select("id", "text").mapInPandas(run, f"id {kind}, answer string")


def resume(articles: DataFrame, done: DataFrame, ask, **how) -> DataFrame:
    """Answers of `done` (id, answer) and of the articles that are still open, each id once."""
    open_ids = articles.join(done.select("id").distinct(), "id", "left_anti")
    return done.select("id", "answer").join(articles.select("id").distinct(), "id", "left_semi").unionByName(ask_all(open_ids, ask, **how))


def usage_totals(answers: DataFrame) -> DataFrame:
    """Rows, failures and characters of all answers in one pass."""
    failed = F.coalesce(F.col("answer").startswith("Error:"), F.lit(False))
    return answers.agg(F.count("*").alias("n"), F.count_if(failed).alias("n_failed"), F.sum(F.when(~failed, F.char_length("answer"))).alias("chars"))
