"""Answering prompts with a language model by several strategies, in stages that are saved one after another.

A stage calls the model once for each row, in batches on the executors. Its result is saved before the next stage starts, so that a lost executor repeats calls
of one stage only.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..runtime import saved, ship
from .models import EchoClient, LlmClient

QUESTIONS = 5


def joined(*parts: Column | str) -> Column:
    """The parts that are not blank, with blank lines between."""
    cols = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.concat_ws("\n\n", *(F.when(F.trim(F.coalesce(c, F.lit(""))) != "", c) for c in cols))


def complete(df: DataFrame, prompt: Column, out: str, client: LlmClient | None = None, system_col: str | None = None) -> DataFrame:
    """df with the client's answers to a prompt as a saved column."""
    ship(df.sparkSession)
    client = client or EchoClient()
    columns = df.columns
    asked = df.withColumn("_prompt", prompt).withColumn("_system", F.col(system_col) if system_col else F.lit(None).cast("string"))
    n = len(columns)

    def run(batches):
        for b in batches:
            said = [client.complete(p or "", s) for p, s in zip(b.column(n).to_pylist(), b.column(n + 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(said, pa.string())], [*columns, out])

    return saved(asked.mapInArrow(run, StructType([*df.schema.fields, StructField(out, StringType())])), "llm-stage")


def baseline(df: DataFrame, client: LlmClient | None = None, prompt_col: str = "prompt", system_col: str | None = None) -> DataFrame:
    """One call: columns initial and final."""
    return complete(df, F.col(prompt_col), "initial", client, system_col).withColumn("final", F.col("initial"))


def self_refine(df: DataFrame, client: LlmClient | None = None, rounds: int = 1, prompt_col: str = "prompt", system_col: str | None = None) -> DataFrame:
    """A draft, then feedback and a rewrite for each round: 1 + 2 rounds calls; columns initial, feedback, refined, final."""
    if rounds < 1:
        raise ValueError("at least one round")
    out = complete(df, F.col(prompt_col), "initial", client, system_col)
    now = "initial"
    for i in range(rounds):
        ask = joined("Review the answer below against its task: list unsupported claims, missing or invented citations and breaches of the format, each with a fix that adds no new claim.", F.concat(F.lit("TASK:\n"), prompt_col), F.concat(F.lit("ANSWER:\n"), now))
        out = complete(out, ask, f"feedback_{i}", client, system_col)
        ask = joined("Rewrite the answer so that every point of the feedback is met. Change as little as possible and add no claim.", F.concat(F.lit("TASK:\n"), prompt_col), F.concat(F.lit("ANSWER:\n"), now), F.concat(F.lit("FEEDBACK:\n"), f"feedback_{i}"))
        out = complete(out, ask, f"refined_{i}", client, system_col)
        now = f"refined_{i}"
    told = out.withColumn("feedback", F.col(f"feedback_{rounds - 1}")).withColumn("refined", F.col(now)).withColumn("final", F.col(now))
    return told.drop(*(f"{c}_{i}" for i in range(rounds) for c in ("feedback", "refined")))


def chain_of_verification(df: DataFrame, client: LlmClient | None = None, questions: int = QUESTIONS, prompt_col: str = "prompt", system_col: str | None = None) -> DataFrame:
    """Draft, questions about it, answers from the prompt alone, revision: four calls; columns initial, questions, answers, final."""
    if questions < 1:
        raise ValueError("at least one question")
    task = F.concat(F.lit("TASK:\n"), prompt_col)
    out = complete(df, F.col(prompt_col), "initial", client, system_col)
    out = complete(out, joined(f"Write exactly {questions} numbered questions that check the draft's claims and citations and that the task's own content can answer.", task, F.concat(F.lit("DRAFT:\n"), "initial")), "questions", client, system_col)
    out = complete(out, joined("Answer each question from the task's content only, with its citations; say NOT VERIFIABLE where the task does not tell.", task, F.concat(F.lit("QUESTIONS:\n"), "questions")), "answers", client, system_col)
    return complete(out, joined("Revise the draft by the answers: drop or weaken what they do not support, add citations, add no claim.", task, F.concat(F.lit("DRAFT:\n"), "initial"), F.concat(F.lit("ANSWERS:\n"), "answers")), "final", client, system_col)


STRATEGIES = {"baseline": baseline, "self_refine": self_refine, "cove": chain_of_verification}
