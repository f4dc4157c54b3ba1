"""Structured generation by a remote model as a port: providers, fallback, validation, focused retry.

Providers are plain callables, so tests and offline runs use stand-ins; calls run in Arrow batches on the executors
and every failure stays a row with its attempts.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.runtime import cut

Provider = Callable[[str], str]


def offline(prompt: str) -> str:
    """A stand-in: echoes the fields of a JSON prompt as a verdict, deterministically."""
    data = json.loads(prompt)
    return json.dumps({"defendants": [{"Bi_Cao": data.get("name", ""), "Phat_Tu": data.get("hint", "")}]}, ensure_ascii=False)


def prompt(**fields: Column) -> Column:
    """The JSON payload of a call."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))


def call(prompts: DataFrame, providers: list[tuple[str, Provider]]) -> DataFrame:
    """(id, provider, response, attempts) of prompts (id, prompt): the first provider that answers.

    Repeated providers are tried once; ``attempts`` has an entry provider: error for each failure. Null prompts are
    not sent.
    """
    order = list(dict(providers).items())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for rid, text in zip(b["id"], b["prompt"], strict=True):
                name, answer, attempts = None, None, []
                for n, provider in order if text is not None else []:
                    try:
                        name, answer = n, provider(text)
                        break
                    except Exception as e:  # the next provider is tried
                        attempts.append(f"{n}: {e}")
                out.append((rid, name, answer, attempts))
            yield pd.DataFrame(out, columns=["id", "provider", "response", "attempts"])

    kind = prompts.schema["id"].dataType.simpleString()
    return prompts.select("id", "prompt").mapInPandas(run, f"id {kind}, provider string, response string, attempts array<string>")


def validated(responses: DataFrame, schema: str) -> DataFrame:
    """Responses with ``parsed`` and a status: ok, parse_error, or generation_error where no provider answered."""
    parsed = F.from_json("response", schema, {"mode": "PERMISSIVE"})
    valid = F.expr("try_parse_json(response) is not null")
    status = F.when(F.col("response").isNull(), "generation_error").when(~valid, "parse_error").otherwise("ok")
    return responses.withColumn("parsed", parsed).withColumn("status", status)


def with_retry(prompts: DataFrame, providers: list[tuple[str, Provider]], empty: Column, again: Column) -> DataFrame:
    """Call; where ``empty`` holds of the first response, call once more with the prompt ``again``.

    Adds ``retried`` and ``warnings``, one for each answer that was asked for again and one if that failed too.
    """
    first = cut(call(prompts, providers)).join(prompts, "id").withColumn("retried", F.coalesce(empty, F.lit(False)))
    retry = call(first.where("retried").select("id", again.alias("prompt")), providers).select("id", F.col("response").alias("second"))
    failed = F.col("retried") & F.col("second").isNull()
    warnings = F.array_compact(F.array(F.when(F.col("retried"), F.lit("empty answer, asked again")), F.when(failed, F.lit("no second answer"))))
    return first.join(retry, "id", "left").withColumn("warnings", warnings).withColumn("response", F.coalesce("second", "response")).drop("second")
