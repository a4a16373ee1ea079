"""Prompts, request bodies and answers of chat models, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ferrytext.functions.text import py_strip


def build_prompt(unit: Column, context: Column, style: Column, target: str, template: str = "[style=%s] Translate into %s.\n") -> Column:
    """Instruction, the context block if there is context, and the unit."""
    block = F.when(context != "", F.concat(F.lit("Context:\n"), context, F.lit("\n"))).otherwise(F.lit(""))
    return F.concat(F.format_string(template, style, F.lit(target)), block, unit)


def request_json(model: str, system: Column, user: Column, temperature: Column, image: Column | None = None) -> Column:
    """A chat request as JSON; the temperature is kept within 0 and 1, a picture goes along in base64."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    fields = [
        F.lit(model).alias("model"),
        F.lit(False).alias("stream"),
        F.array(message("system", system), message("user", user)).alias("messages"),
        F.struct(F.least(F.lit(1.0), F.greatest(F.lit(0.0), temperature.cast("double"))).alias("temperature")).alias("options"),
    ]
    if image is not None:
        fields.append(F.array(F.base64(image)).alias("images"))
    return F.to_json(F.struct(*fields))


def parse_response(body: Column) -> Column:
    """(status, answer, error) of a JSON answer: message.content or else response, stripped; empty answers fail with
    their done_reason."""
    x = F.from_json(body, "error string, message struct<content:string>, response string, done_reason string")
    empty = x["error"].isNull() & x["message"].isNull() & x["response"].isNull() & x["done_reason"].isNull()
    text = py_strip(F.coalesce(F.nullif(x["message"]["content"], F.lit("")), x["response"], F.lit("")))
    error = (
        F.when(empty, F.lit("not JSON"))
        .when(x["error"].isNotNull(), x["error"])
        .when(text == "", F.concat(F.lit("empty: "), F.coalesce(x["done_reason"], F.lit(""))))
    )
    return F.struct(
        F.when(error.isNull(), F.lit("ok")).otherwise(F.lit("failed")).alias("status"),
        F.when(error.isNull(), text).alias("answer"),
        error.alias("error"),
    )
