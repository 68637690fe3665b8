"""Prompt templates as column expressions, and the registry users extend."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The wording of the instruction layouts.
INTRO_WITH_INPUT = (
    "Below is an instruction that describes a task, paired with an input that provides further context. "
    "Write a response that appropriately completes the request."
)
INTRO_PLAIN = (
    "Below is an instruction that describes a task. "
    "Write a response that appropriately completes the request."
)

Fields = Mapping[str, Column]
Template = Callable[[Fields], Column]


def _field(fields: Fields, name: str) -> Column:
    """The bound column as text; an unbound field or a null reads as empty."""
    bound = fields.get(name)
    return F.lit("") if bound is None else F.coalesce(bound.cast("string"), F.lit(""))


def _section(title: str, body: Column) -> Column:
    return F.concat(F.lit(f"### {title}:\n"), body)


def alpaca(fields: Fields) -> Column:
    if "instruction" not in fields:
        raise ValueError("template 'alpaca' needs the field 'instruction'")
    given = _field(fields, "input")
    instruction = _section("Instruction", _field(fields, "instruction"))
    response = _section("Response", _field(fields, "output"))
    # concat_ws leaves out the null section when there is no input.
    return F.concat_ws(
        "\n\n",
        F.when(given != "", F.lit(INTRO_WITH_INPUT)).otherwise(F.lit(INTRO_PLAIN)),
        instruction,
        F.when(given != "", _section("Input", given)),
        response,
    )


def chatml_turn(role: Column, content: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), content, F.lit("<|im_end|>"))


def chatml(fields: Fields) -> Column:
    def turn(role: str) -> Column:
        content = _field(fields, role)
        return F.when(content != "", chatml_turn(F.lit(role), content))

    return F.concat_ws("\n", turn("system"), turn("user"), turn("assistant"))


def llama2(fields: Fields) -> Column:
    system = _field(fields, "system")
    preamble = F.when(
        system != "", F.concat(F.lit("<<SYS>>\n"), system, F.lit("\n<</SYS>>\n\n"))
    ).otherwise(F.lit(""))
    return F.concat(
        F.lit("<s>[INST] "), preamble, _field(fields, "user"),
        F.lit(" [/INST] "), _field(fields, "assistant"),
    )


def completion(fields: Fields) -> Column:
    return F.concat(_field(fields, "text"), _field(fields, "completion"))


_REGISTRY: dict[str, Template] = {
    "alpaca": alpaca,
    "chatml": chatml,
    "llama2": llama2,
    "completion": completion,
}


def register_template(name: str, build: Template) -> None:
    """Add or replace a template; ``build`` maps bound columns to the prompt column."""
    _REGISTRY[name] = build


def get_template(name: str) -> Template:
    if name not in _REGISTRY:
        raise ValueError(f"unknown template {name!r}; known: {sorted(_REGISTRY)}")
    return _REGISTRY[name]


def prompt(df: DataFrame, name: str, mapping: Mapping[str, str]) -> Column:
    """Prompt column for ``df``; ``mapping`` is template field -> column name."""
    bound = {
        field: (F.col(f"`{column}`") if column in df.columns else F.lit(""))
        for field, column in mapping.items()
    }
    return get_template(name)(bound)
