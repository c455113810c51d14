"""Prompts from format-style templates, as text or as token ids."""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import functions as F

from ..plans.core import Operator
from .tokenize import TokenizerSpec


def segments(template: str) -> list[tuple[str, str | None]]:
    """(literal, field after it or None); conversions and format specifications are ignored."""
    return [(literal, name) for literal, name, _, _ in string.Formatter().parse(template)]


def literal_length(template: str, tokenizer: TokenizerSpec | None = None) -> int:
    return sum(len(tokenizer.encode(text) if tokenizer else text) for text, _ in segments(template))


def fields_of(template: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(name for _, name in segments(template) if name is not None))


@dataclass(frozen=True, eq=False, repr=False)
class FillTextPrompt(Operator):
    """Literals and text fields joined in the template's order."""

    prompt_template: str
    output_field_name: str

    def inputs(self):
        return fields_of(self.prompt_template)

    def columns(self, df):
        parts = [x for text, name in segments(self.prompt_template) for x in ([F.lit(text)] if text else []) + ([F.col(name).cast("string")] if name is not None else [])]
        return {self.output_field_name: F.concat(*parts) if parts else F.lit("")}

    def outputs(self, df):
        return [self.output_field_name]


@dataclass(frozen=True, eq=False, repr=False)
class FillEncodedPrompt(Operator):
    """The same over ids: literals are tokenized once on the driver; first and last tokens, mask and type ids on request."""

    template: str
    tokenizer: TokenizerSpec
    output_prefix: str | None = None
    output_rename_map: dict[str, str] | None = None
    return_attention_mask: bool = True
    return_token_type_ids: bool = False
    add_bos_token: bool = True
    add_eos_token: bool = True

    def inputs(self):
        return fields_of(self.template)

    def named(self, c: str) -> str:
        if self.output_rename_map is not None:
            return self.output_rename_map[c]
        return f"{self.output_prefix}_{c}" if self.output_prefix else c

    def _names(self):
        return ["input_ids", *(["attention_mask"] if self.return_attention_mask else []), *(["token_type_ids"] if self.return_token_type_ids else [])]

    def columns(self, df):
        ids = lambda xs: F.array(*[F.lit(int(x)) for x in xs]).cast("array<int>")
        parts = [ids(self.tokenizer.bos)] if self.add_bos_token and self.tokenizer.bos else []
        for text, name in segments(self.template):
            parts += [ids(self.tokenizer.encode(text))] if text else []
            parts += [F.col(name).cast("array<int>")] if name is not None else []
        parts += [ids(self.tokenizer.eos)] if self.add_eos_token and self.tokenizer.eos else []
        made = F.concat(*parts) if parts else ids([])
        values = {"input_ids": made, "attention_mask": F.transform(made, lambda _: F.lit(1)), "token_type_ids": F.transform(made, lambda _: F.lit(0))}
        return {self.named(c): values[c] for c in self._names()}

    def outputs(self, df):
        return [self.named(c) for c in self._names()]
