"""Prebuilt pipelines."""

from __future__ import annotations

import math
from typing import Any

from ..functions.arrays import depth
from ..operators.batch import FixedBatchSize, ListCollator, from_tokenizer_collator
from ..operators.evidence import EncoderWithEvidenceLocation, ReplaceIfNoEvidencePrompt, strider_with_evidence
from ..operators.fields import ChangeFields, MakeField, RenameFields
from ..operators.prompt import FillEncodedPrompt, fields_of, literal_length
from ..operators.shape import SingleSequenceStrider, Unpacking
from ..operators.template import FewShotJinja, Jinja, fragments, input_fields, template_text
from ..operators.text import AddEvidencesLocation, ConcatenateContext, TextToWords, TruncateMultipleFields, WordsToText
from ..operators.tokenize import EncodeFields, Tokenize, TokenizerSpec
from ..operators.types import ToDense
from .core import Operator, Pipeline


def prompting(tokenizer: TokenizerSpec, source_template: str, target_template: str | None = None, fields_to_truncate: tuple[str, ...] = (), fields_to_stride: tuple[str, ...] = (), max_source_length: int | None = None, stride_length: int | None = None, stride: int | None = None, strategy: str = "longest", target_field: str = "labels", fields_to_keep: tuple[str, ...] = (), return_attention_mask: bool = True, add_eos_token: bool = True, encoder: Operator | None = None) -> Pipeline:
    """Encode the templates' fields, stride and truncate them to the source's budget (less its literals), fill both prompts, drop the rest."""
    names = tuple(dict.fromkeys((*fields_of(source_template), *(fields_of(target_template) if target_template else ()))))
    parts: list[Operator] = [encoder or EncodeFields(names, tokenizer)]
    parts += [SingleSequenceStrider((c,), stride_length or max_source_length, stride) for c in fields_to_stride]
    if max_source_length is not None and fields_to_truncate:
        specials = len(tokenizer.bos) + (len(tokenizer.eos) if add_eos_token else 0)
        keep = tuple(c for c in fields_of(source_template) if c not in fields_to_truncate)
        parts.append(TruncateMultipleFields(tuple(fields_to_truncate), max_source_length, keep, literal_length(source_template, tokenizer) + specials, strategy))
    parts.append(FillEncodedPrompt(source_template, tokenizer, output_rename_map={"input_ids": "__ids", "attention_mask": "__mask"}, return_attention_mask=return_attention_mask, add_eos_token=add_eos_token))
    final = {"__ids": "input_ids"} | ({"__mask": "attention_mask"} if return_attention_mask else {})
    if target_template:
        parts.append(FillEncodedPrompt(target_template, tokenizer, output_rename_map={"input_ids": "__target"}, return_attention_mask=False, add_bos_token=False, add_eos_token=add_eos_token))
        final["__target"] = target_field
    parts.append(RenameFields(final | {c: c for c in fields_to_keep}, remove_rest=True))
    return Pipeline(*parts)


def jinja(tokenizer: TokenizerSpec | None, jinja_template: str, num_shots: int | str = 0, max_source_length_per_shot: int | None = None, max_target_length_per_shot: int | None = None, truncation_strategy: str = "longest", use_words: bool = True, source_fields: tuple[str, ...] | None = None, target_fields: tuple[str, ...] | None = None, additional_fields_to_keep: tuple[str, ...] = ()) -> Pipeline:
    """Truncate the template's fields (in words or characters) to the budgets left by its text, render, and tokenize; without tokenizer the texts stay."""
    found = input_fields(jinja_template)
    target = tuple(target_fields if target_fields is not None else (c for c in found["target"] if c != "__shots__"))
    source = tuple(source_fields if source_fields is not None else (c for c in found["source"] if c not in ("__shots__", *target)))
    shots = num_shots if isinstance(num_shots, int) else 0
    texts = [template_text(f) for f in fragments(jinja_template)]
    size = lambda t: len(t.split()) if use_words else len(t)
    parts: list[Operator] = []
    every = tuple(dict.fromkeys((*source, *target)))
    cut_source, cut_target = max_source_length_per_shot is not None and bool(source), max_target_length_per_shot is not None and bool(target)
    if use_words and (cut_source or cut_target):
        parts.append(TextToWords(every, "ws"))
    if cut_source:
        budget = max_source_length_per_shot - math.ceil((max_target_length_per_shot or 0) * shots / (shots + 1)) - math.ceil(size(texts[0]) / (shots + 1))
        if budget < 1:
            raise ValueError("the template leaves no room for the source")
        parts.append(TruncateMultipleFields(source, budget, strategy=truncation_strategy))
    if cut_target:
        budget = max_target_length_per_shot - (size(texts[1]) if len(texts) > 1 else 0)
        if budget < 1:
            raise ValueError("the template leaves no room for the target")
        parts.append(TruncateMultipleFields(target, budget, strategy=truncation_strategy))
    if use_words and (cut_source or cut_target):
        parts.append(WordsToText(every))
    parts.append(Jinja(jinja_template) if num_shots == 0 else FewShotJinja(jinja_template, num_shots=num_shots))
    if tokenizer is None:
        return Pipeline(*parts)
    parts.append(Tokenize(tokenizer, "source"))
    keep = ["input_ids", "attention_mask", *additional_fields_to_keep]
    if len(texts) > 1:
        parts.append(Tokenize(tokenizer, "target", output_rename_map={"input_ids": "labels", "attention_mask": "__m"}))
        keep.append("labels")
    return Pipeline(*parts, ChangeFields(keep_fields=tuple(keep)))


def collator(tokenizer: TokenizerSpec | None = None, do_not_collate: tuple[str, ...] = (), batch_size: int | str = "max", keep_last: bool = True, fields_pad_ids: dict[str, Any] | None = None, unk_fields_pad_id: Any = None, field_cast_map: dict[str, str] | None = None, **padding: Any) -> Pipeline:
    """Batch rows, pad every field but do_not_collate to a rectangle, and give dense types."""
    if tokenizer is None and fields_pad_ids is None and unk_fields_pad_id is None:
        raise ValueError("give a tokenizer or pad values")
    pad = from_tokenizer_collator(tokenizer, fields_pad_ids, unk_fields_pad_id=unk_fields_pad_id, **padding) if tokenizer else ListCollator(fields_pad_ids=fields_pad_ids, unk_fields_pad_id=unk_fields_pad_id, **padding)
    parts: list[Operator] = [FixedBatchSize(batch_size, keep_last), _Skipping(pad, tuple(do_not_collate)) if do_not_collate else pad]
    return Pipeline(*parts, *([ToDense(field_cast_map)] if field_cast_map else []))


class _Skipping(Operator):
    """A collator that leaves some fields as lists."""

    def __init__(self, inner: ListCollator, skipped: tuple[str, ...]):
        object.__setattr__(self, "inner", inner)
        object.__setattr__(self, "skipped", skipped)

    @property
    def fingerprint(self):
        return f"{self.inner.fingerprint}{self.skipped}"

    def columns(self, df):
        return self.inner.columns(df.drop(*self.skipped))

    def outputs(self, df):
        return df.columns


class _Encoded(Operator):
    """A list that gives rows of their own is encoded before the rows multiply, so that what is repeated is encoded once; lists of lists after it."""

    kind = "G"

    def __init__(self, encoder: EncodeFields, unpacking: Unpacking):
        object.__setattr__(self, "encoder", encoder)
        object.__setattr__(self, "unpacking", unpacking)

    @property
    def fingerprint(self):
        return f"{self.encoder.fingerprint}{self.unpacking.fingerprint}"

    def inputs(self):
        return tuple(dict.fromkeys((*self.encoder.inputs(), *self.unpacking.inputs())))

    def transform(self, df):
        flat = all(depth(df.schema[c].dataType) == 1 for c in self.unpacking.fields_to_unpack)
        for part in (self.encoder, self.unpacking) if flat else (self.unpacking, self.encoder):
            df = part.transform(df)
        return df

    def outputs(self, df):
        return df.columns


def evidence_prompting(tokenizer: TokenizerSpec, source_template: str, target_template: str, no_evidence_template: str, context_field: str = "context", evidence_field: str = "evidences", question_field: str = "question", answer_field: str | None = "answers", max_length: int = 512, stride: int | None = None, train: bool = True) -> Pipeline:
    """Long contexts with evidence: joined, strided with a mask of the evidence; where a window has none, another target. Training rows have one answer each."""
    names = tuple(dict.fromkeys((*fields_of(source_template), *fields_of(target_template), *fields_of(no_evidence_template))))
    parts: list[Operator] = [ConcatenateContext(context_field)]
    encoder: Operator = EncoderWithEvidenceLocation(names, tokenizer, context_field=context_field, location_field="locations")
    if train and answer_field:
        unpacking = Unpacking((answer_field,), ignored_behavior="repeat")
        if answer_field in (context_field, evidence_field):
            parts.append(unpacking)
        else:
            encoder = _Encoded(encoder, unpacking)
    parts += [
        AddEvidencesLocation(context_field, evidence_field, "locations"),
        encoder,
        strider_with_evidence(context_field, "locations", max_length, stride),
        FillEncodedPrompt(source_template, tokenizer, output_rename_map={"input_ids": "__ids", "attention_mask": "__mask"}),
    ]
    if train:
        parts += [
            FillEncodedPrompt(target_template, tokenizer, output_rename_map={"input_ids": "__target"}, return_attention_mask=False, add_bos_token=False),
            ReplaceIfNoEvidencePrompt(no_evidence_template, tokenizer, return_attention_mask=False, add_bos_token=False, location_field="locations", target_field="__target"),
        ]
    else:
        parts.append(MakeField("__target", list(tokenizer.bos) or [0]))
    return Pipeline(*parts, RenameFields({"__ids": "input_ids", "__mask": "attention_mask", "__target": "labels" if train else "decoder_input_ids"}, remove_rest=True))
