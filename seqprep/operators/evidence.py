"""Question answering with evidence: shifting locations to tokens, masks, and other prompts where there is no evidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..plans.core import Operator
from .prompt import FillEncodedPrompt
from .shape import SingleSequenceStrider
from .tokenize import EncodeFields


@dataclass(frozen=True, eq=False, repr=False)
class EncoderWithEvidenceLocation(EncodeFields):
    """EncodeFields, then [start, end) character locations in the context as a mask over its tokens; [-1, -1] is missing."""

    context_field: str = "context"
    location_field: str = "locations"

    def inputs(self):
        return (*super().inputs(), self.location_field)

    def transform(self, df):
        offset = f"{self.offset_prefix}_{self.context_field}"
        more = EncodeFields(self.fields_to_encode, self.tokenizer, self.is_split_into_words, tuple(dict.fromkeys((*self.fields_to_return_offset_mapping, self.context_field))), self.offset_prefix)
        out = df.withColumns(more.columns(df))
        hit = lambda places, o: F.exists(places, lambda p: (p[0] >= 0) & (o[0] < p[1]) & (o[1] > p[0]))
        out = out.withColumn(self.location_field, A.bound(F.col(self.location_field), lambda places: F.transform(F.col(offset), lambda o: F.when(hit(places, o), F.lit(1)).otherwise(F.lit(0)))))
        return out if self.context_field in self.fields_to_return_offset_mapping else out.drop(offset)

    def outputs(self, df):
        return [*super().outputs(df), self.location_field]


def strider_with_evidence(context_field: str, location_field: str, max_length: int, stride: int | None = None, extra: tuple[str, ...] = ()) -> SingleSequenceStrider:
    """Windows over the context, its mask and further fields alike."""
    return SingleSequenceStrider(tuple(sorted({context_field, location_field, *extra})), max_length, stride)


@dataclass(frozen=True, eq=False, repr=False)
class ReplaceIfNoEvidencePrompt(FillEncodedPrompt):
    """Where the mask has no one, the target is replaced by the filled template."""

    location_field: str = "locations"
    target_field: str = "target"

    def inputs(self):
        return (*super().inputs(), self.location_field, self.target_field)

    def columns(self, df):
        filled = next(iter(super().columns(df).values()))
        kind = df.schema[self.target_field].dataType
        other = F.array(filled) if A.depth(kind) > 1 else filled
        return {self.target_field: F.when(F.exists(F.col(self.location_field), lambda x: x > 0), F.col(self.target_field)).otherwise(other.cast(kind.simpleString()))}

    def outputs(self, df):
        return [self.target_field]
