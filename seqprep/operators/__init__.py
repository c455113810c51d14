"""All operators."""

from .batch import FixedBatchSize, ListCollator, Padding, batches, collate, from_tokenizer_collator, tensor_collator
from .cache import EndCaching, StartCaching
from .custom import AddConstant, BatchFunction, Debug, RowFunction, TableFunction
from .evidence import EncoderWithEvidenceLocation, ReplaceIfNoEvidencePrompt, strider_with_evidence
from .fields import ChangeFields, EnumerateField, ExtractPath, MakeField, RenameFields
from .filters import Filter
from .lookup import LookupTable
from .masks import IndicesToMask, MakeAttentionMask, MaskToIndices, MaskToRange, OneVsOther, RangeToMask, UniqueAnswer
from .prompt import FillEncodedPrompt, FillTextPrompt
from .shape import Flatten, LabelsMasker, MultiSequenceStrider, SequencesConcatenate, SingleSequenceStrider, SingleSequenceStriderWithLocations, SingleValueToSequence, Unpacking
from .template import FewShotJinja, Jinja, registered
from .text import AddEvidencesLocation, ConcatenateContext, FixText, TextToWords, TruncateMultipleFields, TruncateMultipleNestedFields, TruncateSingleField, ValidUnicode, WordsToText
from .tokenize import AttentionMaskSequencePadding, Decode, EncodeFields, Tokenize, TokenizerSpec, TokensSequencesPadding, TokenTypeIdsSequencePadding
from .types import Binarizer, Cast, FromDense, Lookup, OneHot, ToDense

__all__ = [n for n in dir() if n[0] != "_"]
