"""Byte-level tokenizers: texts put together from their pieces equal the library's encoding."""

import itertools
import random
from types import SimpleNamespace

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from seqprep import catalog
from seqprep import operators as o
from seqprep.operators import tokenize as K


@pytest.fixture(scope="module")
def library():
    with open(catalog.TOKENIZER, encoding="utf-8") as f:
        t = Tokenizer.from_str(f.read())
    t.no_padding()
    t.no_truncation()
    return t


def test_f3_pieces_equal_the_library(library, monkeypatch):
    monkeypatch.setattr(K, "_KNOWN", 2000)
    r, kept = random.Random(3), 0
    made, some = K._Pieces(library), list("ab '’sStredlvm019²½_-!?.,\n\t\r    éñüß日本語🙂👍🏽क्षि\x1c\x00‍٣Ⅷ\u0085 ﬀ한")
    for _ in range(5000):
        text = "".join(r.choices(some[: r.randint(3, len(some))], k=r.randint(0, 40)))
        got, want = made(text), library.encode(text, add_special_tokens=False)
        if got is not None:
            kept += 1
            assert got.ids.tolist() == want.ids and got.flat.tolist() == list(itertools.chain.from_iterable(want.offsets))
            assert [got.attention_mask.tolist(), got.type_ids.tolist(), got.special_tokens_mask.tolist()] == [want.attention_mask, want.type_ids, want.special_tokens_mask]
    assert kept > 2000 and len(made.places) < 2100
    assert made("a<|endoftext|>b") is None and made("x²") is None


def test_f3_other_tokenizers_go_to_the_library():
    assert K._Pieces.fit(catalog._spec().json) and not K._Pieces.fit(catalog._plain().json)


def test_f2_what_is_remembered_has_a_bound_in_tokens_and_outlives_a_task(library, monkeypatch):
    monkeypatch.setattr(K, "_KNOWN", 2000)
    r, made = random.Random(2), K._Pieces(library)
    for _ in range(100):
        text = "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=2000))
        assert made(text).ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(made.places.ids) < 6000
    assert K._remembered(catalog._spec().json) is K._remembered(catalog._spec().json) and K._remembered(catalog._plain().json) is None


def test_f7_frequent_pieces_are_encoded_once_while_rare_ones_come_and_go(library, monkeypatch):
    monkeypatch.setattr(K, "_KNOWN", 200)
    asked = []
    model = SimpleNamespace(tokenize=lambda piece: asked.append(piece) or library.model.tokenize(piece))
    made = K._Pieces(SimpleNamespace(model=model, pre_tokenizer=library.pre_tokenizer, encode=library.encode, get_vocab=library.get_vocab, get_added_tokens_decoder=library.get_added_tokens_decoder))
    for k in range(26**2):
        text = f"the {chr(97 + k // 26)}{chr(97 + k % 26)} né the"
        got, want = made(text), library.encode(text, add_special_tokens=False)
        assert got.ids.tolist() == want.ids and got.flat.tolist() == list(itertools.chain.from_iterable(want.offsets))
    assert asked.count("the") == asked.count("\u0120the") == 1 and len(asked) < 26**2 + 10


def test_f6_texts_are_put_together_from_the_bytes_of_tokens(spark, library, monkeypatch):
    r, size = random.Random(6), library.get_vocab_size()
    some = ["ab the 12", "éñüß日本語🙂", "", "a<|endoftext|>b", "x\ufffdy", "\x00"]
    valid = [library.encode(x, add_special_tokens=False).ids for x in some]
    parts = [[r.randrange(256) for _ in range(r.randint(1, 9))] for _ in range(300)] + [[size, 5, size + 7]]
    for skip in (False, True):
        op = o.Decode(catalog._spec(), ("x",), skip, False)
        run, nested = op._decoder(False).func, op._decoder(True).func
        want = [library.decode(x, skip_special_tokens=skip) for x in [*valid, *parts]]
        ids = pa.array([None, *valid, *parts, None], pa.list_(pa.int32()))
        assert pa.concat_arrays(run(iter([ids.slice(1), ids.slice(0, 3)]))).to_pylist() == [*want, None, None, *want[:2]]
        lists = pa.array([[valid[0], parts[0]], None, [], valid[1:4]], pa.list_(pa.list_(pa.int32())))
        for held in (1, K._HELD):
            monkeypatch.setattr(K, "_HELD", held)
            assert pa.concat_arrays(nested(iter([lists.slice(1), lists]))).to_pylist() == [None, [], want[1:4], [want[0], want[len(valid)]], None, [], want[1:4]]
    monkeypatch.setattr(K, "_built", lambda text: None)
    assert pa.concat_arrays(op._decoder(False).func(iter([pa.array(valid[:3], pa.list_(pa.int32()))]))).to_pylist() == some[:3]


def test_f7_texts_are_cut_and_looked_up_together(library, monkeypatch):
    cut, r, some = [], random.Random(7), list("ab sStreldvm''''  \n\t1²_-!é日🙂\u0085 ") + ["'re", "'ll ", "<|endoftext|>"]
    monkeypatch.setattr(K, "_PIECE", SimpleNamespace(findall=lambda text, real=K._PIECE: cut.append(text) or real.findall(text)))
    made = K._Pieces(library)
    for _ in range(50):
        texts = ["".join(r.choices(some[: r.randint(2, len(some))], k=r.randint(0, 40))) for _ in range(100)]
        encode = K._encoder(library, catalog._spec().json, False, add_special_tokens=False)
        for text, got, want in zip(texts, made.together(texts), encode(texts), strict=True):
            assert (got is None) == ("²" in text or "<|endoftext|>" in text)
            if got is not None:
                assert got.ids.tolist() == want.ids and got.flat.tolist() == list(itertools.chain.from_iterable(want.offsets))
    assert max(map(len, cut)) < 10, "a regular expression goes over characters that are new, not over texts"
    assert made.together([]) == [] and [len(x) for x in made.together(["", ""])] == [0, 0]


def test_f7_what_follows_from_the_ids_is_not_sent_by_python(spark, library, monkeypatch):
    functions, real = [], K.F.arrow_udf
    monkeypatch.setattr(K.F, "arrow_udf", lambda schema: lambda f: functions.append(f) or real(schema)(f))
    texts, lists = ["the cat's  ", None, "", "a<|endoftext|>b", "é x² 日本"], [["the", "a b"], None, [], ["", "né"], ["x²"]]
    df = spark.createDataFrame([*zip(range(5), texts, lists)], "k int, text string, list array<string>")
    ids, offsets = ([None if x is None else f(library.encode(x, add_special_tokens=False)) for x in texts] for f in (lambda e: e.ids, lambda e: [list(p) for p in e.offsets]))
    each = [None if x is None else [library.encode(text, add_special_tokens=False).ids for text in x] for x in lists]
    got = o.Tokenize(catalog._spec(), "text", return_offsets_mapping=True, return_length=True).map(df).orderBy("k").collect()
    assert [(r.input_ids, r.offset_mapping) for r in got] == [*zip(ids, offsets, strict=True)]
    assert [(r.attention_mask, r.length) for r in got] == [(None, None) if x is None else ([1] * len(x), len(x)) for x in ids]
    more = o.Tokenize(catalog._spec(), "list", return_length=True).map(df).orderBy("k").collect()
    assert [(r.input_ids, r.attention_mask, r.length) for r in more] == [(None, None, None) if x is None else (x, [[1] * len(y) for y in x], [*map(len, x)]) for x in each]
    o.EncodeFields(("text", "list"), catalog._spec(), fields_to_return_offset_mapping=("text",)).columns(df)
    columns = pa.array(texts), pa.array(lists)
    for taken in (1, 12, K._TAKEN):
        monkeypatch.setattr(K, "_TAKEN", taken)
        one, two, both = (pa.concat_arrays(f(iter([x, x]))).to_pylist() for f, x in zip(functions, (*columns, columns), strict=True))
        assert one == [{"input_ids": x, "offset_mapping": y} for x, y in zip(ids, offsets, strict=True)] * 2 and two == [{"input_ids": x} for x in each] * 2
        assert both == [{"text": x, "list": y, "offset_text": z} for x, y, z in zip(ids, each, offsets, strict=True)] * 2
