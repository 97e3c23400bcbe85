import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm import tokens

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
_loaded = {}


def both(name):
    if name not in _loaded:
        path = public_tokenizers.path(name)
        whole = Tokenizer.from_file(path)
        with open(path, "rb") as f:
            _loaded[name] = whole, tokens.Encoder(f.read())
    return _loaded[name]


def check(name, text):
    whole, own = both(name)
    assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


SPECIAL = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|", "|>", "  "]
ODD = st.text(alphabet=st.sampled_from(list("aBc'stréÈñßΣσς 1٣²½_.,!%$\t\n\r\x0b\x1c\x85\xa0᠎  ​́İ日🙂<|>")), max_size=40)


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=300, deadline=None)
@given(text=st.one_of(ODD, st.text(max_size=60)))
def test_same_ids_as_whole_tokenizer(name, text):
    check(name, text)


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=200, deadline=None)
@given(parts=st.lists(st.one_of(st.sampled_from(SPECIAL), ODD), max_size=8))
def test_special_strings_are_their_tokens(name, parts):
    check(name, "".join(parts))


def test_other_kinds_of_added_tokens_are_refused():
    with open(public_tokenizers.path(FILES[0]), "rb") as f:
        changed = f.read().replace(b'"lstrip": false', b'"lstrip": true').replace(b'"lstrip":false', b'"lstrip":true')
    with pytest.raises(ValueError):
        tokens.Encoder(changed)


@pytest.mark.parametrize("name", FILES)
@pytest.mark.parametrize("text", ["", " ", "  \n", "it's  I'LL we'd", "<|endoftext|> a <|startoftext|>", "a" * 5000, "x́ ́y", "tabs\t\tand\nlines\n\n"])
def test_fixed_texts(name, text):
    check(name, text)


@pytest.mark.parametrize("name", FILES)
def test_long_texts_and_small_caches(name, monkeypatch):
    monkeypatch.setattr(tokens, "SEGMENT_CHARS", 50)
    monkeypatch.setattr(tokens, "CACHE", 7)
    whole, _ = both(name)
    with open(public_tokenizers.path(name), "rb") as f:
        own = tokens.Encoder(f.read())
    texts = [" ".join(f"word{i % k} and,more" for i in range(90)) for k in (3, 50)] + ["", "short"]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("name", FILES)
def test_unknown_pieces_of_many_texts_take_few_calls_of_the_library(name):
    whole, _ = both(name)
    with open(public_tokenizers.path(name), "rb") as f:
        own = tokens.Encoder(f.read())
    texts = [f"Wörd{chr(97 + i % 26)}{chr(97 + i // 26)}x, ÉTÉ it's{i} ￿日本 <|endoftext|>  \n" for i in range(300)]
    calls, joined = [], own._joined

    class Counted:
        def encode_batch_fast(self, *args, **kwargs):
            calls.append(args)
            return joined.encode_batch_fast(*args, **kwargs)

    own._joined = Counted()
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert 0 < len(calls) <= 2


def test_latin_letters_fold_as_the_normalizer_folds_them():
    whole, own = both("word_bpe_49k.json")
    letters = [chr(c) for c in range(ord(tokens._LATIN) + 1) if not chr(c).isspace()]
    assert [whole.normalizer.normalize_str(c) for c in letters] == [c.lower() for c in letters]
    for c in letters:
        check("word_bpe_49k.json", f"a{c}b {c} {c},{c}")
