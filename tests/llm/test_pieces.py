"""Token counts by pieces of texts against the library's counts of the whole texts."""

import json
import random

import pyarrow as pa
import public_tokenizers
import pytest

from lamina.llm import token_counts as tc

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [*"  \n\t\r\x0b\x1c\x7f\x85\xa0aZé'sré9½!…—   　᠎﻿​漢😀", "  ", "   ", "'s", " 's", "'ll", "<|endoftext|>", " <|endoftext|> ", "word", " x", " \n", "\n "]


@pytest.mark.parametrize("cut", [True, False])
def test_pieces_have_the_tokens_of_the_whole_text(cut):
    from tokenizers import Tokenizer

    tok, rng = Tokenizer.from_file(PATH), random.Random(7)
    texts = ["", *("".join(rng.choice(PARTS) for _ in range(rng.randrange(25))) for _ in range(20_000)), ""]
    count = lambda xs: [len(e) for e in tok.encode_batch_fast(xs, add_special_tokens=False)]
    got = []
    for _, raw, offs in tc.tm.slices(pa.array(texts), 100_000):
        pieces, number, first = tc._pieces(raw, offs, cut)
        of = count(pieces.to_pylist())
        got += [sum(of[k] for k in number[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    assert got == count(texts)


def test_each_word_goes_through_the_tokenizer_once():
    raw, offs = next(tc.tm.slices(pa.array(["some word and some word again"] * 500), 10**6))[1:]
    assert sorted(tc._pieces(raw, offs, True)[0].to_pylist()) == [" again", " and", " some", " word", "some"]


def test_other_tokenizers_get_whole_texts(tmp_path):
    """One that adds a space, has no pattern, normalises or looks beyond a piece is not cut for."""
    own = json.loads(open(PATH, encoding="utf-8").read())
    assert tc.cuts_at_spaces(PATH)
    for change in ({"pre_tokenizer": own["pre_tokenizer"] | {"add_prefix_space": True}}, {"pre_tokenizer": own["pre_tokenizer"] | {"use_regex": False}}, {"pre_tokenizer": None}, {"normalizer": {"type": "NFC"}}, {"added_tokens": [own["added_tokens"][0] | {"lstrip": True}]}):
        (tmp_path / "t.json").write_text(json.dumps(own | change), encoding="utf-8")
        assert not tc.cuts_at_spaces(str(tmp_path / "t.json"))
