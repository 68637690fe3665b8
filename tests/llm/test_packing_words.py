"""Ids of words that go to the tokenizer's model at once."""

import random

import numpy as np
from tokenizers import Tokenizer

from corpusloom.llm import packing


class Counted:
    """A tokenizer that counts what is encoded by all of its steps."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, []

    def encode(self, text, **options):
        self.texts.append(text)
        return self.tokenizer.encode(text, **options)


def test_new_words_of_letters_skip_the_splitter_and_have_the_same_ids():
    path = packing.default_vocabulary()
    plain, encoder = Tokenizer.from_file(path), packing.Encoder(path)
    counted = encoder.tokenizer = Counted(plain)
    r = random.Random(4)
    letters = [chr(c) for c in range(0x250) if chr(c).isalpha() and packing._PLAIN.fullmatch(chr(c))]
    assert len(letters) > 400
    words = ["".join(r.choices(letters[:52] if k % 2 else letters, k=r.randrange(1, 30))) for k in range(4_000)]
    texts = [" ".join(words[k : k + 40]) + "\n" + "\n".join(words[k : k + 9]) for k in range(0, 4_000, 40)]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    assert set(counted.texts) <= {"\n"}


def test_other_words_go_through_all_steps():
    path = packing.default_vocabulary()
    plain, encoder = Tokenizer.from_file(path), packing.Encoder(path)
    texts = ["don't we'll x9 9x a_b été́ 你好 ªº × ÷ß ƻǀ Kⅰ ²m² março, абв! \U0001f600a",
             "a\nb c\n d \n\ne", "\n", "", " a", "a ", "one\ttwo", "<|endoftext|> word<|endoftext|>word", "a b"]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
