"""Words with marks behind them: the ids of the tokenizer, from the ids of the word and of the marks."""

import random

import numpy as np
from tokenizers import Tokenizer

from corpusloom.llm import packing


class Counted:
    def __init__(self, tokenizer):
        self.tokenizer, self.calls = tokenizer, 0

    def encode(self, *given, **options):
        self.calls += 1
        return self.tokenizer.encode(*given, **options)


def test_marks_behind_words_are_not_encoded_with_each_word():
    path = packing.default_vocabulary()
    plain, encoder = Tokenizer.from_file(path), packing.Encoder(path)
    counted = encoder.tokenizer = Counted(plain)
    r = random.Random(7)
    marks = ["***", "&&&", "$$$", "###", ",", ".", "...", "!?", ")", "'", '"', "%", "}~"]
    words = ["".join(r.choices("abcdefghAZéñß", k=r.randrange(1, 9))) for _ in range(800)]
    text = " ".join(w + r.choice(marks) for w in words)
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    assert counted.calls <= len(marks)


def test_odd_words_with_marks():
    path = packing.default_vocabulary()
    plain, encoder = Tokenizer.from_file(path), packing.Encoder(path)
    stems = ["x", "12", "don't", "'s", "a.b", "«", "x»", "½", "²", "é", "中", "ꟲ", "͸", "<|endoftext|>", "a<|endoftext|>", "-", "_", "a_", "퟿", "x‍"]
    tails = ["", ".", "'", "'s", "''", "...", "***", "|>", "<|", "<|endoftext|>", "’", "«.", "_", "~"]
    for _ in range(2):
        for stem in stems:
            for tail in tails:
                for text in (stem + tail, f"a {stem}{tail} b", f"a\n{stem}{tail}\nb", f"{stem}{tail}"):
                    found = np.frombuffer(encoder.encode(text), "<u4").tolist()
                    assert found == plain.encode(text, add_special_tokens=False).ids, text
