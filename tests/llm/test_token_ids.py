"""Token ids piece by piece equal the ids of whole texts, as the library gives them."""
import random
import sys
import unicodedata

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kitman.llm import tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
MARKS = ".,;:!?*$#%&()[]\"|-"


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(PATH)
    return lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]


def check(whole, texts):
    made = tokens.Encoder(PATH)
    for at in range(0, len(texts), 100_000):
        part = texts[at:at + 100_000]
        wrong = [t for t, a, b in zip(part, made.encode(part), whole(part)) if np.frombuffer(a, "<u4").tolist() != b]
        assert not wrong, (len(wrong), wrong[:10])


def letters():
    return [c for c in map(chr, range(sys.maxunicode + 1)) if c.isalpha()]


def test_every_letter_before_a_mark(whole):
    check(whole, [f"a{c}. {c}." for c in letters()])


def test_letters_before_every_mark(whole):
    some = [c for c in letters() if "CJK" not in unicodedata.name(c, "CJK") and "HANGUL" not in unicodedata.name(c, "")]
    some = [c for c in some if ord(c) < 0x3000 or unicodedata.normalize("NFC", c) != c or len(c.lower()) > 1]
    check(whole, [f"{c}{m}" + f" x{c}{m}{n}" for c in some for m, n in zip(MARKS, MARKS[::-1])])


def test_random_texts_with_combining_marks(whole):
    r = random.Random(9)
    odd = ["̇", "́", "़", "̈", "̸", "İ", "ı", "ß", "ẞ", "Σ", "ς", "ǰ", "क़", "གྷ", "פֿ", "é", "Å", "Å",
           "ﬁ", "한", "ᄒ", "ᅡ", "中", "😀", "‍", " ", " ", "_", "'", "'s", "`", "<", "=", "�", "0", "42"]
    pool = odd + list("abcXYZ ,.;!?-()[]\"|\n\t") + ["the", "don't", "Word"]
    check(whole, ["".join(r.choices(pool, k=r.randrange(1, 14))) for _ in range(100_000)])


def test_long_texts_in_small_batches(whole):
    r = random.Random(3)
    check(whole, ["", " ".join(r.choice(["alpha,", "Beta.", "İ;[", "γάμμα!", "x" * 300]) for _ in range(200_000)), "z" * 300_000, "क़." * 5000])
