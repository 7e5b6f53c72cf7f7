"""The word memory of operator 7."""

import re

import numpy as np
from tokenizers import Tokenizer

from leafmill.llm import packing

_MARK = r"[!\"#$%&()*+,\-./:;=?@\[\\\]^_`{}~]*"
_PLAIN = re.compile(rf"({_MARK})([A-Za-zÀ-ÖØ-öø-ÿ]+)({_MARK})")


def test_bodies_of_words_as_by_pattern():
    rng = np.random.default_rng(2)
    signs = list("aZéÀÖ×Ø÷ßÿÞñ") + ["'", "<", "&", "-", "~", "[", "7", "Ā", "½", "日", "😀", "́", "\x00"]
    words = ["".join(rng.choice(signs, int(rng.integers(1, 7)), p=np.array([6] * 12 + [1, 1, 3, 3, 3, 3] + [0.5] * 7) / 89.5)) for _ in range(3000)]
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(x) for x in raw])
    starts = np.append(0, ends[:-1])
    begin, end, lower = packing.plain_bodies(np.frombuffer(b"".join(raw), np.uint8), starts, ends)
    found = 0
    for word, x, a, b, p, q in zip(words, raw, starts, ends, begin, end, strict=True):
        parts = (x[: p - a].decode(), lower[p:q].tobytes().decode(), x[q - a :].decode())
        plain = _PLAIN.fullmatch(word)
        assert parts == ((plain[1], plain[2].lower(), plain[3]) if plain else (word, "", ""))
        found += bool(plain)
    assert 300 < found < 2700


def test_pieces_outlive_the_words_they_are_in():
    """A memory full of words drops these, but pieces of words stay known until there are too many of them."""
    path = packing.tokenizer_path()
    encoder, whole = packing.WordEncoder(path, known=50), Tokenizer.from_file(path)
    given, encode = [], encoder._encode
    encoder._encode = lambda texts: given.extend(texts) or encode(texts)
    texts = [" ".join(f"{'(' * i}house{',' * j} {'(' * i}Éclair{',' * j}" for i in range(3)) for j in range(20)]
    for text in texts + texts:
        assert encoder.encode_many([text])[0].tolist() == whole.encode(text, add_special_tokens=False).ids
    assert sum(x.split().count("house") for x in given) == 1
    many = [f"{'(' * k}x{',' * (k // 2)}" for k in range(200)]
    for text in many + texts:
        assert encoder.encode_many([text])[0].tolist() == whole.encode(text, add_special_tokens=False).ids
        assert encoder.pieces.n <= 50 + 6 and encoder.words.n <= 50 + 6
