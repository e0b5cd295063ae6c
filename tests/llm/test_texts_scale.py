"""What the text operators do for batches at once equals what they did word by word."""

import random
import re

import numpy as np
import pyarrow as pa
import regex

import public_tokenizers
from meridian.llm import bpe, common, toxicity


def _texts(signs, n=4000):
    rng = random.Random(5)
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, 10))) for _ in range(n)]


def test_cuts_keep_all_pieces_whole():
    texts = _texts(["a", "Bc", "é", " ", " ", "\n", "\t", "'s", "1", ".", "\xa0", "  ", "\r\n", "東", "²", "_", "'", "\x1c", "\x85", " "])
    find = regex.compile(public_tokenizers.PATTERN).findall
    assert [[p for chunk in chunks for p in find(chunk)] for chunks in bpe.cut(pa.array(texts)).to_pylist()] == list(map(find, texts))
    assert bpe.cut(pa.array([], pa.string())).to_pylist() == []


def test_words_and_their_places_without_a_table_of_names():
    texts = _texts(["a", "B", "É", "ß", "İ", " ", "_", "1", "٣", "²", "ª", "́", ".", "\n", "\x1d", "\xa0", "東", "'"])
    want = [re.findall(r"[^\W\d_]+", t.lower()) for t in texts]
    assert list(map(toxicity._words, texts)) == want and toxicity._words(None) == []
    words = [w for found in want for w in found]
    names = sorted(set(words[::3]))
    assert toxicity._places(pa.array(names), words).tolist() == [names.index(w) if w in names else -1 for w in words]
    assert toxicity._places(pa.array([], pa.string()), ["a"]).tolist() == [-1]
    assert toxicity._places(pa.array(names), []).tolist() == []


def test_workers_give_memory_back_after_a_task(monkeypatch):
    done = []
    monkeypatch.setattr(common, "release_memory", lambda: done.append(len(done)))
    run = common.releasing(lambda batches: (b * 2 for b in batches))(iter([1, 2]))
    assert next(run) == 2 and next(run) == 4 and done == []
    assert next(run, None) is None and done == [0]


def test_values_of_parts_on_end():
    parts = pa.array([b"a", b"", b"bcd", b"e"], pa.large_binary()).take(pa.array([2, 0, 3, 1]))
    assert bpe._joined(parts, np.array([0, 2, 2, 4])).to_pylist() == [b"bcda", b"", b"e"]
