"""Tree concatenation against the library."""
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from logweave.llm import bpe_tree
from logweave.llm.tokenizer_ids import read_spec

BYTE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def coder():
    return bpe_tree.tree_coder(read_spec(BYTE))


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(BYTE)


def ids_of(plain, text):
    return plain.encode(text or "", add_special_tokens=False).ids


def test_joins_equal_the_library(coder, plain):
    """Random texts cut anywhere; the pre-tokens' starts are those of the whole text too."""
    rng = random.Random(1)
    alphabets = ["ab", "a", "aab'", "'re' ", "  \n x", "'lls've ", "éè 日本　  ", "12a !?", "the cat sat on ", "🙂é", " \t\r\n"]
    for _ in range(2500):
        text = "".join(rng.choices(rng.choice(alphabets) + rng.choice(alphabets), k=rng.randint(1, 60)))
        if rng.random() < 0.3:
            text = "".join(rng.choices(["the", "re", "'", "ing", " ", "aa", "a", "hello", " world"], k=rng.randint(1, 30)))
        leaf = rng.randint(1, 9)
        got = coder.tree([coder.leaf(text[k:k + leaf]) for k in range(0, len(text), leaf)])
        want = coder.leaf(text)
        assert want.ids.tolist() == ids_of(plain, text)
        assert got.ids.tolist() == want.ids.tolist() and got.first.tolist() == want.first.tolist(), (text, leaf)


@pytest.mark.parametrize("text", ["a" * 30_001, "ab" * 20_000, "é" * 10_000, "日本語テキスト" * 3000, "!" * 9000 + " " * 9000 + "x",
                                  "".join(random.Random(2).choices("abcdefghijklmnopqrstuvwxyz", k=30_000))])
def test_unsplit_texts(coder, plain, text):
    got = coder.tree([coder.leaf(text[k:k + 999]) for k in range(0, len(text), 999)])
    assert got.ids.tolist() == ids_of(plain, text)


def test_windows_stay_small_where_sides_agree(coder, monkeypatch):
    """A join in the middle of a long unsplit text re-encodes a few tokens, not the text."""
    text = "".join(random.Random(3).choices("abcdefghijklmnopqrstuvwxyz", k=40_000))
    a, b = coder.leaf(text[:20_000]), coder.leaf(text[20_000:])
    seen = []
    monkeypatch.setattr(coder, "_merge", lambda piece, old=coder._merge: seen.append(len(piece)) or old(piece))
    assert coder.join(a, b).ids.tolist() == coder.leaf(text).ids.tolist()
    assert seen and max(seen) < 200


def test_decoding_equals_the_library(coder, plain):
    rng = random.Random(4)
    for _ in range(1500):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 6))]
        assert coder.decode(np.array(ids, np.uint32)) == plain.decode(ids, skip_special_tokens=False)
    assert coder.decode(np.array([70_000, 64], np.uint32)) == plain.decode([70_000, 64], skip_special_tokens=False)


def digests(plain, text):
    ids = ids_of(plain, text)
    back = plain.decode(ids, skip_special_tokens=False)
    return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


@pytest.mark.parametrize("leaf, fan", [(bpe_tree.LEAF, bpe_tree.FAN), (40, 2)])
def test_documents(spark, docs, rows, empty, plain, leaf, fan):
    """Awkward rows, repeated and null ids, added tokens and texts of many leaves, over several rounds."""
    rng = random.Random(5)
    more = ["<|endoftext|>", "a" * 700, "x<|endoftext|>" * 60 + "y" * 300, "it's " * 200, "".join(rng.choices("ab '\n", k=900))]
    extra = spark.createDataFrame([(900, more[0]), (None, more[1]), (None, more[2]), (901, more[3]), (901, more[4]), (901, more[4])],
                                  "doc_id long, text string")
    spec = read_spec(BYTE)
    every = docs.select("doc_id", "text", "id", "node").unionByName(extra, allowMissingColumns=True)
    coded = bpe_tree.encode_texts(every, spec, leaf=leaf, fan=fan)
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_tokens, r.ids_sha256, r.decoded_sha256)
                 for r in bpe_tree.code_digest(bpe_tree.decode_ids(coded, spec)).collect())
    texts = [(r[0], r[1]) for r in rows] + [(r.doc_id, r.text) for r in extra.collect()]
    assert got == sorted(((k is None, k or 0), *digests(plain, t)) for k, t in texts)
    assert bpe_tree.encode_texts(empty, spec).count() == 0


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        bpe_tree.TreeCoder(read_spec(public_tokenizers.path("word_bpe_49k.json")))
