"""Token ids of whole texts with a public tokenizer file, coded through their distinct chunks."""

from __future__ import annotations

import re

import numpy as np

from .textops import ChunkCoder, expand, ragged

#: Chunks coded as one text, with separators that come out as one known id between them.
JOINED = 512
SEPARATORS = ["\n", " \x00 "]
_CODERS: dict[tuple[str, bool], ChunkCoder] = {}


def tokenizer_coder(spec: str, added_as_text: bool = True) -> ChunkCoder:
    """Chunk coder for a byte-level tokenizer given as its JSON text (one per worker process).

    Coding chunk by chunk (``textops.word_chunks``) equals coding the whole text.  Strings of added tokens (such as an end-of-text
    marker) get the added id, as by the library's default, or are ordinary text (``added_as_text``).
    """
    if (spec, added_as_text) not in _CODERS:
        _CODERS.clear()
        _CODERS[spec, added_as_text] = ChunkCoder(_encoder(spec, added_as_text))
    return _CODERS[spec, added_as_text]


def _added(tokenizer) -> re.Pattern | None:
    """Pattern of the added tokens' strings; None if there is none."""
    tokens = tokenizer.get_added_tokens_decoder().values()
    for t in tokens:
        # chunks are cut at white space and stops only, so that a cut cannot touch any other added token
        if t.lstrip or t.rstrip or t.single_word or t.normalized or re.search(r"[\s.,;:!?]", t.content):
            raise ValueError(f"added token {t.content!r} can lie across a cut between chunks")
    return re.compile(b"|".join(re.escape(t.content.encode()) for t in tokens)) if tokens else None


def _encoder(spec: str, added_as_text: bool):
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_str(spec)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.encode_special_tokens = added_as_text
    added = None if added_as_text else _added(tokenizer)

    def code(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    left, right = code(["a,"])[0], code([" b"])[0]
    separator, mark = "", None
    for text in SEPARATORS:
        ids = code([f"a,{text} b"])[0]
        if len(ids) == len(left) + len(right) + 1 and ids[:len(left)] == left and ids[len(left) + 1:] == right:
            separator, mark = text, ids[len(left)]
            break
    glue, barred = separator.encode(), separator.strip(" ").encode()

    def encode(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        plain, single = [], []
        for k, c in enumerate(chunks):
            joins = mark is not None and barred not in c and b" " not in c[1:] and not (added and added.search(c))
            (plain if joins else single).append(k)
        order, parts, counts = [], [], []
        for at in range(0, len(plain), JOINED):
            group = plain[at:at + JOINED]
            ids = np.array(code([glue.join([chunks[k] for k in group]).decode("utf-8")])[0], np.uint32)
            cuts = np.flatnonzero(ids == mark)
            if len(cuts) != len(group) - 1:
                single += group
                continue
            order += group
            parts.append(np.delete(ids, cuts))
            counts.append(np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1)
        flat, lengths = ragged(code([chunks[k].decode("utf-8") for k in single]))
        flat, lengths = np.concatenate([*parts, flat]), np.concatenate([*counts, lengths])
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        back = np.empty(len(chunks), np.int64)
        back[order + single] = np.arange(len(chunks))
        return expand(flat, offsets, back)[0], lengths[back]
    return encode


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()
