"""Tokenizers of public vocabulary files, loaded once a worker."""

from __future__ import annotations

import base64
import hashlib
import json

import numpy as np

_loaded: dict = {}


def file_digest(path: str) -> str:
    """The tokenizer's version: SHA-256 of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def sentencepiece_counter(path: str):
    """texts -> token counts by sentencepiece, without begin or end tokens."""
    if path not in _loaded:
        import sentencepiece

        _loaded[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    model = _loaded[path]
    return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]


def tokenizers_counter(path: str):
    """texts -> token counts by the tokenizers library, without added special tokens."""
    if path not in _loaded:
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    model = _loaded[path]
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(model.encode(x, add_special_tokens=False).ids) for x in texts]


def counter(path: str):
    """The counter for a file by its kind: ``.model`` or ``.json``."""
    return sentencepiece_counter(path) if path.endswith(".model") else tokenizers_counter(path)


#: UTF-8 bytes up to this one hold no character at or above U+0240.  Below it the two libraries' splitting
#: patterns use character classes that every Unicode version of the last decades agrees on.
PLAIN_BYTE = 0xC8


class ByteBpe:
    """Ids of a byte-level BPE ``.json`` file, by tokenizers or, where both agree, by its faster rank file.

    ``ranks`` names the same vocabulary as ``.tiktoken`` ranks.  Texts with characters from U+0240 on are
    always encoded by tokenizers itself.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        self.path, self._model, self.fast = path, None, None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            with open(path, encoding="utf-8") as f:
                special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens=special)

    @property
    def model(self):
        """The tokenizers model; loaded when a text needs it, as it takes much memory."""
        if self._model is None:
            from tokenizers import Tokenizer

            self._model = Tokenizer.from_file(self.path)
            self._model.no_truncation()
            self._model.no_padding()
        return self._model

    def ids(self, text: str, plain: bool) -> np.ndarray:
        if self.fast is not None and plain:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        return np.array(self.model.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def byte_bpe(path: str, ranks: str | None, pattern: str | None) -> ByteBpe:
    key = (path, ranks)
    if key not in _loaded:
        _loaded[key] = ByteBpe(path, ranks, pattern)
    return _loaded[key]
