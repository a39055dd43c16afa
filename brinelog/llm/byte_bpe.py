"""Byte-level BPE ids of whole texts, as the ``tokenizers`` library gives them.

The vocabulary is read from the library's JSON file.  Where its merges are in
order of id, texts of plain Latin characters are encoded by ``tiktoken`` with
the same merges as ranks (the two agree there; the tests compare them); texts
with other characters or with an added token's string go to ``tokenizers``.
"""

from __future__ import annotations

import json
import re

import numpy as np

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PLAIN = re.compile(r"[^\t\n\r\x20-\x7e¡-ɏ]")


def _byte_of_char() -> dict[str, int]:
    """The characters that stand for bytes in vocabularies of this kind."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.no_padding()
        self.slow.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.fast = self._fast(spec)

    def _fast(self, spec: dict):
        import tiktoken

        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if spec["normalizer"] or model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            return None
        if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            return None
        vocab, chars = model["vocab"], _byte_of_char()
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != sorted(merged) or len(vocab) - len(merged) - sum(t in vocab for t in self.added) != 256:
            return None
        ranks = {bytes(chars[c] for c in t): i for t, i in vocab.items() if t not in self.added}
        if max(ranks[bytes([b])] for b in range(256)) > min(merged):
            return None
        return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None and not PLAIN.search(text) and not any(t in text for t in self.added):
            return self.fast.encode_to_numpy(text)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


_LOADED: dict[str, ByteBpe] = {}


def byte_bpe(path: str) -> ByteBpe:
    """The tokenizer of a path, loaded once per process."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]
