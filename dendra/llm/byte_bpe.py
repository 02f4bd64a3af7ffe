"""Byte-level BPE ids and offsets, as the tokenizers library gives them for a tokenizer file.

The library reads the file. Where the file is a plain byte-level BPE (no normalizer, the usual word pattern, ranks in
the order of the ids), tiktoken's core applies the same merges some five times as fast; any other file, and any text
that core refuses (its pattern can't hold very long runs of white space), is encoded by the library itself.
"""

from __future__ import annotations

import json
import os
from itertools import permutations

import numpy as np

TOKENIZER = "byte_bpe_50k.json"
#: Texts whose ids both ways must agree before the fast way is taken.
PROBES = ("", "Hello, world's 42 tests!", " \n\n  a\tb  c   d　e ", "café café 中文\U0001f600 ٣²⅕ ʰ̂", "'S 'LL can't x'tis  1a2b\r\n\x0b\x0c\x85 .", "_-=+<|>" * 9)
_KINDS = {"lstrip": False, "rstrip": False, "single_word": False}


def _byte_of() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte, and the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _fast(spec: dict):
    """A tiktoken encoding of the file's contents, or None where the file isn't of the plain kind."""
    import public_tokenizers
    import tiktoken

    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or spec.get("truncation") or spec.get("padding") or model["type"] != "BPE":
        return None
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")):
        return None
    added = {a["content"]: a["id"] for a in spec["added_tokens"]}
    if any(a.get(k, v) != v for a in spec["added_tokens"] for k, v in _KINDS.items()) or any(a.startswith(b) for a, b in permutations(added, 2)):
        return None
    byte_of, vocab = _byte_of(), {k: v for k, v in model["vocab"].items() if k not in added}
    if any(c not in byte_of for k in vocab for c in k):
        return None
    made = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if None in made or any(b <= a for a, b in zip(made, made[1:])) or len(made) + 256 != len(vocab):
        return None
    ranks = {bytes(byte_of[c] for c in k): v for k, v in vocab.items()}
    return tiktoken.Encoding("from-file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


class ByteBpe:
    """Ids (and offsets in code points) of texts. ``controls`` become tokens of their own."""

    def __init__(self, path: str, controls: tuple[str, ...] = ()):
        from tokenizers import AddedToken, Tokenizer, processors

        self.tokenizer = Tokenizer.from_file(path)
        if controls:
            self.tokenizer.add_special_tokens([AddedToken(c, normalized=False) for c in controls])
        spec = json.loads(self.tokenizer.to_str())
        if (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel":
            self.tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)  # else a token's leading space has no offset
        self.specials = {a["content"] for a in spec["added_tokens"]}
        #: Bytes that hold any id.
        self.width = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.fast = _fast(spec)
        if self.fast is not None:
            self.sizes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
            for token, i in [*self.fast._mergeable_ranks.items(), *((k.encode(), v) for k, v in self.fast._special_tokens.items())]:
                self.sizes[i] = len(token)
            if any(self._core(p).tolist() != self._library(p).ids for p in (*PROBES, *self.specials)):
                self.fast = None

    def _core(self, text: str) -> np.ndarray:
        return self.fast.encode_to_numpy(text, allowed_special=self.specials, disallowed_special=())

    def _library(self, text: str):
        return self.tokenizer.encode(text, add_special_tokens=False)

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return self._core(text).astype(self.width)
            except ValueError:  # a run of white space beyond what the core's pattern can hold
                pass
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.width)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, and the first and last (exclusive) code point of each; tokens of one character's bytes share it."""
        if self.fast is not None:
            try:
                ids = self._core(text)
            except ValueError:
                pass
            else:
                ends = np.cumsum(self.sizes[ids])
                if text.isascii():
                    return ids, ends - self.sizes[ids], ends
                raw = np.frombuffer(text.encode(), np.uint8)
                point = np.cumsum((raw & 0xC0) != 0x80) - 1
                return ids, point[ends - self.sizes[ids]], point[ends - 1] + 1
        code = self._library(text)
        offsets = np.array(code.offsets, np.int64).reshape(-1, 2)
        return np.array(code.ids, np.int64), offsets[:, 0], offsets[:, 1]


_loaded: dict[tuple, ByteBpe] = {}


def load(path: str | None = None, controls: tuple[str, ...] = ()) -> ByteBpe:
    """Kept for the worker's life."""
    import public_tokenizers

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has a core; Spark runs the others
    key = (path or public_tokenizers.path(TOKENIZER), controls)
    if key not in _loaded:
        _loaded[key] = ByteBpe(*key)
    return _loaded[key]
