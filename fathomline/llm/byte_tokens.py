"""Exact byte-level BPE ids at speed; used by the binary-output and packing operators.

The vocabulary is read from the tokenizers library's JSON file. Where its merges stand in the order of their ids, as
they do in byte-level vocabularies, the ids are also the ranks of tiktoken's merge loop, which is three to four
times as fast; any other vocabulary, and every text that holds a special token, goes through the library itself.
"""

from __future__ import annotations

import functools
import json
import os

import numpy as np

from fathomline.llm.merges import byte_chars


class ByteTokens:
    """Texts to little-endian id bytes (``self.dtype``), equal to the library's ids without added special tokens."""

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(tokenizer_path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, made = spec["model"]["vocab"], ["".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        order = [vocab[m] for m in made]
        plain = spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and not spec["normalizer"]
        self.core = None
        if plain and order == sorted(set(order)) and len(vocab) == 256 + len(order):
            of = {c: b for b, c in enumerate(byte_chars())}
            ranks = {bytes(of[c] for c in token): i for token, i in vocab.items()}
            self.core = tiktoken.Encoding("from_json", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe

    def ids(self, text: str) -> np.ndarray:
        if self.core is None or any(s in text for s in self.special):
            return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype=self.dtype)
        return np.frombuffer(self.core.encode_to_tiktoken_buffer(text, set()), dtype=np.uint32).astype(self.dtype)


@functools.lru_cache(maxsize=2)
def byte_tokens(tokenizer_path: str) -> ByteTokens:
    """One encoder for each worker process."""
    return ByteTokens(tokenizer_path)


def default_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
