"""Two public tokenizers over whole texts, with the bytes of their tokens.

A is a byte-level BPE (a ``tokenizers`` JSON file), B a sentencepiece BPE with byte
fallback. Special tokens are never produced: their strings are plain text.
The files stay where they are; ``folder`` must be readable on every executor.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

FOLDER, FILE_A, FILE_B = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
# Fixed value: how the byte-level vocabulary splits text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts that every Unicode version splits alike, without very long runs of white space: the rank form of A encodes them
#: several times faster and with equal ids; all other texts go through the JSON file's own tokenizer.
_PLAIN = re.compile(r"(?:[\x00-ɏ‐-‧‰-‾€])*")
_LONG_RUN = re.compile(r"\s{1000}")
LONG = 100_000


def is_plain(text: str) -> bool:
    return bool(_PLAIN.fullmatch(text)) and not (len(text) > LONG and _LONG_RUN.search(text))


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Tokenizer A."""

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["id"] for t in spec["added_tokens"] if t["special"]}
        letters = _byte_letters()
        vocabulary = {i: bytes(letters[c] for c in t) for t, i in spec["model"]["vocab"].items() if i not in special}
        self.tokens = [vocabulary.get(i, b"") for i in range(max(vocabulary) + 1)]
        self._ranks = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks={b: i for i, b in vocabulary.items()}, special_tokens={})
        self._own = Tokenizer.from_file(path)
        self._own.encode_special_tokens = True

    def ids(self, text: str) -> list[int]:
        if is_plain(text):
            return self._ranks.encode_ordinary(text)
        return self._own.encode(text, add_special_tokens=False).ids


class Pieces:
    """Tokenizer B."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self._own = SentencePieceProcessor(model_file=path)
        self.tokens = [self._bytes(i) for i in range(self._own.get_piece_size())]

    def _bytes(self, i: int) -> bytes:
        piece = self._own.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if self._own.is_byte(i) else piece.replace("▁", " ").encode()

    def ids(self, text: str) -> list[int]:
        return self._own.encode(text, num_threads=1)


@lru_cache(maxsize=4)
def load(kind: str, path: str) -> ByteLevel | Pieces:
    """One tokenizer per Python worker; tasks that share the worker share it."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return {"byte": ByteLevel, "piece": Pieces}[kind](path)
