"""The two public vocabularies: their encoders and the bytes of their tokens. Files are opened where they are used, by path."""

from __future__ import annotations

import json
from functools import lru_cache

import public_tokenizers
import sentencepiece
import tiktoken

BYTE_BPE, PIECE_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SPACE = "▁"


def _byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and number the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def byte_bpe(path: str = BYTE_BPE) -> tuple[tiktoken.Encoding, list[bytes]]:
    """(encoding, bytes of each id) of a byte-level BPE file, run by tiktoken; `encode(text, allowed_special="all")` reads
    the strings of special tokens as these tokens, `encode_ordinary` as text. An id is the rank of its merge."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    letters, special = _byte_of_letter(), {t["content"]: t["id"] for t in model["added_tokens"] if t["special"]}
    ranks = {bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    tokens = [b""] * (max([*ranks.values(), *special.values()]) + 1)
    for token, i in [*ranks.items(), *((s.encode(), i) for s, i in special.items())]:
        tokens[i] = token
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special), tokens


@lru_cache(maxsize=2)
def piece_bpe(path: str = PIECE_BPE) -> tuple[sentencepiece.SentencePieceProcessor, list[bytes]]:
    """(processor, bytes of each id) of a piece model: U+2581 is a space and <0xHH> a byte."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return model, [bytes([int(n[3:5], 16)]) if model.is_byte(i) else n.replace(SPACE, " ").encode() for i, n in enumerate(names)]
