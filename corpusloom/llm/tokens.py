"""Public tokenizers inside tasks: ids of byte-level BPE and of sentence pieces, and the bytes of their tokens."""

from __future__ import annotations

import base64
import hashlib
import json
import os
from functools import cache, cached_property

import numpy as np


@cache
def encoder(vocabulary: str, added: bool = True):
    """Encoder for a public byte-level BPE file: a ``.tiktoken`` list of ranks, and the added tokens of the JSON beside it."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(vocabulary), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    special = {}
    if added:
        with open(public_tokenizers.path(vocabulary.replace(".tiktoken", ".json")), encoding="utf-8") as full:
            special = {token["content"]: token["id"] for token in json.load(full)["added_tokens"]}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


@cache
def json_tokenizer(vocabulary: str, plain: bool):
    """The tokenizers library on a JSON vocabulary; ``plain``: strings of added tokens are ordinary text."""
    import public_tokenizers
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    made = Tokenizer.from_file(str(public_tokenizers.path(vocabulary)))
    made.encode_special_tokens = plain
    return made


def byte_bpe_ids(text: str, vocabulary: str, added: bool = True) -> np.ndarray:
    """Ids (unsigned 32-bit) of a text of any length by a byte-level BPE; ``added``: strings of added tokens count as such.

    The encoder of the ranks gives them fast; its pattern can't cross a run of about a million
    white-space characters, and such texts go to the library of the JSON vocabulary. Both give the
    same ids.
    """
    try:
        return encoder(vocabulary, added).encode_to_numpy(text, allowed_special="all" if added else set(), disallowed_special=())
    except ValueError:
        ids = json_tokenizer(vocabulary.replace(".tiktoken", ".json"), not added).encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype=np.uint32)


@cache
def piece_tokenizer(vocabulary: str):
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path(vocabulary)))


@cache
def tokenizer_digest(vocabulary: str) -> str:
    """SHA-256 (hex) of a tokenizer's version: the bytes of its file, its library and that library's version."""
    from importlib.metadata import version

    import public_tokenizers

    library = "sentencepiece" if vocabulary.endswith(".model") else "tokenizers"
    with open(public_tokenizers.path(vocabulary), "rb") as whole:
        digest = hashlib.sha256(whole.read())
    digest.update(f"{library} {version(library)}".encode())
    return digest.hexdigest()


class Spelling:
    """Byte strings by id, one after the other, so that those of many ids are gathered at once."""

    def __init__(self, strings: list[bytes]):
        self.lengths = np.array([len(s) for s in strings], dtype=np.int32)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths[:-1], dtype=np.int32))).astype(np.int32)
        self.data = np.frombuffer(b"".join(strings), dtype=np.uint8)

    def __len__(self) -> int:
        return len(self.lengths)

    def spelled(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ``ids``, joined, and where each ends."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        places = np.repeat((self.starts[ids] - (ends - lengths)).astype(np.int32), lengths)
        places += np.arange(len(places), dtype=np.int32)
        return self.data[places], ends


class ByteBPE:
    """Byte-level BPE whose added tokens' strings are plain text."""

    def __init__(self, vocabulary: str):
        self.vocabulary = vocabulary

    def ids(self, text: str) -> np.ndarray:
        return byte_bpe_ids(text, self.vocabulary, added=False)

    @cached_property
    def spelling(self) -> Spelling:
        enc = encoder(self.vocabulary, added=False)
        return Spelling([enc.decode_single_token_bytes(i) for i in range(enc.n_vocab)])


class Pieces:
    """Sentence pieces; a piece's bytes are its text with U+2581 as a space, a byte piece's that byte."""

    def __init__(self, vocabulary: str):
        self.vocabulary = vocabulary

    def ids(self, text: str) -> np.ndarray:
        return np.array(piece_tokenizer(self.vocabulary).encode(text), dtype=np.uint32)

    @cached_property
    def spelling(self) -> Spelling:
        model = piece_tokenizer(self.vocabulary)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        return Spelling([bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])


@cache
def by_name(vocabulary: str) -> ByteBPE | Pieces:
    return Pieces(vocabulary) if vocabulary.endswith(".model") else ByteBPE(vocabulary)
