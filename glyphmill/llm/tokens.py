"""Public tokenizers, loaded once per Python worker."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np

from .common import vocabulary_path

#: Fixed value: the published pre-token pattern of the 50k byte-level vocabulary.
BYTE_BPE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Fixed value: the added token of the 50k vocabulary, which its JSON file finds in plain text too.
END_OF_TEXT, END_OF_TEXT_ID = "<|endoftext|>", 50256


@lru_cache(maxsize=4)
def byte_bpe(folder: str | None = None):
    """The 50k byte-level BPE. With ``allowed_special="all"`` the same ids as the JSON file of the vocabulary.

    The ranks file holds the same vocabulary as ``byte_bpe_50k.json``; a test
    compares the ids with those of the ``tokenizers`` library. That library
    encodes 2.3 MB a second and core here, this encoder 12.
    """
    import tiktoken

    with open(vocabulary_path("byte_bpe_50k.tiktoken", folder), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=BYTE_BPE_PATTERN, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: END_OF_TEXT_ID})


@lru_cache(maxsize=2)
def piece_bpe(folder: str | None = None):
    """The 32k piece vocabulary with byte fallback."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model", folder))


@lru_cache(maxsize=2)
def piece_chars(folder: str | None = None) -> frozenset[str]:
    """Characters that the piece vocabulary holds; any other falls back to its bytes."""
    model = piece_bpe(folder)
    return frozenset(p for i in range(model.get_piece_size()) if len(p := model.id_to_piece(i)) == 1 and not model.is_byte(i)) | {" "}


@lru_cache(maxsize=2)
def piece_bytes(folder: str | None = None) -> np.ndarray:
    """For each id of the piece vocabulary, whether it stands for one byte."""
    model = piece_bpe(folder)
    return np.array([model.is_byte(i) for i in range(model.get_piece_size())], bool)


#: Blanks and the word behind them; none of its own tokens goes on into the next.
_CHUNK = r" +[^ \n]*|[^ \n]+"
_FOREIGN = re.compile(r" *[^ \n]*[^\x00-\x7F \n][^ \n]*")


class PieceCounts:
    """Tokens of the piece vocabulary in a text, and how many of them are bytes.

    No piece goes on behind a word into the next blank, and none holds a line
    break (tested when the vocabulary is loaded), so no merge crosses from one
    chunk, blanks and the word behind them, into another: the counts of a text
    are the sums over its chunks and line breaks, exactly. In ASCII chunks a
    character is a byte, and the merges by score are those of a byte-level
    encoder with the pieces in order of score, which is the faster one; chunks
    with other characters go to the vocabulary's own library. Tests compare the
    counts with those of the library on whole texts.
    """

    def __init__(self, folder: str | None = None) -> None:
        import tiktoken

        self.model, self.is_byte, self.chars = piece_bpe(folder), piece_bytes(folder), piece_chars(folder)
        model = self.model
        pieces = [(model.get_score(i), model.id_to_piece(i).replace("\u2581", " ")) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.splits = not any("\n" in p or " " in p.lstrip(" ") for _, p in pieces)
        ranks = {p.encode(): k for k, (_, p) in enumerate(sorted(((s, p) for s, p in pieces if p.isascii()), key=lambda x: -x[0]))}
        for b in range(256):
            ranks.setdefault(bytes([b]), len(ranks))
        self.ascii = tiktoken.Encoding("ascii_pieces", pat_str=_CHUNK + r"|\n", mergeable_ranks=ranks, special_tokens={})
        self.rare = [c for c in map(chr, range(128)) if c not in self.chars]  # line break included

    def _library(self, text: str) -> tuple[int, int]:
        ids = np.array(self.model.encode(text), np.int64)
        return len(ids), int(np.count_nonzero(self.is_byte[ids]))

    def count(self, text: str) -> tuple[int, int]:
        """(tokens, tokens that are bytes) of a text that is not empty."""
        if not self.splits:
            return self._library(text)
        text = " " + text.replace("\u2581", " ")  # the model puts a blank first, and reads this sign as one
        tokens = of_bytes = 0
        if not text.isascii():
            foreign = _FOREIGN.findall(text)
            text = _FOREIGN.sub("", text)
            tokens, of_bytes = self._library("\n" + "\n".join(foreign))
            tokens, of_bytes = tokens - 1 - len(foreign), of_bytes - len(foreign)  # less the blank put first and the breaks
        return tokens + len(self.ascii.encode_to_numpy(text)), of_bytes + sum(map(text.count, self.rare))


@lru_cache(maxsize=2)
def piece_counts(folder: str | None = None) -> PieceCounts:
    """The counts of the 32k piece vocabulary, loaded once per worker."""
    return PieceCounts(folder)
