"""Token ids of whole texts, by way of a memory of the chunks seen before.

A tokenizer that splits at white space gives a text's ids as the ids of its
chunks one after another.  Chunks repeat, so each worker keeps the ids of those
it has met, as ready bytes, and gives the tokenizer's library only new ones, in
batches.  The memory is emptied when it grows beyond ``MEMORY`` chunks.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Callable, Iterable, Sequence
from functools import lru_cache

import numpy as np

MEMORY = 250_000
LONG = 256  # longer chunks are not remembered
SPAN = 256  # texts handled at once


class Memory:
    """Joins the ids of chunks; ``encode`` gives the ids of a list of new chunks."""

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]], marks: str = "") -> None:
        self.encode = encode
        self.marks = marks  # a chunk's trailing run of these, after a letter or digit, is encoded apart
        self.known: dict[str, bytes] = {"": b""}

    def join(self, texts: list[list[str]]) -> list[bytes]:
        new = set().union(*texts) - self.known.keys()
        if len(self.known) + len(new) > MEMORY:
            self.known = {"": b""}
            new = set().union(*texts) - self.known.keys()
        ended: list[tuple[str, str]] = []
        if self.marks:
            ended = [(chunk, core) for chunk in new if (core := chunk.rstrip(self.marks)) and len(core) < len(chunk) and core[-1].isalnum()]
            new -= {chunk for chunk, _ in ended}
            new |= {core for _, core in ended} | {chunk[len(core) :] for chunk, core in ended}
            new -= self.known.keys()
        fresh = sorted(new)
        self.known.update(zip(fresh, self.encode(fresh), strict=True))
        find = self.known.__getitem__
        for chunk, core in ended:
            self.known[chunk] = find(core) + find(chunk[len(core) :])
        joined = [b"".join(map(find, chunks)) for chunks in texts]
        for chunk in (*fresh, *(c for c, _ in ended)):
            if len(chunk) > LONG:
                del self.known[chunk]
        return joined


def packed_ids(ids: Sequence[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=4)
def _library(path: str, plain_specials: bool):  # noqa: ANN202
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = plain_specials
    return made


def _word_encoder(path: str, plain_specials: bool, edge: str, first: bool) -> Callable[[list[str]], Iterable[bytes]]:
    """For a tokenizer whose words begin (``first``) or end with tokens that carry ``edge``.

    Words of letters only go to the library in one string, and their ids are
    told apart at those tokens.  If that doesn't give as many parts as words,
    and for other chunks, each goes by itself.
    """
    library, plain = _library(path, plain_specials), _batch_encoder(path, plain_specials)
    edges = np.zeros(library.get_vocab_size(), bool)
    edges[[i for token, i in library.get_vocab().items() if (token.startswith(edge) if first else token.endswith(edge))]] = True

    def simple(chunk: str) -> bool:
        return chunk[:1] == " " and chunk[1:].isalpha() if first else chunk.isalpha()

    def encode(chunks: list[str]) -> Iterable[bytes]:
        words = [c for c in chunks if simple(c)]
        text = "".join(words) if first else " ".join(words)
        ids = np.array(library.encode(text, add_special_tokens=False).ids if words else [], "<u4")
        at = np.flatnonzero(edges[ids])
        if len(at) != len(words) or (first and len(at) and at[0]):
            return plain(chunks)
        cuts = 4 * (np.append(at, len(ids)) if first else np.append(0, at + 1))
        raw = ids.tobytes()
        parts = iter([raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)])
        others = iter(plain([c for c in chunks if not simple(c)]))
        return [next(parts) if simple(c) else next(others) for c in chunks]

    return encode


def _batch_encoder(path: str, plain_specials: bool) -> Callable[[list[str]], Iterable[bytes]]:
    library = _library(path, plain_specials)

    def encode(chunks: list[str]) -> Iterable[bytes]:
        return [packed_ids(e.ids) for e in library.encode_batch_fast(chunks, add_special_tokens=False)] if chunks else []

    return encode


@lru_cache(maxsize=4)
def spaceless_encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """For a lower-casing tokenizer that drops white space: texts are cut at spaces and line ends.

    Such cuts lie between the tokenizer's own words, and so does the place where
    letters or digits end and marks begin; the ids are those of the whole text.
    A-Z are folded first, but for texts that might hold a special token's
    string, which is told apart by case and becomes its id, as the library does
    by default.
    """
    memory = Memory(_word_encoder(path, False, "</w>", False), marks=".,;:!?#$%&*")

    def folded(text: str) -> str:
        return text if "<|" in text else text.encode().lower().decode()

    def encode(texts: list[str]) -> list[bytes]:
        return memory.join([folded(t).replace("\n", " ").split(" ") for t in texts])

    return encode


@lru_cache(maxsize=4)
def spaced_encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """For a byte-level tokenizer whose words begin with their space.

    A single space between two other characters begins a word, a single line
    end between two others is a word, and marks after a letter or digit are
    words of their own; texts are cut there.  Texts with other arrangements of
    spaces go to the library whole.
    """
    memory = Memory(_word_encoder(path, True, "Ġ", True), marks=".,;:!?#$%&*")

    def chunks(text: str) -> list[str]:
        if "  " in text or text[:1] == " " or text[-1:] == " " or "\x00" in text:
            return [text]
        if "\n\n" in text or "\n " in text or " \n" in text or "\r" in text or "\t" in text or not text.isprintable() and any(c.isspace() and c not in " \n" for c in set(text)):
            return text.replace(" ", "\x00 ").split("\x00")
        return text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00")

    def encode(texts: list[str]) -> list[bytes]:
        return memory.join([chunks(t) for t in texts])

    return encode
