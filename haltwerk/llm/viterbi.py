"""SentencePiece encoding by a streaming Viterbi search, and decoding.

The best segmentation of a text maximises the sum of piece scores.  The search
goes from left to right and keeps, for each place that a later piece may still
begin at, the best score and the piece that ends there: a window no longer than
the longest piece.  Ids are committed whenever the back pointers of all places
in the window lead to one boundary; what lies before it is final, whatever
follows, and is forgotten.  A text of any length thus needs the memory of a
window, and nothing is cut.

Spaces are written as U+2581, with one put before a text that isn't empty.  A
character that no piece covers is a piece of its own, worse than any, and is
written as its bytes.  At equal scores the longer last piece wins.

A word boundary before a space after another character is such a boundary in
every context if no piece spans it, which is checked when a model is loaded.
The encoder uses that to remember the ids of words it has met before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haltwerk.llm.chunked import SPAN, Memory, packed_ids
from haltwerk.llm.words import texts_of

SPACE = "▁"
UNKNOWN_PENALTY = 10.0


class Pieces:
    """Pieces of a model file with their scores, as a tree of characters."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text: list[str | None] = []
        self.bytes: dict[int, int] = {}
        self.byte_id: dict[int, int] = {}
        self.unknown = model.unk_id()
        self.tree: dict = {}
        low = 0.0
        scored = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes[i] = int(piece[3:5], 16)
                self.text.append(None)
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.text.append("")
            else:
                self.text.append(piece)
                scored.append((piece, model.get_score(i), i))
                low = min(low, model.get_score(i))
        self.longest = max((len(p) for p, _, _ in scored), default=1)
        self.unknown_score = low - UNKNOWN_PENALTY
        for piece, score, i in scored:
            node = self.tree
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = (score, i)
        self.steps = self._compact(self.tree)
        self.alone = {p for p, _, _ in scored if len(p) == 1}
        #: no piece has a space after another character, so words are searched apart
        self.words_apart = not any(SPACE in p.lstrip(SPACE) for p, _, _ in scored)

    def _compact(self, node: dict) -> dict:
        """The tree with one look-up a character: the tree below it, score and id of the piece it ends (None: no piece)."""
        return {c: (self._compact(below), *below.get("", (None, -1))) for c, below in node.items() if c}


class Search:
    """A streaming search: ``feed`` characters, take committed ids, ``end``."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self.text = ""  # from the last committed boundary on
        self.done = 0  # places in ``text`` whose pieces have been tried
        self.best: list[tuple[float, int, int]] = [(0.0, 0, -1)]  # per place: score, length and id of the last piece
        self.widest = 0  # most characters ever held, for the record

    def feed(self, text: str) -> list[int]:
        """Take more text; ids that became final."""
        out: list[int] = []
        step = 4 * self.pieces.longest
        for i in range(0, len(text), step):
            self.text += text[i : i + step]
            self.widest = max(self.widest, len(self.text))
            if len(self.text) - self.pieces.longest > self.done:
                self._advance(len(self.text) - self.pieces.longest)
                out += self._commit(self._meeting())
        return out

    def end(self) -> list[int]:
        """Finish the text; the remaining ids."""
        self._advance(len(self.text))
        return self._commit(len(self.text))

    def _advance(self, until: int) -> None:
        """Try the pieces that begin before ``until``; of equal scores the first found, which has the longest last piece, stays."""
        text, best, steps, alone = self.text, self.best, self.pieces.steps, self.pieces.alone
        n = len(text)
        best += [(-1e300, 0, -1)] * (n + 1 - len(best))
        unknown = self.pieces.unknown_score
        for i in range(self.done, until):
            here = best[i][0]
            if here <= -1e300:
                continue
            node, j = steps, i
            while j < n and text[j] in node:
                node, score, piece = node[text[j]]
                j += 1
                if score is not None and here + score > best[j][0]:
                    best[j] = (here + score, j - i, piece)
            if text[i] not in alone and here + unknown > best[i + 1][0]:
                best[i + 1] = (here + unknown, 1, -1)
        self.done = max(self.done, until)

    def _meeting(self) -> int:
        """The last boundary on the paths of all places that later pieces may start from."""
        live = [k for k in range(max(self.done, 0), len(self.best)) if self.best[k][1]]
        if self.done <= 0 or not live:
            return 0
        live.append(self.done) if self.best[self.done][1] and self.done not in live else None
        places = set(live)
        while len(places) > 1:
            last = max(places)
            places.discard(last)
            places.add(last - self.best[last][1])
        return places.pop()

    def _commit(self, boundary: int) -> list[int]:
        """Ids up to a boundary, which becomes the new beginning."""
        if boundary <= 0:
            return []
        out: list[int] = []
        at = boundary
        while at:
            _, length, piece = self.best[at]
            if piece >= 0:
                out.append(piece)
            else:
                raw = self.text[at - 1].encode()
                ids = [self.pieces.byte_id.get(b, self.pieces.unknown) for b in reversed(raw)]
                out += ids if self.pieces.byte_id else [self.pieces.unknown]
            at -= length
        base = self.best[boundary][0]
        self.text = self.text[boundary:]
        self.best = [(s - base if s > -1e300 else s, n, p) for s, n, p in self.best[boundary:]]
        self.best[0] = (0.0, 0, -1)
        self.done = max(self.done - boundary, 0)
        return out[::-1]


def search(pieces: Pieces, text: str) -> list[int]:
    """Ids of a string in which spaces are already written as U+2581."""
    run = Search(pieces)
    return run.feed(text) + run.end()


@lru_cache(maxsize=2)
def loaded(path: str) -> Pieces:
    return Pieces(path)


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """Ids of texts as little-endian 32-bit numbers."""
    pieces = loaded(path)
    memory = Memory(lambda new: [packed_ids(search(pieces, chunk)) for chunk in new])

    def chunks(text: str) -> list[str]:
        if not text:
            return []
        marked = SPACE + text.replace(" ", SPACE)
        if not pieces.words_apart or "  " in text or text[0] == " " or SPACE in text or "\x00" in text:
            return [marked]
        return marked.replace(SPACE, "\x00" + SPACE)[1:].split("\x00")

    def encode(texts: list[str]) -> list[bytes]:
        return memory.join([chunks(t) for t in texts])

    return encode


@lru_cache(maxsize=2)
def decoder(path: str) -> Callable[[bytes], str]:
    """Text of ids: pieces joined, runs of byte ids as UTF-8, the first space dropped."""
    pieces = loaded(path)
    raw = [bytes([pieces.bytes[i]]) if i in pieces.bytes else (p or "").replace(SPACE, " ").encode() for i, p in enumerate(pieces.text)]

    def decode(ids: bytes) -> str:
        text = b"".join(map(raw.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    return decode


def encoded(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, ids, n_tokens, and whether decoding the ids gives the text back, for every whole text.

    NULL text counts as empty and has no ids.  U+2581 in a text is read as a
    space, as the model's alphabet has no other sign for it; such texts, and no
    others, do not come back unchanged.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, decode = encoder(path), decoder(path)
        for batch in batches:
            texts = texts_of(batch)
            for a in range(0, batch.num_rows, SPAN):
                part = texts[a : a + SPAN].to_pylist()
                ids = encode(part)
                same = [decode(i) == t for i, t in zip(ids, part, strict=True)]
                offsets = np.concatenate(([0], np.cumsum([len(i) // 4 for i in ids])))
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a : a + SPAN], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values), pa.array(np.diff(offsets)), pa.array(same, pa.bool_())],
                    names=["doc_id", "ids", "n_tokens", "same"],
                )

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, n_tokens bigint, same boolean")
