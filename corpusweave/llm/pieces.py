"""Encoding into SentencePiece ids by a streaming Viterbi search, and decoding."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
# piece types of the model format, fixed values
NORMAL, USER_DEFINED, BYTE = 1, 4, 6
UNKNOWN_PENALTY = 10.0
# positions kept before the search looks for a boundary to commit
LOOK = 64
# stretches whose ids a worker remembers; at the limit it starts afresh
MEMORY = 1_000_000


class PieceModel:
    """Pieces and scores of a model file; encodes to the ids of the best total score.

    Spaces become U+2581 and one stands before the text.  A character that no
    piece covers scores 10 below the worst piece and becomes its bytes.  Of
    equal scores the path whose last piece starts earlier wins.
    """

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as format_

        with open(path, "rb") as file:
            model = format_.ModelProto.FromString(file.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("only models without normalisation and with a leading space are read")
        kinds = {k: [i for i, p in enumerate(model.pieces) if p.type == k] for k in (NORMAL, USER_DEFINED, BYTE)}
        pieces = [p.piece for p in model.pieces]
        scores = [model.pieces[i].score for i in kinds[NORMAL]]
        self.best: dict[str, tuple[float, int]] = {
            pieces[i]: (s, i) for i, s in zip(kinds[NORMAL], scores)
        }
        for i in kinds[USER_DEFINED]:
            self.best[pieces[i]] = (len(pieces[i].encode()) * max(scores) - 0.1, i)
        self.unknown = min(scores) - UNKNOWN_PENALTY
        self.byte_ids = kinds[BYTE]
        self.longest = max(map(len, self.best))
        # every beginning of a piece, the pieces themselves with their score
        self.starts = {p[:k]: (0.0, -1) for p in self.best for k in range(1, len(p))} | self.best
        # no piece has a space after another character: a space after one is a boundary of every path
        self.parted = all(SPACE not in p.lstrip(SPACE) for p in self.best)
        self.bytes_of = [p.encode() for p in pieces]
        for value, i in enumerate(self.byte_ids):
            self.bytes_of[i] = bytes([value])
        for i, p in enumerate(model.pieces):
            if p.type not in kinds:
                self.bytes_of[i] = b""
        self.known: dict[str, bytes] = {}

    def search(self, text: str) -> Iterator[int]:
        """Ids of a stretch, given out as soon as they are certain.

        Only the last ``longest`` positions can still start a piece.  Whenever
        the best paths to all of them pass one boundary, what lies before it is
        final: its ids go out and its memory is let go.
        """
        starts, longest, unknown = self.starts, self.longest, self.unknown
        base, n = 0, len(text)  # all paths pass ``base``
        # of position base + k: best score, where its last piece starts, which piece
        score: list[float | None] = [0.0] + [None] * (n if n <= LOOK else LOOK + 2 * longest)
        back, ids = [0] * len(score), [-1] * len(score)
        for at in range(n):
            k = at - base
            mine, end = score[k], at + 1
            while end <= n:
                found = starts.get(text[at:end])
                if found is None:
                    break
                if found[1] >= 0:
                    total, there = mine + found[0], score[end - base]
                    if there is None or total > there:
                        score[end - base], back[end - base], ids[end - base] = total, at, found[1]
                end += 1
            if text[at] not in self.best:
                total, there = mine + unknown, score[k + 1]
                if there is None or total > there:
                    score[k + 1], back[k + 1], ids[k + 1] = total, at, -1
            end = at + 1
            if end == n or end - base >= LOOK + longest - 1:
                # what can still start a piece, or has been reached ahead
                ahead = range(end, min(n, end + longest - 1) + 1)
                alive = {end} if end == n else {e for e in ahead if score[e - base] is not None}
                while len(alive) > 1:  # step back the farthest until all meet
                    far = max(alive)
                    alive.remove(far)
                    alive.add(back[far - base] if far > base else base)
                common = alive.pop()
                if common > base:
                    yield from self._path(text, base, common, back, ids)
                    cut = common - base
                    score = score[cut:] + [None] * cut
                    back, ids = back[cut:] + [0] * cut, ids[cut:] + [-1] * cut
                    base = common
                elif end < n:  # not yet: look further
                    score += [None] * longest
                    back += [0] * longest
                    ids += [-1] * longest

    def _path(self, text: str, base: int, end: int, back: list[int], ids: list[int]) -> list[int]:
        found: list[int] = []
        while end > base:
            start, piece = back[end - base], ids[end - base]
            if piece >= 0:
                found.append(piece)
            else:
                found += [self.byte_ids[b] for b in reversed(text[start:end].encode())]
            end = start
        return found[::-1]

    def stretches(self, text: str) -> list[str]:
        """Cut before each space that follows another character, where every path has a boundary."""
        whole = SPACE + text.replace(" ", SPACE)
        if not self.parted:
            return [whole]
        cut = whole.split(SPACE)[1:]
        out, run = [], SPACE
        for word in cut[:-1]:
            if word:
                out.append(run + word)
                run = SPACE
            else:
                run += SPACE
        return [*out, run + cut[-1]]

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text; none for a null or empty one."""
        if not text:
            return np.zeros(0, np.int32)
        known, parts = self.known, []
        for stretch in self.stretches(text):
            ids = known.get(stretch)
            if ids is None:
                ids = np.fromiter(self.search(stretch), np.int32).tobytes()
                if len(known) >= MEMORY:
                    known.clear()
                if len(stretch) <= LOOK:
                    known[stretch] = ids
            parts.append(ids)
        return np.frombuffer(b"".join(parts), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, less the space before it."""
        table = self.bytes_of
        text = b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


@cache
def load(path: str) -> PieceModel:
    return PieceModel(path)


def encoded(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """Encode each text and decode it again.

    Returns a row per document: its key, ``n_ids``, ``ids_crc32`` (little-endian
    unsigned 32-bit ids), ``decoded_crc32`` (CRC-32 of the decoded text) and
    ``same`` (decoded text equals the text; only U+2581 in it comes back as a
    space), with ``with_ids`` also ``ids`` and ``decoded``.  Null and empty texts
    have no ids and decode to the empty text.
    """
    schema = f"{key} long, n_ids long, ids_crc32 long, decoded_crc32 long, same boolean"
    schema += ", ids array<int>, decoded string" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in batches:
            rows = []
            for value in batch.column(1):
                source = value.as_py() or ""
                ids = pieces.encode(source)
                decoded = pieces.decode(ids)
                row = (len(ids), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(decoded.encode()))
                rows.append((*row, decoded == source, *((ids, decoded) if with_ids else ())))
            kinds = [pa.int64()] * 3 + [pa.bool_(), pa.list_(pa.int32()), pa.string()][: 3 if with_ids else 1]
            columns = list(zip(*rows)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(list(c), k) for c, k in zip(columns, kinds)]],
                [part.split()[0] for part in schema.split(", ")],
            )

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, schema)
