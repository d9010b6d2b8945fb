"""Byte-level BPE as a lazily determinised finite-state transducer.

Merging by rank gives every prefix of a piece one last token, and a token may
follow another exactly when encoding their joined bytes gives the two back.  So
encoding is a walk over bytes.  A state holds what later bytes can still depend
on: the longest input suffix that begins some token (bounded by the longest
token, which bounds the lookahead) and the last token at each boundary inside it
from which a token may still grow.  A transition reads one byte and names the
last token there; tokens that all live boundaries share are emitted.  States
and transitions are made when first needed and dropped all together when there
are too many, which changes no output.

Pieces come from the tokenizer's splitting pattern; the transducer starts anew
for each.  Decoding maps ids to bytes and turns them into text by a UTF-8 state
machine that keeps an incomplete sequence until its next bytes come.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaussmill.llm.common import col, map_batches, slices, text_of, worker_cached

MOST_STATES, MOST_PIECES, HOLD, NONE = 200_000, 400_000, 4096, 1 << 60


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes and ranks of a file with a base64 token and a rank in each line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class Transducer:
    """Encodes one piece of bytes at a time.

    A state is the live boundaries: distances back to positions from which some
    token could still reach beyond the last byte, each with the last token
    there.  The end of the input is always live.
    """

    def __init__(self, ranks: dict[bytes, int], most_states: int = MOST_STATES, hold: int = HOLD):
        self.ranks, self.most_states, self.hold = ranks, most_states, hold
        self.token = {i: t for t, i in ranks.items()}
        self.length = {i: len(t) for t, i in ranks.items()}
        self.prefixes = {t[:n] for t in ranks for n in range(1, len(t))}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        self.number: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: list[dict[int, tuple[int, int]]] = []
        self.start = self._state((b"", ((0, None),)))

    def _state(self, state: tuple) -> int:
        at = self.number.get(state)
        if at is None:
            at = self.number[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
        return at

    def merged(self, piece: bytes) -> list[int]:
        """The definition: merge the adjacent pair of lowest rank, the leftmost of equals, until none is left."""
        get, parts = self.ranks.get, [piece[i : i + 1] for i in range(len(piece))]
        found = [get(a + b, NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while found and (rank := min(found)) != NONE:
            at = found.index(rank)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del found[at]
            if at:
                found[at - 1] = get(parts[at - 1] + parts[at], NONE)
            if at < len(found):
                found[at] = get(parts[at] + parts[at + 1], NONE)
        return [self.ranks[p] for p in parts]

    def _may_follow(self, last: int | None, token: int) -> bool:
        if token not in self.whole:
            self.whole[token] = self.merged(self.token[token]) == [token]
        if last is None or not self.whole[token]:
            return self.whole[token]
        known = self.pairs.get((last, token))
        if known is None:
            both = self.token[last] + self.token[token]
            if len(self.pairs) > 4 * self.most_states:
                self.pairs.clear()
            known = self.pairs[last, token] = both not in self.ranks and self.merged(both) == [last, token]
        return known

    def _move(self, state: int, byte: int) -> tuple[int, int]:
        """The next state, and the last token of the input up to this byte."""
        tail, live = self.states[state]
        tail += bytes([byte])
        for back, last in live:  # the longest token first
            token = self.ranks.get(tail[len(tail) - back - 1 :])
            if token is not None and self._may_follow(last, token):
                break
        else:
            raise ValueError("the ranks lack a single byte")
        kept = tuple((back + 1, last) for back, last in live if tail[len(tail) - back - 1 :] in self.prefixes)
        longest = kept[0][0] if kept else 0
        move = self.moves[state][byte] = self._state((tail[len(tail) - longest :], (*kept, (0, token)))), token
        return move

    def _emitted(self, lasts: list[int], live: tuple) -> list[int]:
        """Take from `lasts` the tokens that all live boundaries share."""
        ends = {len(lasts) - back for back, _ in live}
        while len(ends) > 1:  # step back from the furthest until the paths meet
            end = max(ends)
            ends.discard(end)
            ends.add(end - self.length[lasts[end - 1]])
        end = final = ends.pop()
        out = []
        while end:
            out.append(lasts[end - 1])
            end -= self.length[lasts[end - 1]]
        del lasts[:final]
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        if piece in self.ranks:  # a piece that is a token stands for itself
            return [self.ranks[piece]]
        if len(self.states) > self.most_states:
            self.reset()
        state, moves, lasts, out = self.start, self.moves, [], []
        for byte in piece:
            move = moves[state].get(byte) or self._move(state, byte)
            state = move[0]
            lasts.append(move[1])
            if len(lasts) > self.hold:
                out += self._emitted(lasts, self.states[state][1])
        return out + self._emitted(lasts, ((0, None),))


class Encoder(dict):
    """Texts to packed ids (little-endian unsigned 32-bit).  As a dict it keeps the output of pieces already seen."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.transducer, self.split = Transducer(ranks), regex.compile(pattern).findall

    def __missing__(self, piece: str) -> bytes:
        ids = self.transducer.encode(piece.encode("utf-8"))
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        if len(self) > MOST_PIECES:
            self.clear()
        if len(piece) < 64:
            self[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text)))


class Utf8Machine:
    """Incremental UTF-8 decoding.  The state is the unfinished sequence at the end of what came so far."""

    def __init__(self) -> None:
        self.pending = b""

    def push(self, data: bytes) -> str:
        """Text of all sequences that are complete now; bytes that can't be UTF-8 become U+FFFD."""
        data = self.pending + data
        keep = 0
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 != 0x80:  # the last lead byte: is its sequence finished?
                need = 2 if lead >> 5 == 0b110 else 3 if lead >> 4 == 0b1110 else 4 if lead >> 3 == 0b11110 else 1
                keep = back if need > back else 0
                break
        cut = len(data) - keep
        self.pending = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.pending = self.pending, b""
        return rest.decode("utf-8", "replace")


class Decoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.token = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.token[i] = token

    def bytes_of(self, packed: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, memoryview(packed).cast("I")))

    def stream(self, packed: bytes, step: int = 1 << 16) -> Iterator[str]:
        """Text of the ids, piece by piece: `step` ids at a time."""
        machine = Utf8Machine()
        for start in range(0, len(packed), 4 * step):
            yield machine.push(self.bytes_of(packed[start : start + 4 * step]))
        yield machine.finish()


def _coders(name: str, pattern: str) -> tuple[Encoder, Decoder]:
    """From the file that Spark ships to every executor."""
    with open(SparkFiles.get(name), "rb") as f:
        ranks = read_ranks(f.read())
    return Encoder(ranks, pattern), Decoder(ranks)


def _shipped(df: DataFrame, path: str) -> str:
    df.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (packed), decoded (text of the ids, in UTF-8).

    No special tokens.  A null or empty text has no ids.  Ids may be null or
    repeat.  The vocabulary file is shipped with the job, texts are coded whole
    and rows stay where they are: there is no shuffle.
    """
    name = _shipped(docs, ranks_path)
    rows = docs.select(col(doc_id).alias("doc_id"), text_of(text).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = worker_cached((name, pattern), lambda: _coders(name, pattern))
        for batch in batches:
            for part in slices(batch, 1):
                ids = [encoder.encode(t) for t in part.column(1).to_pylist()]
                texts = ["".join(decoder.stream(x)) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return map_batches(rows, work, f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens long, ids binary, decoded string")


def round_trip_report(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    coded = encode_decode(docs, ranks_path, pattern)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
