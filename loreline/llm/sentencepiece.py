"""SentencePiece BPE encoding by each prefix's last token, and decoding."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = "▁"
#: Chunks of text whose ids a worker keeps at most; the dictionary is emptied when full. A worker keeps its table
#: for later stages too, so these add to the memory of every other operator that runs there.
CHUNKS_KEPT = 200_000
PAIRS_KEPT = 300_000
#: Longer chunks are encoded each time.
CHUNK_KEPT_CHARS = 64
#: Chunks looked up at once.
CHUNK_STEP = 50_000


class PieceTable:
    """The pieces of a BPE model, and what is needed to encode with them.

    Greedy merging of the best-scored pair gives a sequence in which every two neighbours are compatible:
    merging their joint text alone gives the same two pieces. Only one last piece of each prefix can be
    reached by compatible pieces, so one is stored for each prefix, and the ids are read off backwards.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        kinds = [(model.is_control(i) or model.is_unknown(i) or model.is_unused(i), model.is_byte(i)) for i in range(size)]
        self.bytes_at = {int(self.pieces[i][3:5], 16): i for i, (_, byte) in enumerate(kinds) if byte}
        self.unknown = model.unk_id()
        self.silent = {i for i in range(size) if model.is_control(i)}
        normal = {p: i for i, (p, (special, byte)) in enumerate(zip(self.pieces, kinds, strict=True)) if not special and not byte}
        #: Merge order: a better score first, then the lower id.
        order = sorted(normal.values(), key=lambda i: (-model.get_score(i), i))
        self.rank = {self.pieces[i]: r for r, i in enumerate(order)}
        self.code = {p: i.to_bytes(4, "little") for p, i in normal.items()}
        self.last: dict[str, tuple[str, str]] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        whole = [p for p in normal if len(p) > 1 and self.merged(p) == (p,)]
        #: Holds for trained models: a piece is merged from pieces of better rank.
        self.ordered = all(self.rank.get(x, -1) < self.rank[p] or len(x) == 1 for p in whole for x in self.last[p])
        self.right = {p: self.spine(p, 1) for p in whole}
        self.left = {p: self.spine(p, 0) for p in whole}
        self.automaton = ahocorasick.Automaton()
        for piece in whole:
            self.automaton.add_word(piece, (piece, len(piece)))
        self.automaton.make_automaton()
        inner = [p for p in normal if SPACE in p[1:] and p.strip(SPACE)]
        self.chunk = None if inner else re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        #: Ids, as 32-bit little-endian bytes, of chunks and of words without their space.
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        #: Bytes of each piece when decoding.
        self.raw = [b"" if i in self.silent else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.raw[self.unknown] = " ⁇ ".encode()
        for byte, i in self.bytes_at.items():
            self.raw[i] = bytes([byte])

    def merged(self, text: str) -> tuple[str, ...]:
        """Pieces of a short text by merging itself; used for pieces and pairs of pieces only."""
        symbols, rank = list(text), self.rank
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda i: (rank.get(symbols[i] + symbols[i + 1], len(rank)), i))
            pair = symbols[best] + symbols[best + 1]
            if pair not in rank:
                break
            self.last[pair] = (symbols[best], symbols[best + 1])
            symbols[best : best + 2] = [pair]
        return tuple(symbols)

    def spine(self, piece: str, side: int) -> list[tuple[str, int, float]]:
        """The symbols at one edge of a piece while it is merged: symbol, rank from which, rank up to which it stands."""
        out, until = [], float("inf")
        while True:
            since = self.rank.get(piece, -1) if len(piece) > 1 else -1
            out.append((piece, since, until))
            if len(piece) == 1:
                return out
            until = since
            piece = self.last[piece][side]

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging the joint text gives the two pieces: no merge across the border comes first."""
        if not self.ordered:
            return self.merged(left + right) == (left, right)
        rank = self.rank
        heads = self.left.get(right) or ((right, -1, float("inf")),)
        for x, since_x, until_x in self.right.get(left) or ((left, -1, float("inf")),):
            for y, since_y, until_y in heads:
                if since_y < until_x and since_x < until_y:
                    across = rank.get(x + y)
                    # Of equal merges the leftmost is done first.
                    if across is not None and across < until_x and across <= until_y:
                        return False
        return True

    def chunk_ids(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks that no piece joins when they stand one after the other, found in one pass."""
        text = "".join(chunks)
        last, fits, solved = list(text), self.fits, -1
        for end, (piece, length) in self.automaton.iter(text):
            if end == solved:
                continue
            # Nothing joins a space to what stands before it but spaces.
            if length <= end and (piece[0] != SPACE or text[end - length] == SPACE or self.chunk is None):
                pair = (last[end - length], piece)
                fit = fits.get(pair)
                if fit is None:
                    if len(fits) >= PAIRS_KEPT:
                        fits.clear()
                    fit = fits[pair] = self.compatible(*pair)
                if not fit:
                    continue
            last[end], solved = piece, end
        code = self.code
        found: list[bytes] = []
        at = len(text) - 1
        for chunk in reversed(chunks):
            start, out = at - len(chunk), []
            while at > start:
                piece = last[at]
                out.append(code.get(piece) or self.spelled(piece))
                at -= len(piece)
            out.reverse()
            found.append(b"".join(out))
        found.reverse()
        return found

    def spelled(self, char: str) -> bytes:
        """Ids of a character that is no piece: its bytes, or the unknown id."""
        if not self.bytes_at:
            return self.unknown.to_bytes(4, "little")
        return b"".join(self.bytes_at[b].to_bytes(4, "little") for b in char.encode("utf-8", "surrogatepass"))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text as the library gives them, without begin and end marks; none for an empty text.

        No piece but runs of spaces goes beyond a space, so ids of chunks between spaces are kept and joined.
        """
        if not text:
            return np.zeros(0, dtype=np.int32)
        if self.chunk and text[0] != " " and text[-1] != " " and "  " not in text and SPACE not in text:
            chunks, known, lead = text.split(" "), self.words, SPACE
        else:
            text = SPACE + text.replace(" ", SPACE)
            chunks, known, lead = self.chunk.findall(text) if self.chunk else [text], self.known, ""
        out = []
        for i in range(0, len(chunks), CHUNK_STEP):
            step = chunks[i : i + CHUNK_STEP]
            missing = set(step).difference(known)
            if len(known) + len(missing) > CHUNKS_KEPT:
                known.clear()
                missing = set(step)
            # Only the last chunk of a text can end with a space; it comes last, where nothing follows it.
            missing = sorted(missing, key=lambda c: c.endswith(SPACE))
            if missing:
                known.update(zip(missing, self.chunk_ids([lead + c for c in missing] if lead else missing), strict=True))
            out.append(b"".join(map(known.__getitem__, step)))
            for c in missing:
                if len(c) > CHUNK_KEPT_CHARS:
                    del known[c]
        return np.frombuffer(b"".join(out), dtype="<i4")

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: pieces joined, the added space dropped, byte pieces read as UTF-8.

        Bytes that are no UTF-8 become U+FFFD one by one; control pieces are silent, the unknown piece
        shows as the library shows it. Whole pieces never start inside a character, so runs of bytes need
        no care of their own.
        """
        listed = ids.tolist()
        text = lenient(b"".join(map(self.raw.__getitem__, listed)))
        first = next((i for i in listed if i not in self.silent), None)
        return text[1:] if first is not None and self.pieces[first].startswith(SPACE) else text


def lenient(data: bytes) -> str:
    """UTF-8 with each byte that fits no character as U+FFFD."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        return re.sub("[\udc80-\udcff]", "\ufffd", data.decode("utf-8", "surrogateescape"))


@lru_cache(maxsize=2)
def pieces(path: str) -> PieceTable:
    return PieceTable(path)


def listed(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays], dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.int32)))


def _text(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def encode(text: str | Column, path: str) -> Column:
    """Ids (array of int) of each text, by the model file at `path`; a null text counts as empty."""

    @F.arrow_udf("array<int>")
    def ids_of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = pieces(path)
        for batch in texts:
            yield listed([table.encode(t) for t in batch.to_pylist()])

    return ids_of(_text(text))


def decode(ids: str | Column, path: str) -> Column:
    """Text of each array of ids; null for null."""

    @F.arrow_udf("string")
    def text_of(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = pieces(path)
        for batch in arrays:
            yield pa.array([None if a is None else table.decode(np.array(a, dtype=np.int32)) for a in batch.to_pylist()], pa.string())

    return text_of(F.col(ids) if isinstance(ids, str) else ids)


def round_trip(text: str | Column, path: str) -> Column:
    """Struct of `ids` and of the text `decoded` from them, in one pass through Python."""

    @F.arrow_udf("struct<ids array<int>, decoded string>")
    def both(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = pieces(path)
        for batch in texts:
            ids = [table.encode(t) for t in batch.to_pylist()]
            yield pa.StructArray.from_arrays([listed(ids), pa.array([table.decode(x) for x in ids], pa.string())], ["ids", "decoded"])

    # Several columns are made from the struct; this keeps it from being computed for each.
    return both.asNondeterministic()(_text(text))
