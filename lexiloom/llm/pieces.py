"""Encoding with a SentencePiece merge model by backtracking, and decoding.

A merge model joins, of all neighbours whose union is a piece, the pair with the
best score, the leftmost first, until no pair is left. A sequence of pieces is what
that gives for a text if and only if every piece comes out of merging its own text
and every two neighbours come out of merging theirs: merges inside a piece never
look beyond it, and the first merge over a border would show in the two pieces
beside that border. So no text is merged as a whole. An Aho-Corasick automaton over
the reversed pieces gives the longest piece that starts at each place; from left to
right the longest is tried, then the pieces that are its beginnings, each checked
against the piece before by merging the two texts again (the answers are kept). If
none fits, the last piece is taken back; a bitfield of the places that were given up
keeps every place from being left twice in vain, so the time is linear in the text.

Characters that no piece has are symbols of their own and end as their bytes.
No piece has a blank behind another character, so a text may be cut before such
blanks, and each distinct chunk of a slice is encoded once.

Defined results: a null or empty text has the end id alone; rows are encoded one by
one, whatever their ids; an empty table gives no rows; other columns stay.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from . import kernels as K

BLANK = "▁"
#: Stands for the piece before the first, and for the rank of a pair that is no piece.
START, NEVER = -1 << 30, float("inf")
#: Entries of the caches of a worker: chunks with their ids, and pairs that were merged again.
CACHED = 1 << 18
#: Fixed text: what normalisation other than blanks would change.
PROBE = "  ﬁ Ａ é é ½\t\n\r 　x​ ~  ｱﾞ  "


class PieceModel:
    """A merge model's pieces. Raises on models of other kinds or with a normalisation of their own."""

    def __init__(self, path: str):
        import ahocorasick

        self.processor = model = processor(path)
        if model.normalize(PROBE) != BLANK + PROBE.replace(" ", BLANK):
            raise ValueError("only models without normalisation, with a blank put before the text, are supported")
        self.text, self.rank, self.bytes = {}, {}, {}
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif model.is_unused(i):
                raise ValueError("models with unused pieces aren't supported")
            elif not (model.is_control(i) or model.is_unknown(i)):
                self.text[i] = piece
                self.rank[piece] = -model.get_score(i)
        if len(self.bytes) < 256:
            raise ValueError("only models with a piece for each byte are supported")
        self.id = {piece: i for i, piece in self.text.items()}
        self.end = model.eos_id()
        # characters of longer pieces are numbered; beside[a, b]: whether some piece has them side by side
        alphabet = sorted({c for piece in self.id if len(piece) > 1 for c in piece})
        self.number = np.zeros(0x110000, np.uint16)
        self.number[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.number[32] = self.number[ord(BLANK)]
        self.beside = np.zeros((len(alphabet) + 1,) * 2, bool)
        for piece in self.id:
            own = self.number[[ord(c) for c in piece]]
            self.beside[own[:-1], own[1:]] = True
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, piece in self.text.items():
            self.automaton.add_word(piece[::-1], i)
        self.automaton.make_automaton()
        #: For each piece the pieces that are its beginnings, from the longest, itself included, with their lengths.
        self.tries: dict[int, tuple[tuple[int, int], ...]] = {}
        for i, piece in self.text.items():
            begins = [(own, k) for k in range(len(piece), 0, -1) if (own := self.id.get(piece[:k])) is not None]
            self.tries[i] = tuple(begins if begins[-1][1] == 1 else [*begins, (self._single(piece[0]), 1)])
        self.steps: dict[int, tuple[tuple, tuple, tuple] | None] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[bytes, tuple[int, ...]] = {}

    def _single(self, char: str) -> int:
        """The id of a character; one that is no piece has a negative one."""
        return self.id.get(char, -1 - ord(char))

    def _text(self, i: int) -> str:
        return self.text[i] if i >= 0 else chr(-1 - i)

    def merges(self, i: int) -> tuple[tuple, tuple, tuple] | None:
        """What merging a piece's text goes through: the rank of each next merge (NEVER at the end), and the first and the last symbol before it. None where it doesn't give the piece."""
        if i not in self.steps:
            rank, symbols = self.rank, list(self._text(i))
            costs = [rank.get(a + b, NEVER) for a, b in zip(symbols, symbols[1:])]
            ranks, firsts, lasts = [], [], []
            while True:
                least = min(costs, default=NEVER)
                ranks.append(least)
                firsts.append(symbols[0])
                lasts.append(symbols[-1])
                if least == NEVER:
                    break
                k = costs.index(least)  # the leftmost
                own = symbols[k] + symbols.pop(k + 1)
                own = symbols[k] = self.text[self.id[own]]  # not one more string for each
                del costs[k]
                if k:
                    costs[k - 1] = rank.get(symbols[k - 1] + own, NEVER)
                if k < len(costs):
                    costs[k] = rank.get(own + symbols[k + 1], NEVER)
            self.steps[i] = (tuple(ranks), tuple(firsts), tuple(lasts)) if len(symbols) == 1 else None
        return self.steps[i]

    def _apart(self, before: int, piece: int) -> bool:
        """Whether merging the texts of both in a row gives the two: no merge over the border comes before those on its sides.

        Each side goes through what it goes through alone, the lower rank first, the left one of equal ranks.
        """
        one, two = self.merges(before), self.merges(piece)
        if one is None or two is None:
            return False
        (left, _, lasts), (right, firsts, _), over = one, two, self.rank.get
        x = y = 0
        while True:
            own, a, b = over(lasts[x] + firsts[y], NEVER), left[x], right[y]
            if own < a and own <= b and own != NEVER:
                return False
            if a <= b:
                if a == NEVER:
                    return True
                x += 1
            else:
                y += 1

    def compatible(self, before: int, piece: int) -> bool:
        """Whether the two come out of merging their texts; before is START at the start of a text."""
        key = (before, piece)
        own = self.fits.get(key)
        if own is None:
            if len(self.fits) >= CACHED:
                self.fits.clear()
            own = self.fits[key] = self.merges(piece) is not None if before == START else self._apart(before, piece)
        return own

    def longest(self, text: str) -> list[int]:
        """For every place the longest piece that starts there, else the character."""
        n = len(text) - 1
        out = [None] * (n + 1)
        for end, i in self.automaton.iter(text[::-1]):
            if out[n - end] is None:  # the first of a place is the longest
                out[n - end] = i
        return out if None not in out else [self._single(c) if i is None else i for i, c in zip(out, text, strict=True)]

    def encode(self, text: str) -> list[int]:
        """The ids of one text with blanks as marks; characters without a piece have the ids of their bytes."""
        whole = self.id.get(text)
        if whole is not None and self.compatible(START, whole):
            return [whole]
        n = len(text)
        best, open_, out = self.longest(text), bytearray(b"\1") * (n + 1), []
        tries, fits = self.tries, self.fits
        at, before, left = 0, START, tries.get(best[0]) or ((best[0], 1),) if n else ()
        while at < n:
            for piece, size in left:
                if open_[at + size]:
                    own = fits.get((before, piece))
                    if own or own is None and self.compatible(before, piece):
                        out.append(piece)
                        at += size
                        before = piece
                        if at < n:
                            piece = best[at]
                            left = tries.get(piece) or ((piece, 1),)
                        break
            else:  # nothing fits: this place is given up, and the piece before is tried shorter
                open_[at] = 0
                piece = out.pop()
                left = tries.get(piece, ((piece, 1),))
                at -= left[0][1]
                left = left[1:]
                before = out[-1] if out else START
        if min(out, default=0) >= 0:
            return out
        return [j for i in out for j in ([i] if i >= 0 else [self.bytes[b] for b in chr(-1 - i).encode("utf-8", "surrogatepass")])]

    def chunk_ids(self, chunk: bytes) -> tuple[int, ...]:
        own = self.known.get(chunk)
        if own is None:
            own = tuple(self.encode(chunk.decode().replace(" ", BLANK)))
            if len(chunk) <= 32:
                if len(self.known) >= CACHED:
                    self.known.clear()
                self.known[chunk] = own
        return own

    def encode_slice(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all documents of a slice in a row, without end ids, and the number of each."""
        full = off[:-1][off[1:] > off[:-1]]  # a blank comes before every text that isn't empty
        buf, off = np.insert(buf, full, 32), off + np.searchsorted(full, off, side="left")
        raw = buf.tobytes()
        try:
            points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        except UnicodeDecodeError:
            texts = [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            raw, off = b"".join(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            buf, points = np.frombuffer(raw, np.uint8), np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        n = len(buf)
        cut = np.zeros(n + 1, bool)
        numbers = self.number[points]
        cut[np.flatnonzero((buf & 0xC0) != 0x80)[1:]] = ~self.beside[numbers[:-1], numbers[1:]]
        cut[off] = True
        cut[n] = False
        start = np.flatnonzero(cut)
        end = np.append(start[1:], n)[: len(start)]
        hashes = K.span_hash(K.prefix_hash(buf), start, end) + (end - start).astype(np.uint64)
        _, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        known = self.known.get
        new = [known(raw[a:b]) or self.chunk_ids(raw[a:b]) for a, b in zip(start[where].tolist(), end[where].tolist(), strict=True)]
        size = np.fromiter(map(len, new), np.int64, len(new))
        flat = np.fromiter(chain.from_iterable(new), np.int32, int(size.sum()))
        per_chunk = size[back]
        ids = flat[K.spread((np.cumsum(size) - size)[back], per_chunk)]
        total = np.concatenate([[0], np.cumsum(per_chunk)])
        return ids, np.diff(total[np.searchsorted(start, off)])


@lru_cache(maxsize=2)
def processor(path: str):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def _lists(parts: list[np.ndarray], sizes: list[np.ndarray]) -> pa.Array:
    """An Arrow array of lists from values in a row and the sizes of the lists."""
    values = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


def _encoded(path: str, at: int, name: str):
    def run(batches):
        model = piece_model(path)
        for batch in batches:
            buf, off = K.text_bytes(batch.column(at))
            for i, j in K.slices(off):
                ids, per = model.encode_slice(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                ids = np.insert(ids, np.cumsum(per), model.end)
                rows = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*rows.columns, _lists([ids], [per + 1])], names=[*batch.schema.names, name])

    return run


def _id_lists(column: pa.ListArray):
    """The ids of each row as Python numbers, a row at a time."""
    values, offsets = column.values.to_numpy(), column.offsets.to_numpy().tolist()
    for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        yield values[a:b].tolist() if column[k].is_valid else None


def _decoded(path: str, at: int, name: str):
    def run(batches):
        model = processor(path)
        for batch in batches:
            ids = batch.column(at)
            # a few rows at a time: ids are Python numbers here
            step = max(1, int(len(ids) * 200_000 // max(1, len(ids.flatten()))))
            for k in range(0, len(ids), step):
                rows = batch.slice(k, step)
                texts = [model.decode(x) if x is not None else None for x in _id_lists(rows.column(at))]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, name])

    return run


def encode(documents: DataFrame, model: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """documents with the ids of their texts, the end id last. A column of that name is replaced."""
    kept = documents.drop(ids_col) if ids_col != text_col else documents
    schema = StructType([*kept.schema.fields, StructField(ids_col, ArrayType(IntegerType()))])
    return kept.mapInArrow(_encoded(model, kept.columns.index(text_col), ids_col), schema)


def decode(rows: DataFrame, model: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """rows with the texts of their ids; null ids have a null text. A column of that name is replaced."""
    kept = rows.drop(text_col)
    schema = StructType([*kept.schema.fields, StructField(text_col, StringType())])
    return kept.mapInArrow(_decoded(model, kept.columns.index(ids_col), text_col), schema)


DIGEST_SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def _round_trips(path: str):
    """encode and decode of (doc_id, text) in one task: neither ids nor texts leave it, only their digests."""
    encoded = _encoded(path, 1, "ids")

    def run(batches):
        model = processor(path)
        number = [str(i) for i in range(model.vocab_size())].__getitem__
        digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
        for batch in encoded(batches):
            out = [(len(x), digest(" ".join(map(number, x))), digest(model.decode(x))) for x in _id_lists(batch.column(2))]
            columns = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def round_trip(documents: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text, encoded and decoded again."""
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_round_trips(model), DIGEST_SCHEMA)
