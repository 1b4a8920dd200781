"""SentencePiece encoding of merge-type (BPE) models by backtracking, and decoding.

The ids are exactly those of the sentencepiece library, found another way.  Its
encoder merges the best-scored adjacent pair until none is left; here a segment
is encoded left to right:

* an Aho-Corasick automaton over all pieces gives the longest piece that starts
  at each place;
* a piece may follow another only if the two, taken apart into characters and
  merged again, come out as these two (``Merges.adjacent``).  With priorities that
  never tie, a row of pieces is the encoding exactly if all its neighbours fit, and
  every prefix has one encoding;
* where the longest piece does not fit, its longest prefix that is a piece is
  tried, and so on; where none fits, the place is marked in a bit field as one
  that no encoding passes, and the piece before is taken back.

A text is first normalised by the library and cut where no piece of the model holds
the two characters side by side: no merge crosses such a place, so segments are
encoded alone, and short ones are kept in a bounded cache.  Pieces that share one
score (runs of white space in some models) have no priority among themselves; the
library then merges from the left.  A segment that holds such a piece is merged
outright.  Characters that are no piece become their UTF-8 bytes.

Each text is worked on by itself, in Arrow batches, without a shuffle: any document
or source may hold any share of the rows.  Memory: one batch, the caches
(``CACHED`` segments of up to ``SHORT`` characters in two generations, ``FITS``
pairs) and a few times the longest text.

Defined cases: null and empty texts give the begin and end ids alone; a null id
stays null; repeated rows give repeated rows; an empty table gives an empty result.
Models with unused pieces or without byte pieces are refused (ValueError);
user-defined symbols are not supported.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farewise.llm.common import pick

CACHED = 1 << 18
SHORT = 48
FITS = 1 << 17
#: Rows of an Arrow batch that are encoded before they are handed on.
ROWS = 512

ENCODED = "doc_id long, ids binary, decoded string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Merges:
    """The merge rules of a model: ``scores`` has every piece that merging can give."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        many: dict[float, int] = {}
        for piece, score in scores.items():
            if len(piece) > 1:
                many[score] = many.get(score, 0) + 1
        self.tied = {p for p, s in scores.items() if len(p) > 1 and many[s] > 1}
        # what merging never gives can never be part of an encoding
        self.reached = {p for p in scores if p in self.tied or self.merge(p) == [p]}
        self.shorter = {p: self._prefix(p) for p in self.reached if len(p) > 1}
        least = [p for p in self.tied if not any(q in p for q in self.tied - {p})]
        self.has_tied = re.compile("|".join(map(re.escape, least)) or r"(?!)").search
        self.fits: dict[tuple[str, str], bool] = {}

    def _prefix(self, piece: str) -> str:
        """The longest proper prefix that is a piece, or the first character."""
        return next((piece[:n] for n in range(len(piece) - 1, 1, -1) if piece[:n] in self.reached), piece[0])

    def adjacent(self, left: str, right: str) -> bool:
        """Whether the two pieces, taken apart and merged again, come out as they are:
        no merge across their boundary is ever the best one."""
        parts, cut, scores = [*left, *right], len(left) - 1, self.scores
        fit = None
        while fit is None:
            best, at = None, -1
            for i, (a, b) in enumerate(zip(parts, parts[1:])):
                s = scores.get(a + b)
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None or at == cut:
                fit = best is None
            else:
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
                cut -= at < cut
        if len(self.fits) >= FITS:
            self.fits.clear()
        self.fits[left, right] = fit
        return fit

    def merge(self, text: str) -> list[str]:
        """The characters of ``text`` merged, best score first, ties from the left."""
        parts: list[str | None] = list(text)
        before = list(range(-1, len(parts) - 1))
        after = list(range(1, len(parts) + 1))
        scores, end = self.scores, len(parts)
        waiting = [(-s, i, a + b) for i, (a, b) in enumerate(zip(text, text[1:])) if (s := scores.get(a + b)) is not None]
        heapq.heapify(waiting)
        while waiting:
            _, i, both = heapq.heappop(waiting)
            j = after[i] if parts[i] is not None else end
            if j == end or parts[i] + parts[j] != both:
                continue  # one of the two has been merged since
            parts[i], parts[j], after[i] = both, None, after[j]
            if after[i] < end:
                before[after[i]] = i
                if (s := scores.get(both + parts[after[i]])) is not None:
                    heapq.heappush(waiting, (-s, i, both + parts[after[i]]))
            if (h := before[i]) >= 0 and (s := scores.get(parts[h] + both)) is not None:
                heapq.heappush(waiting, (-s, h, parts[h] + both))
        return [p for p in parts if p is not None]


class Encoder:
    """Texts to ids and back with the model file ``path``."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        if any(sp.is_unused(i) for i in range(size)) or sum(map(sp.is_byte, range(size))) != 256:
            raise ValueError(f"{path}: only models with byte pieces and without unused pieces are supported")
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))]
        pack = struct.Struct("<I").pack
        self.packed = {sp.id_to_piece(i): pack(i) for i in plain}
        self.packed_byte = [pack(sp.piece_to_id(f"<0x{b:02X}>")) for b in range(256)]
        self.begin, self.end = pack(sp.bos_id()), pack(sp.eos_id())
        self.merges = Merges({sp.id_to_piece(i): sp.get_score(i) for i in plain})
        self.longest = ahocorasick.Automaton()
        for piece in self.merges.reached:
            self.longest.add_word(piece, len(piece))
        self.longest.make_automaton()
        self._learn_cuts()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _learn_cuts(self) -> None:
        """Which characters stand side by side in some piece."""
        beside = {p[i:i + 2] for p in self.packed for i in range(len(p) - 1)}
        letters = sorted({c for two in beside for c in two})
        self.letter = np.zeros(0x110000, dtype=np.uint16 if len(letters) < 1 << 16 else np.uint32)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.joined = np.zeros((len(letters) + 1, len(letters) + 1), dtype=bool)
        for a, b in beside:
            self.joined[self.letter[ord(a)], self.letter[ord(b)]] = True

    def segments(self, normal: str) -> list[str]:
        """``normal`` cut where no piece could span."""
        letters = self.letter[np.frombuffer(normal.encode("utf-32-le"), dtype="<u4")]
        cuts = (np.flatnonzero(~self.joined[letters[:-1], letters[1:]]) + 1).tolist()
        return [normal[a:b] for a, b in zip([0, *cuts], [*cuts, len(normal)])]

    def pieces(self, segment: str) -> list[str]:
        """The pieces (and characters that are none) of one segment."""
        n, merges = len(segment), self.merges
        if n == 1:
            return [segment]
        if merges.has_tied(segment):
            return merges.merge(segment)
        # the longest piece from each place: later ends are longer; a character that is no piece stands for itself
        size = [1] * n
        for last, long in self.longest.iter(segment):
            size[last - long + 1] = long
        fits, shorter = merges.fits, merges.shorter
        dead = bytearray((n >> 3) + 1)  # bit i: no encoding has a boundary at i
        taken: list[str] = []
        at, piece = 0, segment[:size[0]]
        while True:
            stop = at + len(piece)
            good = not dead[stop >> 3] >> (stop & 7) & 1
            if good and taken:
                good = fits.get((taken[-1], piece))
                if good is None:
                    good = merges.adjacent(taken[-1], piece)
            if good:
                taken.append(piece)
                if stop == n:
                    return taken
                at, piece = stop, segment[stop:stop + size[stop]]
            elif len(piece) > 1:
                piece = shorter[piece]
            else:
                # nothing goes on from here: the piece before gives way to a shorter one
                dead[at >> 3] |= 1 << (at & 7)
                piece = taken.pop()
                at -= len(piece)

    def _encode_segment(self, segment: str) -> bytes:
        out = self.older.get(segment)
        if out is None:
            out = b"".join([self.packed.get(p) or self._bytes(p) for p in self.pieces(segment)])
        if len(segment) <= SHORT:
            if len(self.known) >= CACHED:
                self.older, self.known = self.known, {}
            self.known[segment] = out
        return out

    def _bytes(self, character: str) -> bytes:
        """The byte pieces of a character that is no piece."""
        return b"".join([self.packed_byte[b] for b in character.encode("utf-8")])

    def encode(self, text: str | None) -> bytes:
        """The ids of ``text`` between begin and end, unsigned little-endian 32 bits each."""
        normal = self.library.normalize(text) if text else ""
        if not normal:
            return self.begin + self.end
        out = [self.begin]
        known = self.known.get
        for segment in self.segments(normal):
            ids = known(segment)
            if ids is None:
                ids = self._encode_segment(segment)
                known = self.known.get  # a new generation may have begun
            out.append(ids)
        out.append(self.end)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids as ``encode`` gives them."""
        return self.library.decode(np.frombuffer(ids, dtype="<u4").tolist())


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One encoder, with its caches, per Python worker."""
    return Encoder(path)


def _per_text(docs: DataFrame, model: str, id_col: str, text_col: str, schema: str, row) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    types = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(model)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                some = batch.slice(i, ROWS)
                made = [row(coder, text) for text in some.column(1).to_pylist()]
                columns = [some.column(0), *map(list, zip(*made))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's ids (begin and end included, unsigned little-endian 32 bits) and what they decode to."""
    def row(coder, text):
        ids = coder.encode(text)
        return ids, coder.decode(ids)

    return _per_text(docs, model, id_col, text_col, ENCODED, row)


def piece_digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same by count and SHA-256: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    def row(coder, text):
        ids = coder.encode(text)
        return len(ids) // 4, sha256(ids).hexdigest(), sha256(coder.decode(ids).encode("utf-8")).hexdigest()

    return _per_text(docs, model, id_col, text_col, DIGESTS, row)
