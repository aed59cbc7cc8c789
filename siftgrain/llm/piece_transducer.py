"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Three machines are compiled from a model file: the normaliser (blanks to the
model's blank sign, a dummy blank before a text), the lexicon (one path of
characters for each piece, byte pieces as a fallback for characters that no
piece has) and, for models whose pieces come from merges, an acceptor on
neighbouring pieces. Composed with an input they give a lattice of pieces;
the shortest path over the tropical semiring is the encoding.

Weights: in a unigram model a piece weighs its negative score. A merge model's
scores are ranks, not costs, and a sum of ranks doesn't give its encodings;
but a sequence of pieces is the encoding exactly if every two neighbours are
each other's encoding when alone. There the acceptor's arcs weigh nothing
between such neighbours and infinity elsewhere, every piece weighs one, and
one path of finite weight is left: the library's own encoding.

No piece goes on from a character to a blank sign after it, over a character
that has no piece, or from a letter to most marks, so the lattice falls apart
there; segments are solved alone and remembered, up to a bound, for the life
of a worker.

Edge cases: null and empty texts encode to no pieces and decode to ''; every
other text decodes to itself, but that a blank sign (U+2581) becomes a blank,
as in the model's own normaliser, and that a model without byte pieces gives
its unknown piece for a character it lacks, which decodes to nothing and leaves
round_trip false; repeated rows encode alike; extra columns
pass through ``encode``, but that ``ids`` is replaced.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, slim, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
MOST_SEGMENTS = 400_000
#: Stands for the piece before a run's first.
START = 1 << 23
#: Stands for a character that no piece of a unigram model is.
STRANGE = START + 1
NORMAL, UNKNOWN, BYTE = 1, 2, 6


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield key >> 3, data[at : at + n]
            at += n


class Transducer:
    """The machines of one model, and the segments solved so far."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.merges, self.dummy = False, True
        for number, value in fields(model):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                self.merges = dict(fields(value)).get(3, 1) == 2
            elif number == 3:
                spec = dict(fields(value))
                if spec.get(2) or spec.get(4, 1):
                    raise ValueError("only normalisers without a character map that keep extra blanks are compiled")
                self.dummy = bool(spec.get(3, 1))
        self.id = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        self.unknown = self.kinds.index(UNKNOWN) if UNKNOWN in self.kinds else 0
        #: Weight of a character that is no piece in a unigram model: ten beyond the heaviest piece.
        self.strange = 10 - min((self.scores[i] for i in self.id.values()), default=0.0)
        if any(BLANK in p.lstrip(BLANK) for p in self.id):
            raise ValueError("a piece goes on to a blank sign")
        self.known = {c for p in self.id for c in p}
        self.value = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(BLANK, " ").encode() if k == NORMAL else b"" for p, k in zip(self.pieces, self.kinds, strict=True)]
        self.follows: dict[int, bool] = {}
        self.solved: dict[str, bytes] = {}
        self.broken: set[str] = set()  # segments whose pieces don't spell them; none is known
        self.cut = re.compile(r" *[^ \n]+| +|\n")
        self.lexicon: dict = {}  # of each character: the piece that ends there or -1, and what may follow
        for p, i in self.id.items():
            arcs = self.lexicon
            for c in p[:-1]:
                arcs = arcs.setdefault(c, [-1, {}])[1]
            arcs.setdefault(p[-1], [-1, {}])[0] = i

    def merged(self, text: str) -> list[str]:
        """A merge model's own rule: join the neighbours whose piece scores best, the leftmost first."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                n = self.id.get(parts[i] + parts[i + 1])
                if n is not None and (best is None or self.scores[n] > best):
                    best, at = self.scores[n], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def accepts(self, left: int, right: int) -> bool:
        """The acceptor's arc from one piece to another; a run's first piece comes from START."""
        if len(self.follows) > MOST_SEGMENTS:
            self.follows.clear()
        pair = [self.pieces[right]] if left == START else [self.pieces[left], self.pieces[right]]
        out = self.follows[left << 24 | right] = self.merged("".join(pair)) == pair
        return out

    def shortest(self, text: str) -> list[int]:
        """The shortest path through the lattice of a run of known characters."""
        n, lexicon = len(text), self.lexicon
        if self.merges:
            # The acceptor leaves one finite path to each place, so one predecessor is kept.
            follows, last, back = self.follows, [START] + [-1] * n, [0] * (n + 1)
            for i in range(n):
                left = last[i]
                if left < 0:
                    continue
                arcs, left = lexicon, left << 24
                for j in range(i, n):
                    arc = arcs.get(text[j])
                    if arc is None:
                        break
                    piece, arcs = arc
                    if piece >= 0 and last[j + 1] < 0:
                        ok = follows.get(left | piece)
                        if self.accepts(left >> 24, piece) if ok is None else ok:
                            last[j + 1], back[j + 1] = piece, i
        else:
            cost, last, back = [0.0] + [float("inf")] * n, [START] + [-1] * n, [0] * (n + 1)
            for i in range(n):
                arcs = lexicon
                for j in range(i, n):
                    arc = arcs.get(text[j])
                    if arc is None:
                        break
                    piece, arcs = arc
                    if piece >= 0 and (c := cost[i] - self.scores[piece]) < cost[j + 1]:
                        cost[j + 1], last[j + 1], back[j + 1] = c, piece, i
                if text[i] not in self.id and (c := cost[i] + self.strange) < cost[i + 1]:
                    # No piece is this character alone: an arc for an unknown one.
                    cost[i + 1], last[i + 1], back[i + 1] = c, STRANGE, i
        out, at = [], n
        while at:
            out += self.fallback(text[back[at]])[::-1] if last[at] == STRANGE else [last[at]]
            at = back[at]
        return out[::-1]

    def fallback(self, character: str) -> list[int]:
        """The byte pieces of a character that no piece has, or the unknown piece of a model without byte pieces."""
        return [self.bytes.get(b, self.unknown) for b in character.encode()] if self.bytes else [self.unknown]

    def segment(self, text: str) -> bytes:
        """The ids of a segment as packed integers."""
        found = self.solved.get(text)
        if found is not None:
            return found
        signs = text.replace(" ", BLANK)
        if not self.merges or self.known.issuperset(signs):
            ids = self.shortest(signs)
        else:
            ids, run = [], ""
            for c in signs:
                if c in self.known:
                    run += c
                    continue
                ids += self.shortest(run)
                ids += self.fallback(c)
                run = ""
            ids += self.shortest(run)
        if b"".join([self.value[i] for i in ids]) != text.encode():
            self.broken.add(text)
        out = array("i", ids).tobytes()
        if len(self.solved) >= MOST_SEGMENTS:
            self.solved.clear()
        if len(text) < 64:
            self.solved[text] = out
        return out

    def encode(self, text: str | None) -> bytes:
        """Packed ids (32 bits each) of a text."""
        if not text:
            return b""
        solved, out = self.solved, []
        for s in self.cut.findall((" " if self.dummy else "") + text.replace(BLANK, " ")):
            out.append(solved.get(s) or self.segment(s))
        return b"".join(out)

    def decode(self, ids: Iterator[int]) -> str:
        raw = b"".join([self.value[i] for i in ids]).decode("utf-8", "replace")
        return raw[1:] if self.dummy and raw[:1] == " " else raw


_transducers: dict[str, Transducer] = {}


def transducer(name: str, model: bytes) -> Transducer:
    """Compiled once in the life of a worker."""
    if name not in _transducers:
        _transducers[name] = Transducer(model)
    return _transducers[name]


def packed_ids(machine: Transducer, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[bool]]:
    """(ids of all texts, where each text's end, whether they decode to it)."""
    packed = [machine.encode(t) for t in texts]
    flat = np.frombuffer(b"".join(packed), np.int32)
    ends = np.r_[0, np.cumsum([len(x) // 4 for x in packed])].astype(np.int32)
    ok = [machine.decode(flat[a:z].tolist()) == (t or "").replace(BLANK, " ") for t, a, z in zip(texts, ends[:-1], ends[1:], strict=True)]
    return flat, ends, ok


def model_of(spark: SparkSession) -> str:
    """The model file that the session names, or the public one of this machine."""
    return spark.conf.get("spark.siftgrain.pieces", MODEL)


def encode(docs: DataFrame, model_path: str | None = None, text: str = "text") -> DataFrame:
    """Adds ids (array of int) and round_trip (the ids decode to the text).

    The model file is read on the driver and broadcast; it is a vocabulary's
    size, not the corpus's.
    """
    model_path = model_path or model_of(docs.sparkSession)
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    kept = [c for c in docs.columns if c not in ("ids", "round_trip")]
    held = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields] + ["ids array<int>", "round_trip boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model_path, model.value)
        for b in batches:
            at, column = 0, b.column(text)
            while at < b.num_rows:
                texts, size = [], 0
                while at + len(texts) < b.num_rows and size < 1 << 20:
                    texts.append(column[at + len(texts)].as_py())
                    size += len(texts[-1] or "")
                flat, ends, ok = packed_ids(machine, texts)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                part = b.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, ids, pa.array(ok)], names=[*kept, "ids", "round_trip"])
                at += len(texts)
        slim()

    return map_texts(held, run, schema)


def decode(encoded: DataFrame, model_path: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text that a column of ids stands for; null ids decode to ''."""
    model_path = model_path or model_of(encoded.sparkSession)
    with open(model_path, "rb") as f:
        model = encoded.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("string")
    def text(column):
        machine = transducer(model_path, model.value)
        return column.map(lambda x: machine.decode(x) if x is not None else "")

    return encoded.withColumn(out, text(F.col(ids)))


def op9_piece_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "round_trip")
