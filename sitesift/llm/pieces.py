"""SentencePiece models on the tokenizers library.

The model file is a protobuf; a small reader takes the pieces (text, score,
kind), the trainer's model type and byte-fallback flag and the normaliser's
flags and character map from it. From these a tokenizer is rebuilt: the
normaliser (character map, white space squeezed if the model says so, a
metaspace mark for each space and before the text), unigram scores or, for a
merge model, the merges implied by the scores, and byte fallback. Batches are
encoded by the library's own threads.

A merge model with byte fallback may cut a text between two characters that
stand next to each other in no piece: no merge crosses such a cut. These pairs
are read off the vocabulary; each distinct chunk between cuts (told apart by
its bytes) is encoded once, and texts are put together from chunks. Other
models, and texts that hold the mark character, are encoded whole.

What is verified. Every row's ids, put together, are read back by the
vocabulary's bytes and compared with the row's whole text (``round_trip``).
Parity with the sentencepiece library is verified per row where texts are
encoded whole, else once per distinct chunk (a row's ``parity`` is that of all
its chunks), and on a fixed set of awkward strings, whole, whenever a worker
loads a model.

Defined cases: a null text counts as empty: no ids. Control pieces never match
inside a text. A text that holds the mark character itself reads back with a
space in its place, and a model that normalises reads back the normalised
text: ``round_trip`` compares with that form. Repeated rows each give a row.
Other columns are kept by :func:`encoded`. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import operator
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import _text as T

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNIGRAM, MERGES = 1, 2
#: Chunks a worker remembers; it forgets all of them beyond that.
REMEMBERED = 100_000
#: Ids read back at a time.
READ_BACK = 1 << 16
PROBES = ["", " ", "a", "  two  spaces ", "line\nbreak\ttab", "<s> </s> <unk> <0x0A>", "café naïve 你好",
          "\U0001f600 emoji", "x▁y", "3.14 = 22/7?", "\u0000\u0001", "A" * 300]


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 2: 0, 5: 4}[key & 7] or varint()
        yield key >> 3, data[at:at + size]
        at += size


@dataclass
class Model:
    pieces: list[tuple[str, float, int]]
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True


def parse(data: bytes) -> Model:
    model = Model([])
    for number, value in fields(data):
        if number == 1:
            got = dict(fields(value))
            score = struct.unpack("<f", got[2])[0] if 2 in got else 0.0
            model.pieces.append((got.get(1, b"").decode(), score, got.get(3, NORMAL)))
        elif number == 2:
            got = dict(fields(value))
            model.kind, model.byte_fallback = got.get(3, UNIGRAM), bool(got.get(35, 0))
        elif number == 3:
            got = dict(fields(value))
            model.charsmap = got.get(2, b"")
            model.dummy_prefix, model.squeeze, model.escape = (bool(got.get(k, 1)) for k in (3, 4, 5))
    return model


def merges(model: Model) -> list[tuple[str, str]]:
    """The merges a merge model's scores imply: of every piece, each split
    into two pieces, best piece first."""
    usable = {text: score for text, score, kind in model.pieces if kind in (NORMAL, USER)}
    index = {text: i for i, (text, _, _) in enumerate(model.pieces)}
    found = []
    for text, score in usable.items():
        for cut in range(1, len(text)):
            left, right = text[:cut], text[cut:]
            if left in usable and right in usable:
                found.append((-score, index[text], index[left], index[right], left, right))
    return [(left, right) for *_, left, right in sorted(found)]


def cuts(model: Model) -> np.ndarray | None:
    """[before, after]: byte pairs at a character boundary that no piece
    holds; None if the model's texts can't be cut."""
    if (model.kind != MERGES or model.charsmap or model.squeeze or not model.dummy_prefix or not model.escape
            or not model.byte_fallback):     # without it two unknown characters side by side are one id
        return None
    free = np.ones((256, 256), bool)
    for text, _, kind in model.pieces:
        if kind in (NORMAL, USER):
            raw = np.frombuffer(text.replace(MARK, " ").encode(), np.uint8)
            free[raw[:-1], raw[1:]] = False
    free[:, 0x80:0xC0] = False      # inside a character
    return free


def build(model: Model, prefix: bool = True):
    """A tokenizers ``Tokenizer`` that encodes and decodes like the model;
    without ``prefix`` it takes and gives chunks as they stand."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers
    unk = next((i for i, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN), 0)
    if model.kind == UNIGRAM:
        # control pieces must never match a text: a score below every other
        floor = min((s for _, s, _ in model.pieces), default=0.0) - 1000
        vocab = [(t, s if k in (NORMAL, USER, UNKNOWN) else floor) for t, s, k in model.pieces]
        tok = Tokenizer(models.Unigram(vocab, unk_id=unk, byte_fallback=model.byte_fallback))
    elif model.kind == MERGES:
        vocab = {t: i for i, (t, _, _) in enumerate(model.pieces)}
        tok = Tokenizer(models.BPE(vocab, merges(model), unk_token=model.pieces[unk][0], fuse_unk=True,
                                   byte_fallback=model.byte_fallback))
    else:
        raise ValueError(f"model type {model.kind} is not supported")
    steps = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.squeeze:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip(left=True, right=True)]
    if model.dummy_prefix and prefix:
        steps.append(normalizers.Prepend(MARK if model.escape else " "))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    tok.normalizer = normalizers.Sequence(steps)
    back = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    if model.dummy_prefix and prefix:
        back.append(decoders.Strip(" ", 1, 0))
    tok.decoder = decoders.Sequence(back)
    return tok


class Codec:
    """Encoding, decoding and parity of one model; ``data`` is its file."""

    def __init__(self, data: bytes):
        import sentencepiece
        self.model = parse(data)
        self.tok = build(self.model)
        self.spm = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.cuts = cuts(self.model)
        if self.cuts is not None:
            self.chunks = build(self.model, prefix=False)
            # What each id reads back as, one after the other.
            says = [bytes([int(t[3:5], 16)]) if kind == BYTE else t.replace(MARK, " ").encode() for t, _, kind in self.model.pieces]
            self.said = np.frombuffer(b"".join(says) + bytes(1), np.uint8)
            self.says = np.array([len(x) for x in says], np.int64)
            self.says_from = np.cumsum(self.says) - self.says
            # the same model without the mark before a text: field 3 of the normaliser set to 0
            self.chunk_spm = sentencepiece.SentencePieceProcessor(model_proto=data + b"\x1a\x02\x18\x00")
        self._forget()
        whole = self.encode(PROBES)
        for s in T.slices(pa.array(PROBES)):
            ids, size, _, _ = self.encode_slice(s)
            got = [list(x) for x in np.split(ids, np.cumsum(size)[:-1])]
            for text, one, two, three in zip(PROBES, whole, got, self.spm.encode(PROBES)):
                if not one == two == three:
                    raise ValueError(f"the rebuilt tokenizer differs from the model on {text!r}")

    def _forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.ids, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.good = np.zeros(0, bool)           # parity

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tok.decode_batch(ids, skip_special_tokens=False)

    def normal(self, text: str) -> str:
        """What a text reads back as: itself, but for what the model folds."""
        if self.model.charsmap or self.model.squeeze:
            form = self.tok.normalizer.normalize_str(text).replace(MARK, " ")
            return form[1:] if self.model.dummy_prefix and form[:1] == " " else form
        return text.replace(MARK, " ")

    def _whole(self, texts: list[str]) -> list[tuple[list[int], bool, bool]]:
        ids = self.encode(texts)
        back, other = self.decode(ids), self.spm.encode(texts, num_threads=1)
        return [(i, self.normal(t) == b, i == o) for t, i, b, o in zip(texts, ids, back, other)]

    def _learn(self, chunks: list[bytes]) -> None:
        texts = [c.decode() for c in chunks]
        ids = [e.ids for e in self.chunks.encode_batch_fast(texts, add_special_tokens=False)]
        other = self.chunk_spm.encode(texts, num_threads=1)
        self.index.update(zip(chunks, range(len(self.size), len(self.size) + len(chunks))))
        self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(ids), np.int32)])
        self.size = np.concatenate([self.size, np.fromiter(map(len, ids), np.int64, len(ids))])
        self.good = np.concatenate([self.good, np.array(list(map(operator.eq, ids, other)), bool)])

    def reads_back(self, s: T.Slice, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether each text's ids read back as its bytes, after the space
        that stands before every text."""
        each = self.says[ids]
        upto = np.concatenate([[0], np.cumsum(each)])
        last = np.cumsum(size)
        begin, end = upto[last - size], upto[last]
        full = size > 0
        good = np.where(full, end - begin - 1, 0) == s.ends - s.starts
        # Some ids at a time: an id's bytes lie at ``says_from``; ``shift`` leads from a byte read back to its place in the slice.
        shift = np.repeat(s.starts - begin - 1, size)
        owner = np.repeat(np.arange(s.n), size)
        for a in range(0, len(ids), READ_BACK):
            b = min(a + READ_BACK, len(ids))
            place = np.arange(upto[a], upto[b])
            got = self.said[place + np.repeat(self.says_from[ids[a:b]] - upto[a:b], each[a:b])]
            own = np.repeat(owner[a:b], each[a:b])
            at = place + np.repeat(shift[a:b], each[a:b])
            first = at < s.starts[own]              # the space before the text
            want = s.data[np.clip(at, 0, max(len(s.data) - 1, 0))]
            want[first] = 0x20
            good[own[got != want]] = False
        return good

    def encode_slice(self, s: T.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids in a row, ids per text, round trip and parity per text."""
        raw = s.data.tobytes()
        mark = MARK.encode()
        if self.cuts is None or mark in raw:
            done = self._whole([raw[a:b].decode() for a, b in zip(s.starts, s.ends)])
            size = np.array([len(i) for i, _, _ in done], np.int64)
            flat = np.fromiter((x for i, _, _ in done for x in i), np.int32, int(size.sum()))
            return flat, size, np.array([r for _, r, _ in done], bool), np.array([p for _, _, p in done], bool)
        used = s.ends > s.starts
        cut = np.zeros(len(s.data), bool)
        cut[1:] = self.cuts[s.data[:-1], s.data[1:]]
        cut[s.starts[used]] = True
        begin = np.flatnonzero(cut)
        end = np.append(begin[1:], len(s.data))
        doc = np.searchsorted(s.ends, begin, side="right")
        at, which = s.distinct(begin, end)
        first = np.zeros(len(s.data) + 1, bool)
        first[s.starts[used]] = True
        first = first[begin]                    # these get the mark before the text
        kinds, which = np.unique(2 * which + first, return_inverse=True)
        at = at[kinds >> 1]
        names = [b" " + raw[b:e] if f else raw[b:e] for b, e, f in zip(begin[at].tolist(), end[at].tolist(), (kinds & 1).tolist())]
        if len(self.index) > REMEMBERED:
            self._forget()
        new = [n for n in names if n not in self.index]
        if new:
            self._learn(new)
        known = np.fromiter(map(self.index.__getitem__, names), np.int64, len(names))[which]
        each = self.size[known]
        start = (np.cumsum(self.size) - self.size)[known]
        place = np.repeat(start - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        parity = np.bincount(doc[~self.good[known]], minlength=s.n) == 0
        ids, size = self.ids[place], np.bincount(doc, each, minlength=s.n).astype(np.int64)
        return ids, size, self.reads_back(s, ids, size), parity


_CODECS: dict[bytes, Codec] = {}


def codec(data: bytes) -> Codec:
    key = hashlib.sha1(data).digest()
    if key not in _CODECS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        _CODECS[key] = Codec(data)
    return _CODECS[key]


def load(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


ENCODED = "n_tokens bigint, ids array<int>, round_trip boolean, parity boolean"


def encoded(docs: DataFrame, data: bytes) -> DataFrame:
    """``docs`` with n_tokens, ids, round_trip (the ids decode to the text)
    and parity (the sentencepiece library gives the same ids). A column of
    ``docs`` with one of these names is replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(data)      # a model file, about 1 MB
    extra = StructType.fromDDL(ENCODED)
    taken = {f.name for f in extra.fields}
    keep = [c for c in docs.columns if c.lower() not in taken]
    docs = docs.select(*[F.col(f"`{c}`") for c in keep])
    at = next(i for i, c in enumerate(keep) if c.lower() == "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(sent.value)
        for batch in batches:
            for s in T.slices(batch.column(at)):
                ids, size, trip, parity = own.encode_slice(s)
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(s.first, s.n).columns, pa.array(size), T.list_array(ids, size, pa.int32()),
                     pa.array(trip), pa.array(parity)], names=[*keep, *(f.name for f in extra.fields)])
        own._forget()       # the worker lives on for other stages

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *extra.fields]))


def decoded(rows: DataFrame, data: bytes) -> DataFrame:
    """``rows`` with their ``ids`` read back as ``text`` (a text column is
    replaced); null ids give an empty text."""
    sent = rows.sparkSession.sparkContext.broadcast(data)
    keep = [c for c in rows.columns if c.lower() != "text"]
    rows = rows.select(*[F.col(f"`{c}`") for c in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(sent.value)
        for batch in batches:
            texts = own.decode([i or [] for i in batch.column("ids").to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*keep, "text"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields]).add("text", "string"))
