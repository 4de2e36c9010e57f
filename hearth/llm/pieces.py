"""SentencePiece models run by the tokenizers library.

The model protobuf is parsed and rebuilt: its normaliser (character map, extra
white space, dummy prefix), the metaspace marker, its pieces with unigram scores
or, for a BPE model, merges in the order of the scores, and byte fallback. Texts
are encoded in multithreaded batches of their distinct pieces, which is exact as
long as no vocabulary piece has a marker after another character; otherwise whole
texts are encoded. Parity with the sentencepiece library is verified piece by
piece on everything that is encoded.

A null or empty text has no ids. Models with user-defined symbols are refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from hearth.llm.chunks import ChunkStore
from hearth.llm.common import append_columns

MARKER = "▁"
AT_SPACE = re.compile(r"(?<=[^ ])(?= )")
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2
GROUP_BYTES = 4 << 20
ENCODED_AT_ONCE = 16_384


def read_model(path: str):
    from sentencepiece import sentencepiece_model_pb2

    with open(path, "rb") as f:
        return sentencepiece_model_pb2.ModelProto.FromString(f.read())


def merges_of(model) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece, in the order of the scores."""
    score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
    place = {p.piece: i for i, p in enumerate(model.pieces)}
    found = []
    for piece in score:
        for cut in range(1, len(piece)):
            left, right = piece[:cut], piece[cut:]
            if left in score and right in score:
                found.append((-score[piece], place[left], place[right], left, right))
    return [(left, right) for *_, left, right in sorted(found)]


def build_tokenizer(model):
    """A ``tokenizers.Tokenizer`` that encodes and decodes like the SentencePiece model."""
    from tokenizers import Tokenizer, decoders, models, normalizers

    kinds = {p.type for p in model.pieces}
    if USER_DEFINED in kinds:
        raise ValueError("user-defined symbols are not supported")
    trainer, spec = model.trainer_spec, model.normalizer_spec
    unknown = next(p.piece for p in model.pieces if p.type == UNKNOWN)
    if trainer.model_type == BPE:
        vocab = {p.piece: i for i, p in enumerate(model.pieces)}
        core = models.BPE(vocab, merges_of(model), unk_token=unknown, fuse_unk=True, byte_fallback=trainer.byte_fallback)
    elif trainer.model_type == UNIGRAM:
        scores = [(p.piece, p.score) for p in model.pieces]
        core = models.Unigram(scores, unk_id=trainer.unk_id, byte_fallback=trainer.byte_fallback)
    else:
        raise ValueError("only unigram and BPE models")
    steps = [normalizers.Precompiled(spec.precompiled_charsmap)] if spec.precompiled_charsmap else []
    if spec.remove_extra_whitespaces:
        from tokenizers import Regex

        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if spec.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARKER))
    steps.append(normalizers.Replace(" ", MARKER))
    tokenizer = Tokenizer(core)
    tokenizer.normalizer = normalizers.Sequence(steps)
    end = [decoders.Strip(" ", 1, 0)] if spec.add_dummy_prefix else []
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARKER, " "), decoders.ByteFallback(), decoders.Fuse(), *end])
    return tokenizer


def cuts_at_markers(model) -> bool:
    """Whether texts may be encoded piece by piece: only with a dummy prefix and no rewriting of spaces."""
    spec = model.normalizer_spec
    inner = any(MARKER in p.piece.lstrip(MARKER) for p in model.pieces if p.type == NORMAL)
    return spec.add_dummy_prefix and not inner and not spec.precompiled_charsmap and not spec.remove_extra_whitespaces


class Encoder:
    """Encodes groups of texts; ``differs`` are the numbers of pieces on which the two libraries disagree."""

    def __init__(self, path: str, verify: bool):
        from sentencepiece import SentencePieceProcessor

        model = read_model(path)
        self.tokenizer = build_tokenizer(model)
        self.peer = SentencePieceProcessor(model_file=path) if verify else None
        self.by_piece = cuts_at_markers(model)
        self.store = ChunkStore(self._encode)
        self.equal = np.ones(0, bool)

    def _encode(self, pieces: list[str | None]) -> Iterator[list[int]]:
        # the library's result per piece takes far more memory than its ids
        for low in range(0, len(pieces), ENCODED_AT_ONCE):
            yield from self._encode_batch(pieces[low : low + ENCODED_AT_ONCE])

    def _encode_batch(self, pieces: list[str | None]) -> list[list[int]]:
        texts = [p or "" for p in pieces]
        ids = [e.ids if t else [] for t, e in zip(texts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True)]
        equal = [True] * len(ids)
        if self.peer:
            equal = [a == b for a, b in zip(ids, self.peer.encode(texts, num_threads=1), strict=True)]
        if None in pieces:
            lone = pieces.index(None)
            ids[lone] = [self.tokenizer.token_to_id(MARKER)]
            equal[lone] = self.peer is None or ids[lone] == [self.peer.piece_to_id(MARKER)]
        self.equal = np.append(self.equal, equal)
        return ids

    def group(self, texts: list[str]) -> Iterator[tuple[np.ndarray, bool]]:
        if self.store.full():
            self.store.clear()
            self.equal = np.ones(0, bool)
        if self.by_piece:
            places = [self._places(t) for t in texts]
        else:
            places = [np.array([self.store.first[t]]) for t in texts]
        self.store.settle()
        for place in places:
            yield self.store.gather(place), bool(self.equal[place].all())

    def _places(self, text: str) -> np.ndarray:
        # the dummy prefix stands in for the one space at which a piece begins
        if "  " in text or text.startswith(" "):
            first, *rest = AT_SPACE.split(text)
            pieces = [first, *(p[1:] for p in rest)]
        else:
            pieces = text.split(" ")
        lone = len(pieces) > 1 and not pieces[-1]
        if not lone:
            return np.fromiter(map(self.store.first.__getitem__, pieces), np.int64, len(pieces))
        # a last space of its own is a marker; an empty piece elsewhere is an empty text
        if "" not in self.store.rest:
            self.store.rest[""] = self.store.register(None)
        return np.array([*map(self.store.first.__getitem__, pieces[:-1]), self.store.rest[""]], dtype=np.int64)


@lru_cache(maxsize=1)
def encoder_of(path: str, verify: bool) -> Encoder:
    """The encoder of a worker, kept for its next tasks: one per task would linger until it is collected."""
    return Encoder(path, verify)


def encode(docs: DataFrame, model_path: str | None = None, verify: bool = True, text_col: str = "text") -> DataFrame:
    """``docs`` and ids (little-endian unsigned 32-bit numbers), n_ids, parity."""
    path = model_path or public_tokenizers.path("piece_bpe_32k.model")

    def compute(texts: list[bytes]) -> list[pa.Array]:
        encoder = encoder_of(path, verify)
        ids, parity, low = [], [], 0
        while low < len(texts):
            size, high = 0, low
            while high < len(texts) and size < GROUP_BYTES:
                size += len(texts[high])
                high += 1
            for found, equal in encoder.group([t.decode() for t in texts[low:high]]):
                ids.append(found.astype("<u4").tobytes())
                parity.append(equal)
            low = high
        return [pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(parity, pa.bool_())]

    return append_columns(docs, text_col, compute, [("ids", T.BinaryType()), ("n_ids", T.LongType()), ("parity", T.BooleanType())])


class Decoder:
    """Texts of ids: the bytes every id stands for, joined; what is not UTF-8 is left to the library."""

    def __init__(self, path: str):
        model = read_model(path)
        self.path = path
        self.strip = 1 if model.normalizer_spec.add_dummy_prefix else 0
        self.bytes = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.replace(MARKER, " ").encode() for p in model.pieces]

    @cached_property
    def tokenizer(self):
        return build_tokenizer(read_model(self.path))

    def text(self, ids: list[int]) -> str:
        joined = b"".join(map(self.bytes.__getitem__, ids))
        try:
            text = joined.decode()
        except UnicodeDecodeError:
            return self.tokenizer.decode(ids, skip_special_tokens=False)
        return text[self.strip :] if text.startswith(" ") else text


@lru_cache(maxsize=1)
def decoder_of(path: str) -> Decoder:
    return Decoder(path)


def decode(encoded: DataFrame, model_path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """``encoded`` and decoded, the text of the ids; no ids give an empty text."""
    path = model_path or public_tokenizers.path("piece_bpe_32k.model")

    def compute(rows: list[bytes]) -> list[pa.Array]:
        decoder = decoder_of(path)
        return [pa.array([decoder.text(np.frombuffer(r, "<u4").tolist()) for r in rows], pa.string())]

    return append_columns(encoded, ids_col, compute, [("decoded", T.StringType())])
