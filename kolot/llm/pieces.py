"""SentencePiece encoding and decoding with the tokenizers library as backend."""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kolot.llm.common import text_or_empty

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Distinct units whose ids a worker keeps.
MOST_CACHED = 150_000
#: Units that both libraries encode as one text.
GROUP = 16


class ParityError(ValueError):
    """The rebuilt tokenizer and the sentencepiece library disagree."""


@dataclass
class Codec:
    """A model parsed from its protobuf and rebuilt with the tokenizers library.

    Texts are cut before each run of marks; where no piece holds a mark after another
    character, no merge crosses such a cut, so a text's ids are those of its units one after
    another. Otherwise the whole text is one unit. Each distinct unit is encoded once in a
    worker, in multithreaded batches, decoded again, and compared with the sentencepiece
    library. Texts with a unit that the library can't be given alone (`alone`) are compared
    whole. Whitespace as a suffix, unescaped whitespace and user-defined symbols are refused.
    """

    data: bytes
    verify: bool = True
    cache: dict[str, bytes] = field(default_factory=dict)  # ids of a unit, as int32
    lossy: set[str] = field(default_factory=set)  # units whose ids don't give them back

    def __post_init__(self):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as pb
        from tokenizers import Tokenizer, models, normalizers

        proto = pb.ModelProto()
        proto.ParseFromString(self.data)
        norm, trainer = proto.normalizer_spec, proto.trainer_spec
        if trainer.treat_whitespace_as_suffix or not norm.escape_whitespaces or any(p.type == USER_DEFINED for p in proto.pieces):
            raise ValueError("whitespace suffixes, unescaped whitespace and user-defined symbols are not supported")
        self.pieces = [p.piece for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]
        self.unknown = self.kinds.index(UNKNOWN)
        self.dummy_prefix, self.squeeze = norm.add_dummy_prefix, norm.remove_extra_whitespaces
        self.charsmap = normalizers.Precompiled(norm.precompiled_charsmap) if norm.precompiled_charsmap else None
        self.bytes = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.begins = np.array([p.startswith(MARK) and k != BYTE for p, k in zip(self.pieces, self.kinds, strict=True)])
        self.whole: set[str] = set()  # units that are compared in whole texts only
        if trainer.model_type == UNIGRAM:
            model = models.Unigram([(p.piece, p.score) for p in proto.pieces], self.unknown, byte_fallback=trainer.byte_fallback)
        elif trainer.model_type == BPE:
            # a merge for each way to make a piece of two others, in the order of the pieces' scores
            usable = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (NORMAL, UNUSED)}
            order = sorted((i for p, i in usable.items() if len(p) > 1), key=lambda i: -proto.pieces[i].score)
            merges = [(p[:k], p[k:]) for p in (self.pieces[i] for i in order) for k in range(1, len(p)) if p[:k] in usable and p[k:] in usable]
            model = models.BPE({p: i for i, p in enumerate(self.pieces)}, merges, unk_token=self.pieces[self.unknown], fuse_unk=True, byte_fallback=trainer.byte_fallback)
        else:
            raise ValueError(f"model type {trainer.model_type} is neither unigram nor BPE")
        self.backend = Tokenizer(model)
        # the backend's own cache, one for each of its threads, would hold units that never come again
        if hasattr(self.backend.model, "_resize_cache"):
            self.backend.model._resize_cache(0)
        self.cuts = all(MARK not in p.lstrip(MARK) for p in self.pieces) and trainer.split_by_whitespace
        self.units = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+") if self.cuts else re.compile(r"(?s).+")
        self.reference = SentencePieceProcessor(model_proto=self.data)

    def normalise(self, text: str) -> str:
        """The text as the model sees it: its normaliser's map, blanks squeezed if it asks for that, marks for blanks, a mark in front."""
        if self.charsmap:
            text = self.charsmap.normalize_str(text)
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        return (MARK if self.dummy_prefix else "") + text.replace(" ", MARK)

    def alone(self, unit: str) -> str | None:
        """What the library is given to encode just these units; None where it would read anything else into them."""
        if not self.cuts or self.charsmap:
            return None
        if not self.dummy_prefix:
            return None if self.squeeze else unit.replace(MARK, " ")
        bare = unit[1:]
        if not bare or unit[0] != MARK or self.squeeze and (MARK in unit[-1] or MARK * 2 in unit):
            return None
        return bare.replace(MARK, " ")

    def _learn(self, units: list[str]) -> None:
        """Units of one mark and what follows it are encoded GROUP at a time: a piece with a mark begins the next one."""
        simple = [u for u in units if u.rfind(MARK) == 0 and len(u) > 1] if self.alone(MARK + "x") else []
        groups = [simple[k : k + GROUP] for k in range(0, len(simple), GROUP)]
        ids = self._encoded(list(map("".join, groups)))
        flat = np.array(list(chain.from_iterable(ids)), np.int32)
        ends = np.append(np.nonzero(self.begins[flat])[0], len(flat))
        if len(ends) == len(simple) + 1 and len(simple) > 1:
            self._keep(simple, flat, ends)
            units = list(set(units).difference(simple))
        ids = self._encoded(units)
        self._keep(units, np.array(list(chain.from_iterable(ids)), np.int32), np.cumsum([0, *map(len, ids)]))

    def _encoded(self, units: list[str]) -> list[list[int]]:
        encoded = [e.ids for e in self.backend.encode_batch_fast(units, add_special_tokens=False)]
        if self.verify:
            given, here = list(map(self.alone, units)), encoded
            if None in given:
                self.whole.update(u for u, g in zip(units, given, strict=True) if g is None)
                known = [k for k, g in enumerate(given) if g is not None]
                given, here = [given[k] for k in known], [encoded[k] for k in known]
            for text, ids, there in self._differences(given, here):
                raise ParityError(f"{text!r}: {ids} here, {there} in the library")
        return encoded

    def _keep(self, units: list[str], flat: np.ndarray, ends: np.ndarray) -> None:
        """Ids of units one after another; those of unit k end where those of the next begin."""
        data, ids = flat.tobytes(), flat.tolist()
        spelled = list(map(self.pieces.__getitem__, ids))
        bounds = ends.tolist()
        for unit, a, b in zip(units, bounds, bounds[1:], strict=False):
            self.cache[unit] = data[4 * a : 4 * b]
            if "".join(spelled[a:b]) != unit and self._spelled(ids[a:b]) != unit:
                self.lossy.add(unit)

    def _differences(self, texts: list[str], here: list[list[int]]) -> Iterator[tuple[str, list[int], list[int]]]:
        there = self.reference.encode(texts, num_threads=1) if texts else []
        if there != here:
            yield from ((t, a, b) for t, a, b in zip(texts, here, there, strict=True) if a != b)

    def encode_slice(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """The ids of each text, as int32, and whether they give its normalised form again."""
        cut = [self.units.findall(self.normalise(t)) for t in texts]
        seen = set(chain.from_iterable(cut))
        new = list(seen.difference(self.cache))
        if new and len(self.cache) + len(new) > MOST_CACHED:
            # what this slice has of it stays: the frequent units
            self.cache = {u: self.cache[u] for u in seen if u in self.cache}
            self.lossy &= seen
            self.whole &= seen
        if new:
            gc.disable()  # the many small objects made here hold no cycles
            try:
                self._learn(new)
            finally:
                gc.enable()
        get = self.cache.__getitem__
        out = [self._fused(b"".join(map(get, units))) for units in cut]
        whole, lossy = self.whole & seen, self.lossy & seen
        if whole:
            some = [k for k, units in enumerate(cut) if not whole.isdisjoint(units)]
            for text, ids, there in self._differences([texts[k] for k in some], [np.frombuffer(out[k], np.int32).tolist() for k in some]):
                raise ParityError(f"{text!r}: {ids} here, {there} in the library")
        return out, [lossy.isdisjoint(units) for units in cut] if lossy else [True] * len(texts)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(b, np.int32).tolist() for b in self.encode_slice(texts)[0]]

    def _fused(self, data: bytes) -> bytes:
        """Without byte fallback, unknown ids side by side are one, across units too."""
        if self.bytes:
            return data
        ids = np.frombuffer(data, np.int32)
        lost = ids == self.unknown
        again = np.zeros(len(ids), bool)
        again[1:] = lost[1:] & lost[:-1]
        return ids[~again].tobytes() if again.any() else data

    def _spelled(self, ids: list[int]) -> str:
        """Pieces and bytes joined (wrong bytes become U+FFFD), control pieces left out; ids that are no piece's, and null, count as unknown."""
        out, held = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            if i is None or not 0 <= i < len(self.pieces) or self.kinds[i] == UNKNOWN:
                out.append(" ⁇ ")
            elif self.kinds[i] != CONTROL:
                out.append(self.pieces[i])
        out.append(held.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: see `_spelled`; marks as blanks, the mark in front dropped."""
        text = self._spelled(ids).replace(MARK, " ")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def codec(data: bytes, verify: bool = True) -> Codec:
    """One codec for each worker and model."""
    return Codec(data, verify)


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", slice_rows: int = 256, verify: bool = True) -> DataFrame:
    """For each row: doc_id, n_ids, n_unknown, ids, round_trip.

    round_trip tells whether the decoded ids give the normalised text again, which they do
    unless a character is unknown and there is no byte fallback; a U+2581 in a text comes back
    as a blank and counts as equal to one. Null and empty texts have no ids and round_trip
    true. Repeated rows, and those with a null identifier, give one output row each. An empty table gives an empty result. Other
    columns are ignored. Every distinct unit, or the whole text where it has to be that, is
    compared with the sentencepiece library; a difference raises ParityError.
    """
    with open(model_path, "rb") as f:
        data = f.read()
    held = docs.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(held.value, verify)
        for batch in batches:
            for at in range(0, len(batch), slice_rows):
                part = batch.slice(at, slice_rows)
                ids, back = own.encode_slice(part["text"].to_pylist())
                values = np.frombuffer(b"".join(ids), np.int32)
                ends = np.cumsum([0, *(len(i) // 4 for i in ids)])
                lost = np.concatenate([[0], np.cumsum(values == own.unknown)])[ends]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(np.diff(ends)), pa.array(np.diff(lost)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values)), pa.array(back)], ["doc_id", "n_ids", "n_unknown", "ids", "round_trip"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_ids long, n_unknown long, ids array<int>, round_trip boolean")


def decode_ids(ids: Column, model_path: str, spark) -> Column:
    """The text of an array of ids; null for null, nothing for an empty one. An id that is no piece's, or null, reads as the unknown piece."""
    with open(model_path, "rb") as f:
        held = spark.sparkContext.broadcast(f.read())

    @F.arrow_udf("string")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(held.value)
        for batch in batches:
            yield pa.array([None if x is None else own.decode(x) for x in batch.to_pylist()], pa.string())

    return decoded(ids)
