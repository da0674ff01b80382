"""SentencePiece encoding with byte offsets of the original text, and decoding.

A text is first normalised: at each place the longest key of the model's
compiled character map gives the replacement, all places of a text walking the
map's double array together, one byte deeper at a time. Every normalised byte
keeps the place of the source it came from, so each piece is projected back to
the bytes it stands for. Normalised texts are cut before blanks; distinct
segments are merged to pieces once, and ids, piece ends and source spans of
all occurrences are gathered from these.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm import flat
from riskframe.llm.common import fresh, utf8

MODEL = "piece_bpe_32k.model"
#: U+2581, which stands for a blank in pieces; a plain blank stands for it in what is normalised here.
BLANK = "▁".encode()
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


def model_path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(MODEL)


class CharMap:
    """A compiled character map: a double-array trie of byte strings and their replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        size = int(np.frombuffer(blob, "<u4", 1)[0])
        self.units = np.frombuffer(blob, "<u4", size // 4, 4)
        self.strings = np.frombuffer(blob, np.uint8, offset=4 + size)
        self.zeros = np.flatnonzero(self.strings == 0)

    @staticmethod
    def _offset(unit: np.ndarray) -> np.ndarray:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each start the bytes of the longest key there (0: none) and the place of its replacement."""
        length, value = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        alive = np.arange(len(starts))
        node = np.full(len(starts), int(self._offset(self.units[:1])[0]), np.int64)
        depth = 0
        while True:
            inside = starts[alive] + depth < len(data)
            alive, node = alive[inside], node[inside]
            if not len(alive):
                return length, value
            byte = data[starts[alive] + depth].astype(np.int64)
            node ^= byte
            real = node < len(self.units)
            alive, node, byte = alive[real], node[real], byte[real]
            unit = self.units[node].astype(np.int64)
            same = (unit & 0x800000FF) == byte
            alive, node, unit = alive[same], node[same], unit[same]
            node ^= self._offset(unit)
            depth += 1
            leaf = (unit >> 8) & 1 == 1
            length[alive[leaf]] = depth
            value[alive[leaf]] = self.units[node[leaf]].astype(np.int64) & 0x7FFFFFFF

    def sizes(self, value: np.ndarray) -> np.ndarray:
        """Bytes of the replacements at these places."""
        return self.zeros[np.searchsorted(self.zeros, value)] - value


class Pieces:
    """A SentencePiece model: normalises with alignment, encodes and decodes.

    Models need byte fallback (so that no piece stands for an unknown stretch)
    and no user-defined symbols.
    """

    def __init__(self, path: str | None = None, proto: bytes | None = None):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        if proto is None:
            with open(model_path(path), "rb") as f:
                proto = f.read()
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(proto)
        kinds = {p.type for p in model.pieces}
        if not model.trainer_spec.byte_fallback or kinds & {_USER, _UNUSED} or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("the model must have byte fallback, blanks as prefixes and no user-defined or unused pieces")
        rules = model.normalizer_spec
        self.map = CharMap(rules.precompiled_charsmap) if rules.precompiled_charsmap else None
        self.prefix, self.squeeze = rules.add_dummy_prefix, rules.remove_extra_whitespaces
        if not rules.escape_whitespaces:
            raise ValueError("the model must escape blanks")
        self.unknown = model.trainer_spec.unk_surface.encode()
        self.surface = [self._surface(p) for p in model.pieces]
        self.byte = np.array([p.type == _BYTE for p in model.pieces])
        self.text = [b"" if p.type == _CONTROL else self.unknown if p.type == _UNKNOWN else s for p, s in zip(model.pieces, self.surface)]
        self.width = np.array([len(s) for s in self.surface], np.int64)
        self.pool, self.start = np.frombuffer(b"".join(self.surface), np.uint8), np.cumsum(self.width) - self.width
        self.whole = np.array([p.type == _NORMAL for p in model.pieces])
        #: No piece has a blank after another character, so merging never reaches over the start of a run of blanks.
        self.cuts = not any(b" " in s.lstrip(b" ") for s in self.surface)
        rules.precompiled_charsmap = b""
        rules.add_dummy_prefix = rules.remove_extra_whitespaces = False
        self.merger = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.known = flat.Remembered(self._merged)

    @staticmethod
    def _surface(piece) -> bytes:
        if piece.type == _BYTE:
            return bytes([int(piece.piece[3:-1], 16)])
        return b"" if piece.type in (_CONTROL, _UNKNOWN) else piece.piece.encode().replace(BLANK, b" ")

    def _merged(self, segments: list[bytes]) -> list[bytes]:
        """Packed ids of normalised segments."""
        lists = self.merger.encode([s.decode() for s in segments], num_threads=1)
        raw = np.fromiter(chain.from_iterable(lists), "<u4").tobytes()
        ends = list(accumulate(4 * len(ids) for ids in lists))
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def normalised(self, text: bytes, prefix: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that are encoded, blanks plain, and the source byte of each (and of the end)."""
        data = np.frombuffer(text, np.uint8)
        n = len(data)
        if self.map is None:
            out, align = data, np.maximum.accumulate(np.where((data & 0xC0) != 0x80, np.arange(n), 0))
            units, lead = None, 0
        else:
            starts = np.flatnonzero((data & 0xC0) != 0x80)
            width = np.diff(starts, append=n)
            length, value = self.map.longest(data, starts)
            taken, end = np.ones(len(starts), bool), 0
            for i in np.flatnonzero(length > width).tolist():
                if starts[i] >= end:
                    end = int(starts[i] + length[i])
                    taken[i + 1 : np.searchsorted(starts, end)] = False
            starts, width, length, value = starts[taken], width[taken], length[taken], value[taken]
            mapped = length > 0
            at, count = starts.copy(), width.copy()
            at[mapped] = n + value[mapped]
            count[mapped] = self.map.sizes(value[mapped])
            out = np.concatenate([data, self.map.strings])[flat.indices(at, count)]
            align = np.repeat(starts, count)
            units, lead = (starts, count), 0
        consumed = n
        if self.squeeze:
            blank = out == 32
            if blank.all():
                if units is None or (units[1] == 1).all():
                    return np.zeros(0, np.uint8), np.zeros(1, np.int64)
            lead = self._lead(out, units, n)
            before = np.concatenate([[True], blank[:-1]])
            keep = ~(blank & before)
            out, align = out[keep], align[keep]
        marks = (out[:-2] == BLANK[0]) & (out[1:-1] == BLANK[1]) & (out[2:] == BLANK[2]) if len(out) > 2 else np.zeros(0, bool)
        if marks.any():
            keep, at = np.ones(len(out), bool), np.flatnonzero(marks)
            keep[at + 1] = keep[at + 2] = False
            out = out.copy()
            out[at] = 32
            out, align = out[keep], align[keep]
        if prefix and self.prefix and n:
            out, align = np.concatenate([np.uint8([32]), out]), np.concatenate([[lead], align])
        if self.squeeze and len(out):
            solid = np.flatnonzero(out != 32)
            last = int(solid[-1]) + 1 if len(solid) else 0
            if last < len(out):
                consumed = int(align[last])
                out, align = out[:last], align[:last]
        return out, np.append(align, consumed)

    @staticmethod
    def _lead(out: np.ndarray, units, n: int) -> int:
        """Source bytes of the blanks at the front."""
        if units is None:
            solid = np.flatnonzero(out != 32)
            return int(solid[0]) if len(solid) else n
        starts, count = units
        first = np.cumsum(count) - count
        blank = count == 1
        blank[blank] = out[first[blank]] == 32
        solid = np.flatnonzero(~blank)
        return int(starts[solid[0]]) if len(solid) else n

    def encoded(self, texts: list[bytes], prefix: list[bool] | None = None) -> tuple[np.ndarray, ...]:
        """(ids, edges of the texts among them, first and end source byte of each id, all normalised bytes, edges of the texts there)."""
        done = [self.normalised(t, p) for t, p in zip(texts, prefix or [True] * len(texts))]
        data = np.concatenate([np.zeros(0, np.uint8), *(d for d, _ in done)])
        size = np.array([len(d) for d, _ in done], np.int64)
        edges = np.concatenate([[0], np.cumsum(size)])
        if self.cuts:
            blank = data == 32
            first = blank.copy()
            first[1:] &= ~blank[:-1]
            first[edges[:-1][size > 0]] = True
            starts = np.flatnonzero(first)
        else:
            starts = edges[:-1][size > 0]
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        ids, counts = self.known.tokens(data, starts, ends)
        stop = np.cumsum(self.width[ids])
        tokens = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, edges)]
        if (stop[-1] if len(stop) else 0) != len(data):
            raise ValueError("pieces do not add up to the normalised text")
        align = np.concatenate([np.zeros(0, np.int64), *(a for _, a in done)])
        row = np.repeat(np.arange(len(texts)), np.diff(tokens))
        begin = np.concatenate([[0], stop[:-1]])[: len(stop)]
        return ids, tokens, align[begin + row], align[stop + row], data, edges

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The normalised bytes that these ids stand for, blanks plain."""
        return self.pool[flat.indices(self.start[ids], self.width[ids])]

    def decoded(self, ids: np.ndarray) -> bytes:
        """The text of a list of ids in UTF-8; bytes that are no character become U+FFFD each."""
        parts = [self.text[i] for i in ids.tolist()]
        if self.byte[ids].any():
            parts = self._bytes_checked(ids, parts)
        if self.prefix or self.squeeze:  # the blank put before the text goes again
            for k, part in enumerate(parts):
                if self.whole[ids[k]] and part[:1] == b" ":
                    part = parts[k] = part[1:]
                    if not self.squeeze:
                        break
                if part:
                    break
        return b"".join(parts)

    def _bytes_checked(self, ids: np.ndarray, parts: list[bytes]) -> list[bytes]:
        if all(parts):  # else something without text stands between bytes
            try:
                b"".join(parts).decode()
                return parts
            except UnicodeDecodeError:
                pass
        starts, ends = flat.runs(self.byte[ids], np.zeros(0, np.int64))
        for s, e in zip(starts.tolist(), ends.tolist()):
            raw = b"".join(parts[s:e])
            parts[s:e] = [_valid(raw), *[b""] * (e - s - 1)]
        return parts


def _valid(raw: bytes) -> bytes:
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                raw[at : at + n].decode()
            except UnicodeDecodeError:
                continue
            if at + n <= len(raw):
                out.append(raw[at : at + n])
                at += n
                break
        else:
            out.append(b"\xef\xbf\xbd")
            at += 1
    return b"".join(out)


def encode(docs: DataFrame, text: str = "text", model: str | None = None) -> tuple[DataFrame, list[str]]:
    """``docs`` with the ids of each text and the source bytes that each id stands for; and the names of the three columns.

    ``ids``, ``begins`` and ``ends`` are arrays of equal length; id k stands
    for the UTF-8 bytes from ``begins[k]`` to ``ends[k]`` (a blank put before
    the text has no bytes; of the byte pieces of one character the last has
    all). A null text counts as empty and has no ids. Texts are taken whole;
    repeated rows are rows like others; an empty table gives an empty result;
    clashing names get new columns with ``_`` appended.
    """
    names = fresh(docs, "ids", "begins", "ends")
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.ArrayType(T.IntegerType(), False)) for n in names)])
    at, columns = docs.columns.index(text), [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        for batch in flat.slices(batches, at):
            texts = [t or b"" for t in utf8(batch.column(at))]
            parts = _long(pieces, texts[0]) if len(texts) == 1 else None
            ids, edges, begin, end = parts or pieces.encoded(texts)[:4]
            lists = [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(x.astype(np.int32))) for x in (ids, begin, end)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], names=columns)

    return docs.mapInArrow(run, schema), names


def _long(pieces: Pieces, text: bytes) -> tuple[np.ndarray, ...] | None:
    """The parts of a very long text one after another; None unless the text may be cut."""
    if len(text) <= flat.STRETCH or pieces.map is not None or pieces.squeeze or not pieces.cuts:
        return None
    out, source = [], 0
    for k, part in enumerate(flat.chunks(text)):
        ids, _, begin, end, *_ = pieces.encoded([part], [k == 0])
        out.append((ids, begin + source, end + source))
        source += len(part)
    ids, begin, end = (np.concatenate(x) for x in zip(*out))
    return ids, np.array([0, len(ids)]), begin, end


def decode(rows: DataFrame, ids: str = "ids", model: str | None = None) -> tuple[DataFrame, str]:
    """``rows`` with the text of the ids in column ``ids``, and the name of the new column; null ids give null."""
    (name,) = fresh(rows, "decoded")
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())])
    at, columns = rows.columns.index(ids), [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                lists = part.column(at)
                texts = [pieces.decoded(x.values.to_numpy()) if x.is_valid else None for x in lists]
                made = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=columns)

    return rows.mapInArrow(run, schema), name


def digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, source_bytes) of every row: what `encode` and `decode` give, in short.

    ``source_bytes`` is the number of source bytes that the ids stand for.
    """
    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    done, (ids, begins, ends) = encode(plain, "text", model)
    back, decoded = decode(done.drop("text"), ids, model)
    covered = F.when(F.size(ids) > 0, F.element_at(ends, -1) - F.element_at(begins, 1)).otherwise(0)
    return back.select(
        "doc_id",
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col(ids).cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.encode(decoded, "UTF-8"), 256).alias("decoded_sha256"),
        covered.cast("long").alias("source_bytes"),
    )
