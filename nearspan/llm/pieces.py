"""SentencePiece encoding and decoding with offsets into the original bytes.

The library gives ids and decoded texts. ``Normalizer`` replays a model's normalisation:
longest prefixes are replaced through its compiled character map, spaces removed, escaped
and put in front or behind as the model says, and every normalised byte remembers the
original byte it stands for. Pieces stand one behind the other in the normalised text, so
their edges there project to byte spans of the original.

Defined cases: a null text counts as empty; an empty text has no pieces and decodes to "";
an empty table gives an empty result; ids are those of the library without begin, end or
sampling; doc_ids may be null or repeated and other columns have any name (they are never
looked at). Rows are independent; a very long text is encoded whole. What normalisation
removes (extra spaces) belongs to no piece or to the one before it; a space put in front or
behind has no bytes of its own.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from nearspan.llm.common import map_rows

SPACE = "▁"


class CharMap:
    """The compiled map of a model: a double-array trie and its replacement strings."""

    def __init__(self, blob: bytes):
        self.units, self.strings = np.zeros(0, np.uint32), b""
        if blob:
            (size,) = struct.unpack("<I", blob[:4])
            self.units = np.frombuffer(blob[4 : 4 + size], "<u4")
            self.strings = blob[4 + size :]

    def __bool__(self) -> bool:
        return len(self.units) > 0

    def longest(self, data: bytes, at: int) -> tuple[int, int]:
        """(length, offset of the replacement) of the longest prefix at ``at``; length 0 if none."""
        found, node = (0, 0), 0
        unit = int(self.units[0])
        node ^= (unit >> 10) << ((unit & 0x200) >> 6)
        for k in range(at, len(data)):
            if not data[k]:
                break
            node ^= data[k]
            unit = int(self.units[node])
            if unit & 0x800000FF != data[k]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                found = (k - at + 1, int(self.units[node]) & 0x7FFFFFFF)
        return found


class Normalizer:
    """A model's normalisation with the source of every byte."""

    def __init__(self, spec, suffix: bool, user_defined: list[bytes]):
        self.map = CharMap(spec.precompiled_charsmap)
        self.prefix, self.suffix = spec.add_dummy_prefix and not suffix, spec.add_dummy_prefix and suffix
        self.squeeze = spec.remove_extra_whitespaces
        self.space = SPACE.encode() if spec.escape_whitespaces else b" "
        self.own: dict[int, list[bytes]] = {}
        for symbol in sorted(user_defined, key=len, reverse=True):
            self.own.setdefault(symbol[0], []).append(symbol)
        #: Whether nothing but spaces is ever replaced.
        self.plain = not self.map and not self.own and not self.squeeze

    def _prefix(self, data: bytes, at: int) -> tuple[int, bytes]:
        """(bytes taken, what replaces them) at ``at``: a user-defined symbol, the longest mapped prefix, or a character."""
        for symbol in self.own.get(data[at], ()):
            if data.startswith(symbol, at):
                return len(symbol), symbol
        length, offset = self.map.longest(data, at) if self.map else (0, 0)
        if length:
            return length, self.map.strings[offset : self.map.strings.index(b"\0", offset)]
        length = 1
        while at + length < len(data) and data[at + length] & 0xC0 == 0x80:
            length += 1
        return length, data[at : at + length]

    def apply(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them (and their end) the original byte offset."""
        data = text.encode("utf-8", "replace")
        if not data:
            return b"", np.zeros(1, np.int64)
        if self.plain:
            front, back = (self.space if x else b"" for x in (self.prefix, self.suffix))
            width = np.where(np.frombuffer(data, np.uint8) == 32, len(self.space), 1)
            source = np.concatenate([np.zeros(len(front), np.int64), np.repeat(np.arange(len(data)), width), np.full(len(back) + 1, len(data))])
            return front + data.replace(b" ", self.space) + back, source
        out, source, at = [], [], 0
        while self.squeeze and at < len(data):
            length, piece = self._prefix(data, at)
            if piece != b" ":
                break
            at += length
        if at == len(data):
            return b"", np.array([at])
        if self.prefix:
            out.append(self.space)
            source += [at] * len(self.space)
        was_space = self.squeeze
        while at < len(data):
            length, piece = self._prefix(data, at)
            same = piece == data[at : at + length]
            if was_space:
                same, piece = same and piece[:1] != b" ", piece.lstrip(b" ")
            # An unchanged character keeps its bytes apart; a replacement stands for all it replaces.
            for k in range(len(piece)):
                c = piece[k : k + 1]
                c = self.space if c == b" " else c
                out.append(c)
                source += [at + k if same else at] * len(c)
            if piece:
                was_space = self.squeeze and piece.endswith(b" ")
            at += length
        normal = b"".join(out)
        end = at
        while self.squeeze and normal.endswith(self.space):
            normal = normal[: -len(self.space)]
            end = source[len(normal)]
            del source[len(normal) :]
        if self.suffix:
            normal += self.space
            source += [end] * len(self.space)
        return normal, np.array([*source, end])


class PieceCodec:
    """One model."""

    def __init__(self, model: str | bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        content = model
        if isinstance(model, str):
            with open(model, "rb") as f:
                content = f.read()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=content)
        spec = proto.ModelProto()
        spec.ParseFromString(content)
        self.byte = np.array([p.type == spec.SentencePiece.BYTE for p in spec.pieces])
        self.unknown = np.array([p.type == spec.SentencePiece.UNKNOWN for p in spec.pieces])
        #: Bytes of a piece in the normalised text; an unknown piece is as long as its text.
        self.lengths = np.array([1 if b else 0 if u else len(p.piece.encode()) for p, b, u in zip(spec.pieces, self.byte, self.unknown, strict=True)])
        own = [p.piece.encode() for p in spec.pieces if p.type == spec.SentencePiece.USER_DEFINED]
        self.normalizer = Normalizer(spec.normalizer_spec, spec.trainer_spec.treat_whitespace_as_suffix, own)

    def encode(self, texts: list[str | None]) -> list[tuple[list[int], str]]:
        """Of each text the ids, and the same ids in decimal joined by commas."""
        all_ids = self.library.encode([t or "" for t in texts], num_threads=1)
        return [(ids, ",".join(map(str, ids))) for ids in all_ids]

    def spans(self, text: str | None, ids: list[int]) -> np.ndarray:
        """Begin and end byte of each piece in the original text, one row a piece."""
        text = text or ""
        if not ids:
            return np.zeros((0, 2), np.int64)
        lengths = self.lengths[ids]
        if self.unknown[ids].any():
            lengths = np.where(self.unknown[ids], [len(p.encode()) for p in self.library.encode(text, out_type=str)], lengths)
        normal, source = self.normalizer.apply(text)
        edges = np.concatenate([[0], np.cumsum(lengths)])
        if edges[-1] != len(normal):
            raise ValueError(f"pieces hold {edges[-1]} bytes of {len(normal)} normalised ones")
        return np.stack([source[edges[:-1]], source[edges[1:]]], axis=1)

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


_CODECS: dict[bytes, PieceCodec] = {}


def codec(content: bytes) -> PieceCodec:
    """One codec per worker process and model."""
    key = hashlib.sha256(content).digest()
    if key not in _CODECS:
        _CODECS[key] = PieceCodec(content)
    return _CODECS[key]


def _model_bytes(path: str) -> bytes:
    # Read on the driver and shipped with the tasks: executors need no file of their own.
    with open(path, "rb") as f:
        return f.read()


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


_ENCODED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("begins", T.ArrayType(T.IntegerType())),
        T.StructField("ends", T.ArrayType(T.IntegerType())),
        T.StructField("decoded", T.StringType()),
    ]
)

_DIGEST = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
        T.StructField("spans_sha256", T.StringType()),
    ]
)


def encode_pieces(docs: DataFrame, model: str | None = None, text: str = "text") -> DataFrame:
    """Per document: doc_id, ids, byte spans (begins, ends) and the decoded text."""
    shared = docs.sparkSession.sparkContext.broadcast(_model_bytes(model or default_model()))

    def run(rows: dict) -> dict:
        c = codec(shared.value)
        ids = [i for i, _ in c.encode(rows[text])]
        spans = [c.spans(t, i) for t, i in zip(rows[text], ids, strict=True)]
        return {"doc_id": rows["doc_id"], "ids": ids, "begins": [s[:, 0].tolist() for s in spans], "ends": [s[:, 1].tolist() for s in spans], "decoded": [c.decode(i) if i else "" for i in ids]}

    return map_rows(docs, ["doc_id", text], _ENCODED, run)


def digest_pieces(docs: DataFrame, model: str | None = None, text: str = "text") -> DataFrame:
    """The same encoding, each output reduced to its digest where it is made.

    spans_sha256 digests begin and end of every piece as little-endian 64-bit integers.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_model_bytes(model or default_model()))
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def run(rows: dict) -> dict:
        c = codec(shared.value)
        out: dict = {f.name: [] for f in _DIGEST}
        for doc_id, t, (ids, joined) in zip(rows["doc_id"], rows[text], c.encode(rows[text]), strict=True):
            out["doc_id"].append(doc_id)
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(sha(joined.encode()))
            out["decoded_sha256"].append(sha((c.decode(ids) if ids else "").encode("utf-8", "replace")))
            out["spans_sha256"].append(sha(c.spans(t, ids).astype("<i8").tobytes()))
        return out

    return map_rows(docs, ["doc_id", text], _DIGEST, run)
