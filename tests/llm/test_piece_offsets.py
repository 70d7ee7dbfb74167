"""Spans of models built by hand, with a compiled character map, against the library's own offsets."""

import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2 as proto

from nearspan.llm.pieces import SPACE, PieceCodec

# Prefixes and what replaces them; the longest prefix wins.
REPLACED = {"ﬁ": "fi", "e\u0301": "é", "e\u0302x": "EX", "\u3000": " ", "\t": " ", "½": "1 2", "\u00ad": "", "aa": "b", "aaa": "c", "×": "  x "}


def compiled(table):
    """A double-array trie with a block of 256 units for each node, then the replacements."""
    strings, at, tree = b"", {}, {}
    for key, value in table.items():
        at[key] = len(strings)
        strings += value.encode() + b"\0"
        node = tree
        for c in key.encode():
            node = node.setdefault(c, {})
        node[None] = at[key]
    units, queue = [0] * 256, [(0, tree)]
    while queue:
        where, node = queue.pop()
        base = len(units)
        units += [0] * 256
        units[where] |= (where ^ base) << 10 | (None in node) << 8
        for c, below in node.items():
            if c is None:
                units[base] = 0x80000000 | below
            else:
                units[base ^ c] |= c
                queue.append((base ^ c, below))
    blob = struct.pack(f"<{len(units)}I", *units)
    return struct.pack("<I", len(blob)) + blob + strings


def model(squeeze, suffix, prefix, bytes_too):
    m = proto.ModelProto()
    kinds = m.SentencePiece
    add = lambda piece, kind, score=0.0: m.pieces.add(piece=piece, type=kind, score=score)
    add("<unk>", kinds.UNKNOWN)
    add("<s>", kinds.CONTROL)
    add("<sep>", kinds.USER_DEFINED)
    add("aab", kinds.USER_DEFINED)
    if bytes_too:
        for k in range(256):
            add(f"<0x{k:02X}>", kinds.BYTE)
    for k, piece in enumerate(["fi", "ab", SPACE + "f", "x" + SPACE, "bé", *"abcfiéEX12x", SPACE]):
        add(piece, kinds.NORMAL, -1.0 - k / 10)
    m.trainer_spec.model_type = m.trainer_spec.UNIGRAM
    m.trainer_spec.treat_whitespace_as_suffix = suffix
    m.trainer_spec.byte_fallback = bytes_too
    m.normalizer_spec.name = "by hand"
    m.normalizer_spec.precompiled_charsmap = compiled(REPLACED)
    m.normalizer_spec.add_dummy_prefix = prefix
    m.normalizer_spec.remove_extra_whitespaces = squeeze
    m.normalizer_spec.escape_whitespaces = True
    return PieceCodec(m.SerializeToString())


KINDS = [(q, s, p, b) for q in (True, False) for s in (True, False) for p in (True, False) for b in (True, False)]
CODECS = {k: model(*k) for k in KINDS}
ALPHABET = ["a", "b", "aa", "e", "\u0301", "e\u0302x", "ﬁ", "½", " ", "  ", "\u3000", "\t", "\u00ad", "×", "<sep>", "aab", "☃", "ü", "x", "f", SPACE]


@pytest.mark.parametrize("kind", KINDS, ids=str)
@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=14).map("".join))
def test_spans_are_the_librarys(kind, text):
    codec = CODECS[kind]
    ids = codec.encode([text])[0][0]
    spans, found = codec.spans(text, ids), codec.library.encode(text, return_type="proto").pieces
    assert [p.id for p in found] == ids
    # The library gives all bytes of a character to the last of its byte pieces; ours have one each.
    own = [tuple(x) for x, k in zip(spans.tolist(), ids, strict=True) if not codec.byte[k]]
    assert own == [(p.begin, p.end) for p in found if not codec.byte[p.id]]
    assert (spans[1:, 0] >= spans[:-1, 0]).all() and (spans[:, 1] >= spans[:, 0]).all()


def test_longest_prefix_wins():
    codec = CODECS[False, False, False, False]
    assert codec.normalizer.apply("caaaaé")[0].decode() == "ccaé"
    assert codec.normalizer.apply("xaaab\u00ad")[0].decode() == "xaaab".replace("aaa", "c", 1)
