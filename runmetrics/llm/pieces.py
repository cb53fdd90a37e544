"""Encoding and decoding with a SentencePiece vocabulary by streaming Viterbi.

A text becomes ``▁`` and the text with ``▁`` for each blank. Its encoding is the segmentation with the largest sum of
piece scores; of equal sums the one whose last piece is longer (applied from the end) wins. A character that no piece
covers is written as its UTF-8 bytes and costs ``UNKNOWN`` below the lowest score.

The search keeps the best sum and the backpointer of each end position. A piece has at most ``longest`` characters, so
only the last ``longest`` positions can be extended. Whenever the backpointer paths of all of them meet in one
boundary, the ids before it are committed and forgotten. Where no piece of the vocabulary has a ``▁`` behind another
character, all paths meet at each blank, so words are encoded for themselves and those seen before are looked up, in a
table of at most two generations of ``REMEMBERED`` words.

Decoding joins the pieces, reads byte pieces as UTF-8, and drops the first blank; texts that hold ``▁`` themselves come
back with a blank there. Null texts count as empty: no ids. Repeated rows give repeated results, an empty table none;
other columns take no part.
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from .common import Memory, per_text

MODEL = "piece_bpe_32k.model"
BLANK = "▁"
UNKNOWN = 10.0
REMEMBERED = 300_000
_SCORE = 0  # the key of a node's score in the trie, beside characters
_NOWHERE = float("-inf")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


class Vocabulary:
    """Pieces with scores. ``pieces``: text to (id, score); ``bytes_from``: the id of byte 0, the others follow."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int]):
        self.pieces, self.byte_ids = pieces, byte_ids
        self.longest = max(map(len, pieces), default=1)
        self.unknown = min((score for _, score in pieces.values()), default=0.0) - UNKNOWN
        self.texts = {i: piece for piece, (i, _) in pieces.items()}
        self.byte_of = {i: byte for byte, i in enumerate(byte_ids)}
        # an ASCII byte is a character wherever it stands
        self.plain = self.texts | {i: chr(byte) for i, byte in self.byte_of.items() if byte < 128}
        self.separate = not any(BLANK in piece.lstrip(BLANK) for piece in pieces)
        self.memory = Memory(REMEMBERED)
        self.trie: dict = {}
        for piece, (_, score) in pieces.items():
            node = self.trie
            for character in piece:
                node = node.setdefault(character, {})
            node[_SCORE] = score

    @classmethod
    @functools.cache
    def load(cls, path: str | None = None) -> Vocabulary:
        """The vocabulary of a model file; a Python worker loads it once."""
        model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(MODEL))
        count, byte_ids, pieces = model.get_piece_size(), [0] * 256, {}
        for i in range(count):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(_BYTE.fullmatch(piece)[1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces[piece] = (i, model.get_score(i))
        return cls(pieces, byte_ids)

    def _ids(self, piece: str) -> list[int]:
        at = self.pieces.get(piece)
        return [at[0]] if at else [self.byte_ids[byte] for byte in piece.encode()]

    def _path(self, text: str, back: list[int], base: int, end: int) -> list[int]:
        """Ids of the best path from ``base``, where ``back`` begins, to ``end``."""
        cuts = [end]
        while cuts[-1] > base:
            cuts.append(back[cuts[-1] - base])
        cuts.reverse()
        return [i for a, b in zip(cuts, cuts[1:]) for i in self._ids(text[a:b])]

    def search(self, text: str) -> list[int]:
        """Ids of the best segmentation of ``text``."""
        root, unknown, count = self.trie, self.unknown, len(text)
        ids: list[int] = []
        base = 0  # the last committed boundary; positions before it are forgotten
        best, back = [0.0], [0]  # from ``base`` on
        check = 2 * self.longest
        for begin in range(count):
            if begin - base >= check:
                met = self._meeting(back, base, begin)
                if met > base:
                    ids += self._path(text, back, base, met)
                    best, back, base = best[met - base:], back[met - base:], met
                check = begin - base + self.longest
            own = best[begin - base]
            at = begin - base + 1
            if at == len(best):
                best.append(own + unknown)
                back.append(begin)
            elif own + unknown > best[at]:
                best[at], back[at] = own + unknown, begin
            node = root
            for character in text[begin:begin + self.longest]:
                node = node.get(character)
                if node is None:
                    break
                while at >= len(best):
                    best.append(_NOWHERE)
                    back.append(begin)
                score = node.get(_SCORE)
                # sums that are equal keep the earlier begin, the longer piece
                if score is not None and own + score > best[at]:
                    best[at], back[at] = own + score, begin
                at += 1
        return ids + self._path(text, back, base, count)

    def _meeting(self, back: list[int], base: int, begin: int) -> int:
        """The last boundary on the paths to all positions from ``begin`` on."""
        heads = set(range(begin, base + len(back)))
        while len(heads) > 1:
            last = max(heads)
            heads.discard(last)
            heads.add(back[last - base])
        return heads.pop()

    def units(self, text: str) -> list[str]:
        """The parts of a text that are encoded for themselves, each without the ``▁`` that it begins with."""
        if not text:
            return []
        if self.separate and text[0] != " " and "  " not in text and BLANK not in text:
            return text.split(" ")
        text = BLANK + text.replace(" ", BLANK)
        return [unit[1:] for unit in _UNIT.findall(text)] if self.separate else [text[1:]]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.units(text) for text in texts]
        known = self.memory.results(set().union(*split), lambda units: [array("I", self.search(BLANK + unit)).tobytes() for unit in units]).__getitem__
        return [np.frombuffer(b"".join(map(known, units)), "<i4") for units in split]

    def decode(self, ids: np.ndarray) -> str:
        ids = ids.tolist()
        found = list(map(self.plain.get, ids))
        if None not in found:  # no bytes of longer characters
            return "".join(found).replace(BLANK, " ")[1:]
        parts, raw = [], bytearray()
        for i, piece in zip(ids, found):
            if piece is None:
                raw.append(self.byte_of[i])
                continue
            if raw:
                parts.append(raw.decode(errors="replace"))
                raw.clear()
            parts.append(piece)
        parts.append(raw.decode(errors="replace"))
        return "".join(parts).replace(BLANK, " ")[1:]


_UNIT = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


def encode_decode(docs: DataFrame, path: str | None = None, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, ids, decoded, and their digests n_ids, ids_crc32, decoded_sha256, round_trip."""
    def make():
        vocabulary = Vocabulary.load(path)

        def each(texts):
            for text, ids in zip(texts, vocabulary.encode(texts)):
                decoded = vocabulary.decode(ids)
                rest = (len(ids), zlib.crc32(ids), hashlib.sha256(decoded.encode()).hexdigest(), decoded == text)
                yield (ids, decoded, *rest) if with_ids else rest

        return each

    fields = [("ids", pa.list_(pa.int32())), ("decoded", pa.string())] * with_ids + [
        ("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_())]
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(per_text(make, fields), f"doc_id {kind}, " + "ids array<int>, decoded string, " * with_ids
                             + "n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
