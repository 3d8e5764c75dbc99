"""SentencePiece encoding and decoding with a forward pass shared over common prefixes.

A text becomes marked words (runs of the blank mark and what follows them, which no piece of the vocabulary crosses).
The distinct words of a slice of rows are sorted, which lists a trie depth first; what the forward pass knows about the
prefix that a word shares with the one before is kept, and only the rest is computed.

For a unigram model the forward pass is Viterbi: the best score of each prefix and the size of its last token. A file
with a BPE model can be taken either way. `unigram` makes a unigram model of its pieces: the score of a piece is minus
the logarithm of its rank in the file, as token frequencies go by Zipf's law; nothing is trained, and the public
library loads the result too. Or its own BPE ids are given: sums of scores would not give that segmentation, so the pass
then keeps for each prefix the last token of the prefix's own BPE encoding. That is exact: a sequence of tokens is the
encoding of their text if and only if each adjacent pair is the encoding of its own.
"""

from __future__ import annotations

import math
import re
import struct
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from millrace.llm.shared import pieces as slices

MARK = "▁"
#: Sizes of pieces of several characters that may end where a word has so many.
_SHORT, _OTHERS = ((), (), (2,), (3, 2)), (3, 2)
#: Words, and token pairs, that a worker remembers within a partition, some 200 bytes each; twice as many words at most.
REMEMBER = 80_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of a protocol buffer."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = varint() if kind == 2 else 4 if kind == 5 else 8
            yield key >> 3, data[at : at + n]
            at += n


def _field(number: int, value: bytes | int) -> bytes:
    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def unigram(proto: bytes) -> bytes:
    """A unigram model of the pieces of a .model file: a piece's score is minus the logarithm of its rank, in steps of 1/64.

    In such steps sums are exact in the library's arithmetic, too, for texts of some ten thousand tokens.
    """
    out, rank = [], 1
    for field, value in _fields(proto):
        if field == 1:
            parts = dict(_fields(value))
            rank += parts.get(3, 1) == 1
            score = struct.pack("<f", -round(64 * math.log(rank)) / 64 if parts.get(3, 1) == 1 else 0.0)
            value = _field(1, parts[1]) + b"\x15" + score + _field(3, parts.get(3, 1))
        elif field == 2:
            value = b"".join(_field(f, v) for f, v in _fields(value) if f in (4, 24, 35)) + _field(3, 1)  # vocabulary size, blank mark's side, byte fallback
        out.append(_field(field, value))
    return b"".join(out)


class Vocabulary:
    """Pieces, scores and options of a .model file's bytes."""

    def __init__(self, proto: bytes) -> None:
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        self.raw: list[bytes] = []  # what a piece decodes to
        self.unknown, self.unigram, self.fallback, self.prefix = 0, True, False, True
        trainer = normalizer = b""
        for field, value in _fields(proto):
            if field == 1:
                parts = dict(_fields(value))
                piece, kind, i = parts[1].decode(), parts.get(3, 1), len(self.raw)
                self.raw.append(b"")
                if kind in (1, 4, 5):
                    self.id[piece] = i
                    self.score[piece] = float(np.frombuffer(parts[2], "<f4")[0]) if 2 in parts else 0.0
                    self.raw[i] = piece.replace(MARK, " ").encode()
                elif kind == 6:
                    self.bytes[int(piece[3:5], 16)] = i
                    self.raw[i] = bytes([int(piece[3:5], 16)])
                elif kind == 2:
                    self.unknown = i
                    self.raw[i] = " ⁇ ".encode()
            elif field == 2:
                trainer = value
            elif field == 3:
                normalizer = value
        options = dict(_fields(trainer))
        self.unigram, self.fallback = options.get(3, 1) == 1, bool(options.get(35, 0))
        if options.get(3, 1) not in (1, 2):
            raise ValueError("only unigram and BPE models are known")
        options = dict(_fields(normalizer))
        if options.get(2) or options.get(4, 1):
            raise ValueError("only models that take a text as it is are known: no character map, extra blanks kept")
        self.prefix = bool(options.get(3, 1))
        self.longest = max(map(len, self.id), default=1)
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.id):
            raise ValueError("a piece crosses a word's beginning")
        self.split = re.compile(self._word()).findall
        self.lengths: dict[str, list[int]] = {}  # that pieces may have, by their last four characters, longest first
        for p in sorted(self.id, key=len, reverse=True):
            if len(p) > 3 and len(p) not in (known := self.lengths.setdefault(p[-4:], [])):
                known.append(len(p))
        for known in self.lengths.values():
            known += [3, 2]
        self.lowest = min(self.score.values(), default=0.0) - 10
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.gather: tuple = ()

    def _word(self) -> str:
        """Pattern of marked words; signs that no piece joins to letters, directly or over others, make words of their own."""
        signs = {chr(c) for c in range(128)} - {chr(c) for c in range(128) if chr(c).isalnum()}
        beside = {a + b for p in self.id for a, b in zip(p, p[1:], strict=False) if MARK not in (a, b)}
        while more := {c for ab in beside if (ab[0] in signs) != (ab[1] in signs) for c in ab if c not in signs}:
            signs |= more
        own = "".join(map(re.escape, sorted(signs)))
        return f"{MARK}*[^{MARK}{own}]+|{MARK}*[{own}]+|{MARK}+" if "a" not in signs else f"{MARK}*[^{MARK}]+|{MARK}+"

    def merge(self, text: str) -> list[str]:
        """BPE by its definition: merge the adjacent pair whose union has the best score, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.score[parts[i] + parts[i + 1]], -i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in self.score), default=None)
            if best is None:
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _follows(self, left: str, right: str) -> bool:
        if len(self.pairs) >= REMEMBER:
            self.pairs.clear()
        known = self.pairs[left, right] = self.merge(left + right) == [left, right]
        return known

    def _whole(self, piece: str) -> bool:
        known = self.whole[piece] = self.merge(piece) == [piece]
        return known

    def segment(self, ordered: Iterable[str]) -> Iterator[tuple[str, list[str]]]:
        """Tokens of each word; the words come sorted."""
        before, last, best = "", [0], [0.0]  # for each prefix of a word: size of its last token, best score
        for word in ordered:
            shared = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :], best[shared + 1 :]
            if self.unigram:
                self._viterbi(word, last, best)
            else:
                self._merged(word, last)
            before, out, at = word, [], len(word)
            while at:
                out.append(word[at - last[at] : at])
                at -= last[at]
            yield word, out[::-1]

    def _viterbi(self, word: str, last: list[int], best: list[float]) -> None:
        """Carries the forward pass on to the word's end; of equal scores the longer last token's."""
        score, lengths, lowest, none = self.score.get, self.lengths.get, self.lowest, -math.inf
        for end in range(len(last), len(word) + 1):
            choice, top = 0, -math.inf
            for size in lengths(word[end - 4 : end], _OTHERS) if end > 3 else _SHORT[end]:
                if size <= end:
                    s = score(word[end - size : end], none) + best[end - size]
                    if s > top:
                        choice, top = size, s
            if (s := score(word[end - 1], lowest) + best[end - 1]) > top:
                choice, top = 1, s
            best.append(top)
            last.append(choice)

    def _merged(self, word: str, last: list[int]) -> None:
        """As _viterbi, by what may follow what in a BPE encoding."""
        score, pairs, whole, lengths = self.score, self.pairs, self.whole, self.lengths
        for end in range(len(last), len(word) + 1):
            choice = 1
            for size in lengths.get(word[end - 4 : end], _OTHERS) if end > 3 else _SHORT[end]:
                if size <= end:
                    piece = word[end - size : end]
                    if piece in score and (whole[piece] if piece in whole else self._whole(piece)):
                        if size == end:
                            choice = size
                            break
                        left = word[end - size - last[end - size] : end - size]
                        known = pairs.get((left, piece))
                        if known or (known is None and self._follows(left, piece)):
                            choice = size
                            break
            last.append(choice)

    def ids(self, tokens: list[str]) -> list[int]:
        out: list[int] = []
        for t in tokens:
            if (i := self.id.get(t)) is not None:
                out.append(i)
            elif self.fallback:
                out.extend(self.bytes[b] for b in t.encode("utf-8", "surrogatepass"))
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as int32 bytes; null and empty texts have none."""
        split = [self.split(((MARK if self.prefix else "") + t.replace(" ", MARK)) if t else "") for t in texts]
        fresh = set().union(*split)
        if len(self.words) > REMEMBER:  # what was not used since the last time goes
            self.words, self.older = {}, self.words
        missing = [w for w in fresh if w not in self.words]
        self.words.update((w, self.older[w]) for w in missing if w in self.older)
        for word, tokens in self.segment(sorted(w for w in missing if w not in self.older)):
            ids = [self.id[t] if t in self.id else -1 for t in tokens]
            self.words[word] = array("i", ids if -1 not in ids else self.ids(tokens)).tobytes()
        known = self.words.__getitem__
        return [b"".join(map(known, words)) for words in split]

    def forget(self) -> None:
        """Empties what is remembered: an idle worker keeps nothing of its last partition."""
        self.words, self.older, self.pairs = {}, {}, {}

    def decode(self, ids: list[int]) -> str:
        data = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return data[1:] if self.prefix and data.startswith(" ") else data


    def decode_all(self, ids: pa.ListArray) -> pa.Array:
        """decode() of each list; null lists give null. The pieces' bytes are gathered by number where all texts are sound UTF-8."""
        if not self.gather:
            sizes = np.array([len(r) for r in self.raw], np.int64)
            self.gather = np.frombuffer(b"".join(self.raw), np.uint8), np.cumsum(sizes) - sizes, sizes, np.array([r[:1] == b" " for r in self.raw])
        pool, starts, sizes, blank = self.gather
        flat = ids.flatten().to_numpy()
        upto = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False))])
        begin, size = starts[flat], sizes[flat]
        if self.prefix:
            first = upto[:-1][upto[1:] > upto[:-1]]
            first = first[blank[flat[first]]]
            begin[first] += 1
            size[first] -= 1
        ends = np.concatenate([[0], np.cumsum(size)])
        data = pool[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])]
        offsets = ends[upto]
        try:
            data.tobytes().decode()
            inner = offsets[offsets < len(data)]
            sound = not (len(inner) and ((data[inner] & 0xC0) == 0x80).any()) and ends[-1] < 1 << 31
        except UnicodeDecodeError:
            sound = False
        if not sound:
            return pa.array([None if x is None else self.decode(x) for x in ids.to_pylist()], pa.string())
        texts = pa.StringArray.from_buffers(len(ids), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))
        return pc.if_else(ids.is_valid(), texts, pa.scalar(None, pa.string())) if ids.null_count else texts


@lru_cache(2)
def vocabulary(proto: bytes) -> Vocabulary:
    return Vocabulary(proto)


def _proto(path: str, kind: str) -> bytes:
    with open(path, "rb") as file:
        proto = file.read()
    if kind not in ("file", "unigram"):
        raise ValueError("kind is file or unigram")
    return proto if kind == "file" else unigram(proto)


def encode(docs: DataFrame, model: str, text_col: str = "text", kind: str = "file", ids_col: str = "ids") -> DataFrame:
    """docs with all its columns (repeated rows too) and ids_col (array<int>); a column of that name is replaced.

    kind "file" takes the model as it is, "unigram" its pieces with scores by rank. The driver reads the model file and
    broadcasts its bytes. Null and empty texts have no ids. A literal blank mark in a text is taken for a blank, as the
    format has it. A text is held whole by the task that reads it, with some 100 bytes for each of its words.
    """
    docs = docs.drop(ids_col)
    proto = docs.sparkSession.sparkContext.broadcast(_proto(model, kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(proto.value)
        for batch in slices(batches, text_col, 2 << 20):
            coded = known.encode(batch.column(text_col).to_pylist())
            ends = np.cumsum([0, *(len(c) // 4 for c in coded)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, ids_col])
        known.forget()

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(ids_col, ArrayType(IntegerType()))]))


def decode(rows: DataFrame, model: str, ids_col: str = "ids", out_col: str = "decoded", most: int = 1 << 18) -> DataFrame:
    """rows with all its columns and the text of its ids; null ids give null, no ids the empty text, bytes that are no UTF-8 the replacement character.

    About `most` ids are decoded at a time, those of one row at least. A column named out_col is replaced.
    """
    rows = rows.drop(out_col)
    proto = rows.sparkSession.sparkContext.broadcast(_proto(model, "file"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(proto.value)
        for batch in batches:
            upto = np.cumsum(pc.list_value_length(batch.column(ids_col)).fill_null(0).to_numpy(zero_copy_only=False))
            begin = 0
            while begin < batch.num_rows:
                end = max(begin + 1, int(np.searchsorted(upto, most + (upto[begin - 1] if begin else 0), side="right")))
                part = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([*part.columns, known.decode_all(part.column(ids_col))], names=[*part.schema.names, out_col])
                begin = end

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(out_col, StringType())]))
