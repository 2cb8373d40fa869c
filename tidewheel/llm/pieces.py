"""SentencePiece byte-pair encoding by a table of last tokens, and decoding.

In byte-pair encoding the encoding of a prefix is a prefix of the encoding, and
a sequence of tokens is an encoding exactly if each neighbouring pair is one.
So each prefix of a text has one last token: the token that ends there, found
with an automaton of all tokens, whose pair with the last token of what lies
before it is *compatible*, that is, encodes to itself. The table is filled from
left to right, and the ids are read from it backwards.

No token contains a word separator after another character, which is checked
when a model is loaded; texts are therefore cut before separators, and the
encodings of frequent words are remembered within a bound. Where many words of a
batch are not remembered, the short ones are encoded side by side by the merge rule:
each step merges the best pair of every word, the leftmost of equals.

Null texts count as empty. An empty text has no tokens but the begin and end
ids. Equal texts get equal ids; rows are never merged, and an empty table gives
an empty table. Other columns are carried along.
"""

from __future__ import annotations

import re
import struct
from bisect import bisect_right
from itertools import pairwise

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from tidewheel.llm.common import append, utf8

SEPARATOR = "▁"
#: How many words, and how many token pairs, a worker remembers.
WORDS_KEPT = 200_000
PAIRS_KEPT = 500_000
#: Longer words are encoded each time they occur.
LONG_WORD = 48
#: So many words are worth a step of their own over all; they are merged in blocks of this size.
MANY_WORDS, BLOCK_WORDS = 64, 2048
#: Texts are encoded together up to so many characters.
TOGETHER = 1 << 21
#: The rank of a pair that does not merge.
NEVER = 1 << 30
#: A model file beyond this is refused: it is sent to every worker.
MODEL_BYTES = 64 << 20

NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


class PieceTable:
    """Encoder and decoder of one byte-pair model with byte fallback."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto.FromString(model)
        rules = spec.normalizer_spec
        if spec.trainer_spec.model_type != 2 or not spec.trainer_spec.byte_fallback:
            raise ValueError("only byte-pair models with byte fallback are supported")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces:
            raise ValueError("only models that leave the text as it is are supported")
        if not rules.escape_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that mark the start of a word are supported")
        if {p.type for p in spec.pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("user-defined and unused pieces are not supported")
        self.prefix = SEPARATOR if rules.add_dummy_prefix else ""
        self.begin, self.end = spec.trainer_spec.bos_id, spec.trainer_spec.eos_id
        self.pieces = [p.piece for p in spec.pieces]
        self.kinds = [p.type for p in spec.pieces]
        normal = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == NORMAL}
        self.ids = normal
        self.scores = {s: spec.pieces[i].score for s, i in normal.items()}
        single = {s for s in normal if len(s) == 1}
        if any(c not in single for s in normal for c in s):
            raise ValueError("a character of a piece is no piece itself")
        if any(SEPARATOR in s.lstrip(SEPARATOR) for s in normal):
            raise ValueError("a piece crosses the start of a word")
        self.byte_ids = [0] * 256
        for i, p in enumerate(spec.pieces):
            if p.type == BYTE:
                self.byte_ids[int(p.piece, 16) if "<" not in p.piece else int(p.piece[1:-1], 16)] = i
        self.surfaces = [self._surface(i, spec.trainer_spec.unk_surface) for i in range(len(self.pieces))]
        self.automaton = ahocorasick.Automaton()
        for s, i in normal.items():
            self.automaton.add_word(s, (i, len(s)))
        self.automaton.make_automaton()
        # A line feed is no piece in most models; ending a word there keeps words short.
        stop = "" if "\n" in single else "\n"
        self.words = re.compile(f"{SEPARATOR}*[^{SEPARATOR}{stop}]+|{SEPARATOR}+|{stop or SEPARATOR}")
        self._merges(normal)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}

    def _surface(self, i: int, unknown: str) -> bytes:
        if self.kinds[i] == CONTROL:
            return b""
        if self.kinds[i] == UNKNOWN:
            return unknown.encode()
        if self.kinds[i] == BYTE:
            return bytes([int(self.pieces[i][1:-1], 16)])
        return self.pieces[i].replace(SEPARATOR, " ").encode()

    def _merges(self, normal: dict[str, int]) -> None:
        """Arrays of the pairs that merge, by key: their ranks (by score, equal scores alike) and what they become."""
        self.none = len(self.pieces)
        found = [
            (normal[s[:k]] * (self.none + 1) + normal[s[k:]], self.scores[s], i)
            for s, i in normal.items() for k in range(1, len(s)) if s[:k] in normal and s[k:] in normal
        ]
        found.sort()
        # The last pair can't occur, so a search always ends at a pair.
        self.keys = np.array([*[f[0] for f in found], (self.none + 1) ** 2], np.int64)
        self.ranks = np.append(np.unique([-f[1] for f in found], return_inverse=True)[1], NEVER).astype(np.int64)
        self.become = np.array([*[f[2] for f in found], 0], np.int64)
        singles = [(ord(s), i) for s, i in normal.items() if len(s) == 1]
        self.single = np.full(max([c for c, _ in singles], default=0) + 2, self.none, np.int64)
        for c, i in singles:
            self.single[c] = i

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * (self.none + 1) + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by the merge rule itself, which judges pairs."""
        symbols = list(text)
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                score = self.scores.get(symbols[i] + symbols[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def compatible(self, left: int, right: int) -> bool:
        fits = self.pairs.get((left, right))
        if fits is None:
            a, b = self.pieces[left], self.pieces[right]
            fits = self.merged(a + b) == [a, b]
            if len(self.pairs) >= PAIRS_KEPT:
                self.pairs.clear()
            self.pairs[left, right] = fits
        return fits

    def last_tokens(self, text: str) -> list[tuple[int, int] | None]:
        """For each prefix its last token and that token's length; None: no piece ends there."""
        last: list[tuple[int, int] | None] = [None] * len(text)
        known, compatible = self.pairs.get, self.compatible
        for end, match in self.automaton.iter(text):
            if last[end] is None:
                right, length = match
                before = end - length
                # A character that is no piece stands before: nothing merges with it.
                left = last[before] if before >= 0 else None
                if left is None:
                    last[end] = match
                else:
                    fits = known((left[0], right))
                    if fits or fits is None and compatible(left[0], right):
                        last[end] = match
        return last

    def word_ids(self, word: str) -> bytes:
        """The ids of a stretch between cuts, as packed 32-bit numbers."""
        last, ids, at = self.last_tokens(word), [], len(word) - 1
        while at >= 0:
            if last[at] is None:
                ids.extend(self.byte_ids[b] for b in reversed(word[at].encode()))
                at -= 1
            else:
                token, length = last[at]
                ids.append(token)
                at -= length
        ids.reverse()
        return struct.pack(f"<{len(ids)}I", *ids)

    def merged_ids(self, words: list[str]) -> list[bytes]:
        """The ids of each of many short words, as :meth:`word_ids` gives them."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        flat = self.single[np.minimum(codes, len(self.single) - 1)]
        width = int(sizes.max())
        # One more column stands for what follows the last symbol.
        ids = np.full((len(words), width + 1), self.none)
        ids[np.arange(width + 1) < sizes[:, None]] = flat
        rank = self._ranked(ids[:, :-1], ids[:, 1:])
        done, left, number = ids.copy(), np.arange(len(words)), sizes.copy()
        columns = np.arange(width + 1)
        while True:
            at = rank.argmin(axis=1)
            each = np.arange(len(left))
            going = rank[each, at] < NEVER
            if not going.all():
                done[left[~going]] = ids[~going]
                ids, rank, left, at = ids[going], rank[going], left[going], at[going]
                each = each[: len(left)]
            if not len(left):
                break
            key = ids[each, at] * (self.none + 1) + ids[each, at + 1]
            ids[each, at] = self.become[np.searchsorted(self.keys, key)]
            # What lies behind the pair moves up by one.
            after = np.minimum(columns + (columns > at[:, None]), width)
            ids = np.take_along_axis(ids, after, 1)
            rank = np.take_along_axis(rank, np.minimum(after[:, :-1], width - 1), 1)
            ids[:, -1], rank[:, -1] = self.none, NEVER
            number[left] -= 1
            rank[each, at] = self._ranked(ids[each, at], ids[each, at + 1])
            more = np.flatnonzero(at)
            rank[more, at[more] - 1] = self._ranked(ids[more, at[more] - 1], ids[more, at[more]])
        kept = columns < number[:, None]
        # A character that is no piece becomes bytes, as the table does it.
        odd = np.flatnonzero((kept & (done == self.none)).any(axis=1))
        packed, ends = done[kept].astype("<u4").tobytes(), [0, *(np.cumsum(number) * 4).tolist()]
        out = [packed[a:b] for a, b in pairwise(ends)]
        for i in odd.tolist():
            out[i] = self.word_ids(words[i])
        return out

    def _learn(self, words: list[str], new: dict[str, bytes]) -> None:
        """Put the ids of distinct words into ``new``."""
        words = sorted(words, key=len)
        short = bisect_right(words, LONG_WORD, key=len)
        if short < MANY_WORDS:
            short = 0
        for at in range(0, short, BLOCK_WORDS):
            part = words[at : min(at + BLOCK_WORDS, short)]
            new.update(zip(part, self.merged_ids(part)))
        for w in words[short:]:
            new[w] = self.word_ids(w)

    def encode(self, text: str) -> bytes:
        """All ids with begin and end, as little-endian unsigned 32-bit numbers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; words that are not remembered are encoded together."""
        out, at = [], 0
        while at < len(texts):
            size, start = 0, at
            while at < len(texts) and (at == start or size + len(texts[at]) <= TOGETHER):
                size += len(texts[at])
                at += 1
            out += self._encode_some(texts[start:at])
        return out

    def _encode_some(self, texts: list[str]) -> list[bytes]:
        begin, end, known = struct.pack("<I", self.begin), struct.pack("<I", self.end), self.known
        cut = [self.words.findall(self.prefix + x.replace(" ", SEPARATOR)) if x else [] for x in texts]
        new: dict[str, bytes] = {}
        self._learn([w for w in set().union(*cut) if w not in known], new)
        if len(known) + len(new) > WORDS_KEPT:
            # What these texts hold is kept beside the new words.
            held = {w: known[w] for w in set().union(*cut) if w in known}
            known.clear()
            known.update(held)
        known.update(new)
        out = [b"".join([begin, *map(known.__getitem__, words), end]) for words in cut]
        for w in new:
            if len(w) > LONG_WORD:
                del known[w]
        if len(known) > WORDS_KEPT:
            known.clear()
        return out

    def decode(self, packed: bytes) -> str:
        """The text of packed ids; a byte that is no UTF-8 becomes U+FFFD by itself."""
        ids = struct.unpack(f"<{len(packed) // 4}I", packed)
        data = b"".join(map(self.surfaces.__getitem__, ids))
        if self.prefix and data[:1] == b" ":
            first = next(i for i in ids if self.kinds[i] != CONTROL)
            if self.kinds[first] == NORMAL:
                data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return _singly(data)


def _singly(data: bytes) -> str:
    out, at = [], 0
    while at < len(data):
        try:
            out.append(data[at:].decode())
            break
        except UnicodeDecodeError as bad:
            out.append(data[at : at + bad.start].decode() + "�")
            at += bad.start + 1
    return "".join(out)


def read_model(path: str) -> bytes:
    """The model file, read on the driver."""
    with open(path, "rb") as file:
        model = file.read(MODEL_BYTES + 1)
    if len(model) > MODEL_BYTES:
        raise ValueError(f"the model is larger than {MODEL_BYTES} bytes")
    return model


def encode(df: DataFrame, model: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds ``ids``: the ids of ``text``, packed as little-endian 32-bit numbers."""
    sent = df.sparkSession.sparkContext.broadcast(read_model(model))

    def make():
        table = PieceTable(sent.value)
        return lambda texts: [table.encode_all([x or "" for x in texts.to_pylist()])]

    return append(df, make, [text], f"`{ids}` binary")


def decode(df: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds ``text``: what the packed ids stand for; null ids give an empty text."""
    sent = df.sparkSession.sparkContext.broadcast(read_model(model))

    def make():
        table = PieceTable(sent.value)
        return lambda packed: [[table.decode(x) for x in utf8(packed)]]

    return append(df, make, [ids], f"`{text}` string")


def round_trip(df: DataFrame, model: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds ``ids`` and what they decode to, as :func:`encode` and :func:`decode` do, in one pass.

    One Python worker does both for a task, where the two steps in a row hold two.
    """
    sent = df.sparkSession.sparkContext.broadcast(read_model(model))

    def make():
        table = PieceTable(sent.value)

        def both(texts):
            packed = table.encode_all([x or "" for x in texts.to_pylist()])
            return [packed, list(map(table.decode, packed))]

        return both

    return append(df, make, [text], f"`{ids}` binary, `{decoded}` string")
