"""Token ids of whole texts by a public tokenizer file, with a per-worker memory of pieces.

The byte-level pre-tokenizer never joins a character to a space that follows it, so a text may
be cut wherever white space follows something else: the pieces are encoded one by one and their
ids joined. Pieces are words with the space before them; most repeat. A batch of texts is cut at
once, equal pieces are found by their hashes, and only those that the worker does not remember go
to the library. The memory is bounded in bytes; what was not asked for lately is forgotten first.
A text with white space other than space, tab and line ends is given to the library whole.
"""

from __future__ import annotations

import array
import os

import numpy as np

from leadlens.llm.common import word_hashes, worker_cache

#: Bytes of remembered pieces per worker.
MEMORY_BYTES = 96 << 20
#: Bytes of an entry beside its ids; pieces of more than LONG ids are forgotten first.
_ENTRY, LONG = 32, 64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 13, 32]] = True
#: All other white space in UTF-8: of one byte, of several.
_OTHER = [ch.encode() for ch in map(chr, range(0x3001)) if ch.isspace() and ch not in " \t\r\n"]
_OTHER_SHORT, _OTHER_LONG = [x for x in _OTHER if len(x) == 1], [x for x in _OTHER if len(x) > 1]
#: Marks that end a word; a run of them is one pre-token (no apostrophe: it begins contractions).
_TAIL = ".,;:!?#$%&*()|-\""


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Pieces:
    """The ids of single pieces, from the library."""

    def __init__(self, tokenizer):
        self.tokenizer, self.model = tokenizer, tokenizer.model
        # printable stand-ins of bytes, as byte-level vocabularies write them
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.stand_in = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.tails: dict[str, list[int]] = {"": []}

    def _run(self, run: str) -> list[int]:
        """A single pre-token, by the model's merges alone."""
        if run[:1] == " " and run.isascii():
            text = "\u0120" + run[1:]  # the stand-in of a space; other printable ASCII stands for itself
        elif run.isascii() and run.isalpha():
            text = run
        else:
            text = run.encode().decode("latin-1").translate(self.stand_in)
        return [t.id for t in self.model.tokenize(text)]

    def ids(self, piece: str) -> list[int]:
        word = piece.rstrip(_TAIL)
        if not (word[1:] if word[:1] == " " else word).isalpha():
            return self.tokenizer.encode(piece, add_special_tokens=False).ids
        if len(word) == len(piece):
            return self._run(piece)
        tail = piece[len(word):]  # letters, then marks: two pre-tokens
        if tail not in self.tails:
            self.tails[tail] = self._run(tail)
        return self._run(word) + self.tails[tail]


class _Memory:
    """Sorted hashes of pieces, each with the piece's first bytes and length (which tell pieces of
    equal hashes apart), the place and number of its ids in a pool, and the turn it was last used."""

    def __init__(self):
        self.turn = 0
        self.hashes, self.heads = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.at, self.many, self.used = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)
        self.pool = np.empty(0, np.uint32)

    def find(self, hashes: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of sorted hashes, whether they are held)."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, (self.hashes[at] == hashes) & (self.heads[at] == heads)

    def add(self, hashes: np.ndarray, heads: np.ndarray, ids: list[list[int]]) -> None:
        """New pieces, by sorted hashes."""
        place, many = np.searchsorted(self.hashes, hashes), np.array([len(x) for x in ids], np.int32)
        at = len(self.pool) + np.cumsum(many, dtype=np.int64) - many
        flat = array.array("I")
        for x in ids:
            flat.extend(x)
        self.pool = np.concatenate((self.pool, np.frombuffer(flat, np.uint32) if flat else np.empty(0, np.uint32)))
        self.hashes, self.heads = np.insert(self.hashes, place, hashes), np.insert(self.heads, place, heads)
        self.at, self.many = np.insert(self.at, place, at), np.insert(self.many, place, many)
        self.used = np.insert(self.used, place, self.turn)

    def size(self) -> int:
        return _ENTRY * len(self.hashes) + 4 * len(self.pool)

    def forget(self, limit: int) -> None:
        """Keep short pieces used last, in half of the bytes."""
        keep = self.many <= LONG
        cost = np.where(keep, _ENTRY + 4 * self.many, 0)
        by_age = np.bincount(self.turn - self.used, cost)  # bytes of the pieces of each age
        keep &= self.turn - self.used < np.searchsorted(np.cumsum(by_age), limit // 2, side="right")
        many = self.many[keep]
        self.pool = self.pool[_spread(self.at[keep], many)]
        self.at = np.cumsum(many, dtype=np.int64) - many
        self.hashes, self.heads, self.many, self.used = self.hashes[keep], self.heads[keep], many, self.used[keep]


def _spread(at: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers at[i], at[i] + 1, ... (many[i] of them), one after another."""
    before = np.cumsum(many, dtype=np.int64) - many
    return np.repeat(at - before, many) + np.arange(int(many.sum()))


class Encoder:
    """batch(texts) -> little-endian uint32 bytes of each text's ids, followed by the end id."""

    def __init__(self, path: str, end_id: int = 0, memory_bytes: int = MEMORY_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.byte_level = "ByteLevel" in type(self.tokenizer.pre_tokenizer).__name__ and self.tokenizer.normalizer is None
        self.pieces, self.memory, self.limit = _Pieces(self.tokenizer), _Memory(), memory_bytes
        self.end = np.array([end_id], "<u4").tobytes()

    @classmethod
    def of(cls, path: str, end_id: int = 0) -> Encoder:
        cache = worker_cache()
        key = ("encoder", path, end_id)
        if key not in cache:
            cache[key] = cls(path, end_id)
        return cache[key]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes() + self.end

    def batch(self, texts: list[str], step: int = 4 << 20) -> list[bytes]:
        """Texts of ``step`` bytes, or a single longer one, are cut at a time."""
        out, group, size = [], [], 0
        for t in texts:
            group.append(t)
            size += len(t)
            if size >= step:
                out += self._group(group)
                group, size = [], 0
        return out + self._group(group)

    def _group(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        raw = [t.encode() for t in texts]
        plain = []
        for i, x in enumerate(raw):
            if (not self.byte_level or b"<|" in x or any(s in x for s in _OTHER_SHORT)
                    or not x.isascii() and any(s in x for s in _OTHER_LONG)):
                out[i] = self.whole(texts[i])
            else:
                plain.append(i)
        for i, ids in zip(plain, self._cut([raw[i] for i in plain]), strict=True):
            out[i] = self.whole(texts[i]) if ids is None else ids + self.end
        return out

    def _cut(self, raw: list[bytes]) -> list[bytes | None]:
        """The ids of texts, cut into pieces; None for a text that a collision of hashes may spoil."""
        joined = b"".join(raw) + bytes(8)
        data = np.frombuffer(joined, np.uint8)
        n = len(data) - 8
        lengths = np.array([len(x) for x in raw], np.int64)
        if not n:
            return [b""] * len(raw)
        space = _SPACE[data[:n]]
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        text_at = np.cumsum(lengths) - lengths
        begins[text_at[lengths > 0]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], n)
        size = ends - starts
        eight = np.ndarray((n + 1,), "<u8", joined, 0, (1,))  # the eight bytes from each place on
        heads = eight[starts] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (8 * (8 - np.minimum(size, 8))).astype(np.uint64))
        heads ^= size.astype(np.uint64) << np.uint64(40)
        hashes, first, piece = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        memory, own = self.memory, heads[first]
        memory.turn += 1
        at, held = memory.find(hashes, own)
        new = np.flatnonzero(~held)
        if len(new):
            spots = first[new]
            words = [joined[a:b].decode() for a, b in zip(starts[spots].tolist(), ends[spots].tolist(), strict=True)]
            memory.add(hashes[new], own[new], list(map(self.pieces.ids, words)))
            at, held = memory.find(hashes, own)
        memory.used[at] = memory.turn
        many = memory.many[at][piece]
        ids = memory.pool[_spread(memory.at[at][piece], many)].astype("<u4").tobytes()
        # pieces before each text, then ids before each piece
        bounds = 4 * np.concatenate(([0], np.cumsum(many, dtype=np.int64)))[np.searchsorted(starts, np.append(text_at, n))]
        out: list[bytes | None] = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for i in np.flatnonzero((heads != own[piece]) | ~held[piece]).tolist():
            out[int(np.searchsorted(text_at, starts[i], side="right")) - 1] = None
        if memory.size() > self.limit:
            memory.forget(self.limit)
        return out
