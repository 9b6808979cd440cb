"""Whole-text encoding with a vocabulary file of the ``tokenizers`` library, memoised by text chunk.

A byte-pair vocabulary encodes every pre-token on its own, so a chunk of text between blanks always
yields the same ids.  ``ChunkEncoder`` keeps the ids of chunks it has met (as little-endian bytes)
and asks the library's model only for new pre-tokens.  Texts outside a charset on which the
pre-token rules are known exactly go to the library whole, so results always equal
``Tokenizer.encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from roundsmith.llm.words import KEPT, WordHasher, mix

#: Letters of Latin scripts that are in normal form C and have one-to-one lower case.
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-įı-ɏ"
_SAFE = re.compile(f"[\\x20-\\x7e\\n\\t\\r{_LETTERS}]*")
#: Blanks beside other white space join it into one pre-token, so such texts are not cut at blanks.
_MIXED_BLANKS = ("  ", " \n", "\n ", "\t", "\r")

#: The vocabularies' own pre-token rules, on the charset above.
_BYTE_RULE = re.compile(r" ?[^\W\d_]+|'(?:[stmd]|re|ve|ll)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_WORD_RULE = re.compile(r"'(?:[stmd]|re|ve|ll)|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: Signs that are a pre-token of their own behind a word.
_STOPS = frozenset(".,;:!?")


def _byte_alphabet() -> dict[int, str]:
    """Byte-level vocabularies spell bytes by printable characters; the others move up from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, moved = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in table:
            table[b], moved = chr(256 + moved), moved + 1
    return table


_ALPHABET = _byte_alphabet()


class _Ids(dict):
    """Ids of chunks and pre-tokens; a missing one is asked from ``ask`` and kept while there is room."""

    def __init__(self, ask, max_entries: int):
        super().__init__()
        self.ask, self.max_entries = ask, max_entries

    def __missing__(self, key: str) -> bytes:
        got = self.ask(key)
        if len(key) <= 48 and len(self) < self.max_entries:
            self[key] = got
        return got


class ChunkEncoder:
    """``ids(text)`` gives the text's ids as little-endian unsigned 32-bit bytes.

    ``kind``: "byte" (blanks belong to the following word) or "word" (blanks dropped, lower case).
    At most ``max_entries`` strings of at most 48 characters are kept, some 140 bytes each; a full memory takes
    no more, which changes speed only.  Chunks and pre-tokens share it: a chunk that is one pre-token has its ids.

    Cases: the empty text has no ids; a text without blanks is one chunk, whatever its length; a text
    that holds a special token's string is encoded as the library does.
    """

    def __init__(self, path: str, kind: str, max_entries: int = 700_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model, self.kind = self.whole.model, kind
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.rule = _BYTE_RULE if kind == "byte" else _WORD_RULE
        self.known = _Ids(self._ask, max_entries)

    def _ask(self, chunk: str) -> bytes:
        letters = chunk[1:] if self.kind == "byte" and chunk[:1] == " " else chunk
        if not letters.isalpha():
            if letters[-1:] in _STOPS and letters[:-1].isalpha():
                return self.known[chunk[:-1]] + self.known[chunk[-1]]
            parts = self.rule.findall(chunk)
            if len(parts) != 1 or parts[0] != chunk:
                return b"".join(map(self.known.__getitem__, parts))
        spelled = chunk.encode().decode("latin-1").translate(_ALPHABET)
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if _SAFE.fullmatch(text) is None or any(s in text for s in self.special):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        if self.kind == "word":
            chunks = text.lower().split()
        elif any(s in text for s in _MIXED_BLANKS):
            chunks = self.rule.findall(text)
        else:
            chunks = text.replace(" ", "\x00 ").split("\x00")
        return b"".join(map(self.known.__getitem__, chunks))


class HashMemory:
    """Runs of ids by 64-bit hash: open addressing over NumPy arrays, looked up many at a time.

    Half of its 2 ** bits places may be taken: at 21 some 50 MB.  Two words of one hash would share their ids; among a
    million kept words a new one does so with a probability below 1e-13.
    """

    def __init__(self, bits: int = 21):
        self.bits, self.most = bits, 1 << (bits - 1)
        self.keys, self.slot_of = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
        self.ids, self.n_ids = np.zeros(1 << bits, np.uint32), 0
        self.begin, self.n = np.zeros(self.most + 1, np.int64), 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash's run, or -1."""
        out, left = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(left):
            held = self.keys[at]
            same = held == hashes[left]
            out[left[same]] = self.slot_of[at[same]]
            go = ~same & (held != 0)
            left, at = left[go], (at[go] + 1) & (len(self.keys) - 1)
        return out

    def lay(self, flat: np.ndarray) -> None:
        """Put ids behind the kept ones; they count as kept once ``add`` has taken them."""
        while self.n_ids + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        self.ids[self.n_ids:self.n_ids + len(flat)] = flat

    def add(self, hashes: np.ndarray, runs: list[bytes]) -> None:
        """Distinct new hashes and their runs; what there is no room for is not kept."""
        room = self.most - self.n
        hashes, runs = hashes[:room], runs[:room]
        if len(runs) == 0:
            return
        flat = np.frombuffer(b"".join(runs), "<u4")
        self.lay(flat)
        self.begin[self.n + 1:self.n + 1 + len(runs)] = self.n_ids + np.cumsum([len(r) // 4 for r in runs])
        number, left = np.arange(self.n, self.n + len(runs)), np.arange(len(runs))
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(left):
            free = self.keys[at] == 0
            self.keys[at[free]] = hashes[left[free]]  # of several at one place the last one stays
            won = free & (self.keys[at] == hashes[left])
            self.slot_of[at[won]] = number[left[won]]
            left, at = left[~won], (at[~won] + 1) & (len(self.keys) - 1)
        self.n, self.n_ids = self.n + len(runs), self.n_ids + len(flat)


class BatchEncoder:
    """``ids`` of all texts of an Arrow column: distinct words are looked up by hash, all at once; new ones go through ``ChunkEncoder``."""

    def __init__(self, path: str, kind: str):
        self.one, self.memory = ChunkEncoder(path, kind, max_entries=100_000), HashMemory()
        self.hasher = WordHasher(frozenset([0x20]) if kind == "byte" else frozenset([0x20, 0x09, 0x0A, 0x0D]), fold=False)

    def _alone(self, text: str) -> bool:
        """Whether the text's words can't be cut at blanks."""
        if _SAFE.fullmatch(text) is None or any(s in text for s in self.one.special):
            return True
        return self.one.kind == "byte" and (text[:1] == " " or text[-1:] == " " or any(s in text for s in _MIXED_BLANKS))

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit bytes."""
        rows = texts.to_pylist()
        alone = np.array([self._alone(t) for t in rows], bool)
        if alone.any():
            texts = pc.if_else(pa.array(alone), "", texts)
        if self.one.kind == "word":
            texts = pc.utf8_lower(texts)
        hashes, first, begin = self.hasher.placed(texts)
        if self.one.kind == "byte" and len(hashes):
            # A text's first word follows no blank: it is another word.
            heads = first[:-1][np.diff(first) > 0]
            hashes[heads] = mix(hashes[heads])
        words, where = np.unique(hashes, return_inverse=True)
        number = self.memory.find(words)
        new = np.flatnonzero(number < 0)
        runs: list[bytes] = []
        if len(new):
            runs = self._ask(texts, hashes, first, begin, words, new, where)
        # Runs of new words lie behind those of known ones.
        self.memory.lay(np.frombuffer(b"".join(runs), "<u4"))
        size = np.zeros(len(words), np.int64)
        at = np.zeros(len(words), np.int64)
        known = number >= 0
        at[known], size[known] = self.memory.begin[number[known]], self.memory.begin[number[known] + 1] - self.memory.begin[number[known]]
        size[new] = [len(r) // 4 for r in runs]
        at[new] = self.memory.n_ids + np.cumsum(size[new]) - size[new]
        n = size[where]
        ends = np.cumsum(n)
        flat = self.memory.ids[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(at[where] - (ends - n), n)].tobytes()
        if len(new):
            self.memory.add(words[new], runs)
        cut = (4 * np.concatenate([[0], ends])[first]).tolist()
        return [self.one.ids(t) if own else flat[a:b] for t, own, a, b in zip(rows, alone.tolist(), cut[:-1], cut[1:])]

    def _ask(self, texts: pa.Array, hashes: np.ndarray, first: np.ndarray, begin: np.ndarray, words: np.ndarray, new: np.ndarray, where: np.ndarray) -> list[bytes]:
        some = np.zeros(len(words), np.int64)
        some[where] = np.arange(len(where))  # a place of each word
        some = some[new]
        data = memoryview(texts.buffers()[2])
        ends = np.append(begin[1:], len(data))[some]
        offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        stop = offsets[np.searchsorted(offsets, begin[some], "right")]
        ends = np.minimum(ends, stop)
        head = np.zeros(len(begin), bool)
        head[first[:-1][np.diff(first) > 0]] = True
        blanks = " " if self.one.kind == "byte" else " \t\n\r"
        lead = ["" if h or self.one.kind == "word" else " " for h in head[some].tolist()]
        return [self.one._ask(b + bytes(data[x:y]).decode().rstrip(blanks)) for b, x, y in zip(lead, begin[some].tolist(), ends.tolist())]


def encoder(path: str, kind: str) -> BatchEncoder:
    """The Python worker's encoder, kept from task to task under the key (path, kind)."""
    if (path, kind) not in KEPT:
        KEPT.clear()
        KEPT[path, kind] = BatchEncoder(path, kind)
    return KEPT[path, kind]
