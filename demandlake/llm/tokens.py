"""Exact, cached encoding with public tokenizer files.

These tokenizers cut a text into pieces, a word, a number or a run of marks, and give each piece its
ids on its own. Pieces repeat, so a worker keeps the ids of those it has met. Here a batch of texts is
cut with NumPy, by the classes of its UTF-8 bytes, and all its pieces are looked up at once in a hash
table of arrays (128 bits of hash per piece); the new ones go to the library, many to a string, and
are told apart again by the bytes that each id stands for. What the byte classes do not cover, a run
of non-space that holds other than ASCII and Latin letters, is one piece for the library as a whole,
as white space always ends a piece; and a text with white space beyond ASCII, or with a special
token's string, is encoded whole, by the library's defaults.
"""

from __future__ import annotations

import os
import zlib
from functools import cache

import numpy as np

from .common import OTHER_SPACE

END_ID = 2
END = np.array([END_ID], "<u4").tobytes()
SLOTS = 1 << 22  # of the hash table
MOST_PIECES = 1_500_000  # known at a time, about 150 MB a worker; then all are forgotten
KEY_BYTES = 24  # of a piece in the hash table; longer ones are kept in a dictionary
JOINED = 48  # new pieces that go to the library in one string
LONG_TEXT = 4 << 20  # code points; a longer text is cut before white space and put together again

_END, _SPACE, _WHITE, _LETTER, _DIGIT, _MARK, _OTHER = range(7)
_NOTHING = 1  # entry of no ids


def vocab_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _classes() -> np.ndarray:
    """Class of each byte; those of two-byte letters are settled by ``_latin``."""
    out = np.full(256, _OTHER, np.uint8)
    out[:128] = _MARK
    out[0x1C:0x20] = _OTHER
    out[[9, 10, 11, 12, 13]] = _WHITE
    out[32] = _SPACE
    out[ord("0"):ord("9") + 1] = _DIGIT
    out[ord("a"):ord("z") + 1] = out[ord("A"):ord("Z") + 1] = out[0xC3:0xCA] = _LETTER
    out[0xFF] = _END
    return out


def _latin() -> tuple[np.ndarray, np.ndarray]:
    """For the 64 x 7 letters U+00C0 to U+024F and on to U+027F: whether each is one with a lower case of two bytes, and that lower case."""
    points = np.arange(0xC0, 0x280)
    lower = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 else 0 for c in points])
    plain = np.array([chr(c).isalpha() and c < 0x250 for c in points]) & (lower >= 0xC0) & (lower < 0x800)
    return plain, lower


_CLASS = _classes()
_PLAIN, _LOWER = _latin()
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def _hashes(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of keys of three words."""
    out = []
    for k in (0, 4):
        h = lengths.astype(np.uint64) * _ODD[k]
        for j in range(3):
            h = (h ^ words[j]) * _ODD[k + j + 1]
            h ^= h >> np.uint64(29)
        out.append(h)
    return out[0], out[1]


class _Table:
    """Entries by hash: open addressing in arrays, all keys of a call at once."""

    def __init__(self) -> None:
        self.hashes = np.zeros((SLOTS, 2), np.uint64)
        self.entry = np.full(SLOTS, -1, np.int32)

    def find(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 for new ones."""
        out = np.full(len(h), -1, np.int64)
        at = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            own = self.entry[at]
            hit = (own >= 0) & (self.hashes[at, 0] == h[left]) & (self.hashes[at, 1] == g[left])
            out[left[hit]] = own[hit]
            on = (own >= 0) & ~hit
            left, at = left[on], (at[on] + 1) & (SLOTS - 1)
        return out

    def add(self, h: np.ndarray, g: np.ndarray, entries: np.ndarray) -> None:
        """Distinct new keys."""
        at = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            free = self.entry[at] < 0
            self.entry[at[free]] = entries[left[free]]  # of several for one slot the last stays
            won = free & (self.entry[at] == entries[left])
            self.hashes[at[won], 0], self.hashes[at[won], 1] = h[left[won]], g[left[won]]
            left, at = left[~won], (at[~won] + 1) & (SLOTS - 1)


class Encoder:
    """Ids of whole texts. ``drops_space``: the tokenizer drops white space and case and tells every digit apart."""

    def __init__(self, path: str, drops_space: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.drops_space = drops_space
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes_of = np.zeros(max(vocab.values(), default=0) + 1, np.int64)  # that an id stands for: byte-level letters, but for a word's end mark
        self.bytes_of[list(vocab.values())] = [len(t.removesuffix("</w>")) for t in vocab]
        self._forget()

    def _forget(self) -> None:
        self.table = _Table()
        self.long: dict[bytes, int] = {}
        # entries 0, the end id, and 1, nothing
        self.ids, self.n_ids = np.array([END_ID] * 1024, "<u4"), 1
        self.start, self.size, self.n = np.zeros(1024, np.int64), np.zeros(1024, np.int64), 2
        self.size[0] = 1

    def _keep(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """New entries for ids laid end to end, ``sizes`` of them each."""
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(sizes) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        own = np.arange(self.n, self.n + len(sizes))
        self.ids[self.n_ids:self.n_ids + len(ids)] = ids
        self.start[own], self.size[own] = self.n_ids + np.cumsum(sizes) - sizes, sizes
        self.n, self.n_ids = self.n + len(sizes), self.n_ids + len(ids)
        return own

    def _alone(self, texts: list[str], end: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of texts by the library, ``end`` after each."""
        found = [[*e.ids, *end] for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for x in found for i in x], "<u4"), np.array([len(x) for x in found], np.int64)

    def _joined(self, pieces: list[bytes], lengths: np.ndarray, between: bytes, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of pieces that ``between`` keeps apart in one string; with ``skip`` it stands before the first too and has an id of its own."""
        if not pieces:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        groups = [(skip * between + between.join(pieces[a:a + JOINED])).decode() for a in range(0, len(pieces), JOINED)]
        ids = np.concatenate([np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(groups, add_special_tokens=False)])
        ends, read = np.cumsum(lengths + skip), np.cumsum(self.bytes_of[ids])
        cuts = np.searchsorted(read, ends)
        if not len(read) or read[-1] != ends[-1] or not np.array_equal(read[cuts], ends):  # not one piece each after all
            return self._alone([p.decode() for p in pieces])
        sizes = np.diff(cuts, prepend=-1)
        if skip:
            ids = np.delete(ids, cuts + 1 - sizes)
        return ids, sizes - skip

    def _learn(self, pieces: list[bytes], lengths: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Entries of new pieces; ``kinds``: 0 for the library alone, 1 after a space, 2 after none."""
        out = np.zeros(len(pieces), np.int64)
        for kind in np.unique(kinds).tolist():
            at = np.flatnonzero(kinds == kind)
            own = [pieces[i] for i in at.tolist()]
            if kind == 0:
                got = self._alone([p.decode() for p in own])
            elif self.drops_space:
                got = self._joined(own, lengths[at], b" ")
            else:
                got = self._joined(own, lengths[at], b"") if kind == 1 else self._joined(own, lengths[at], b"\n", 1)
            out[at] = self._keep(*got)
        return out

    def _cut(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(starts of pieces, the class of each one's first byte, which are runs for the library, bytes in the case that counts).

        ``data``: texts in UTF-8, each followed by a byte 255.
        """
        cls = _CLASS[data]
        plain = data
        after = np.flatnonzero((data >= 0x80) & (data < 0xC0))
        if len(after):
            lead = data[after - 1]
            two = (lead >= 0xC3) & (lead < 0xCA)
            letter = np.zeros(len(after), bool)
            point = ((lead[two] & 0x1F).astype(np.int64) << 6 | (data[after[two]] & 0x3F)) - 0xC0
            letter[two] = _PLAIN[point]
            cls[after] = np.where(letter, _LETTER, _OTHER)
            cls[after[two & ~letter] - 1] = _OTHER
        if self.drops_space:
            plain = np.where((data >= 65) & (data <= 90), data | 0x20, data)
            if len(after):
                at, low = after[letter], _LOWER[point[letter[two]]]
                plain[at - 1], plain[at] = 0xC0 | (low >> 6), 0x80 | (low & 0x3F)
        white = (cls == _SPACE) | (cls == _WHITE)
        was = np.concatenate([[_END], cls[:-1]])
        start = cls != was
        came_white = np.concatenate([[False], white[:-1]])
        if self.drops_space:
            start[white & came_white] = False
            start[cls == _DIGIT] = True
        else:
            goes_on = np.concatenate([~white[1:] & (cls[1:] != _END), [False]])
            start[white] = (~came_white | goes_on)[white]  # the last of a run stands apart, unless the text ends
            start[~white & came_white] = data[:-1][(~white & came_white)[1:]] != 32  # a space belongs to what follows
        self._contractions(plain, cls, start)
        runs = self._other_runs(cls, white, start)
        start[cls == _END] = True
        at = np.flatnonzero(start)
        return at, cls[at], runs[at], plain

    @staticmethod
    def _contractions(plain: np.ndarray, cls: np.ndarray, start: np.ndarray) -> None:
        """'s 't 'm 'd 're 've 'll where an apostrophe begins a piece: a piece of their own (fixed values)."""
        q = np.flatnonzero((plain == 39) & start)
        last = len(plain) - 1  # an end, not an apostrophe
        a, b = plain[q + 1], plain[np.minimum(q + 2, last)]
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = (((a == ord("r")) | (a == ord("v"))) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        for q, size in ((q[one], 2), (q[two], 3)):
            start[q + 1] = False
            then = q + size
            then = then[then < len(cls)]
            start[then[cls[then] == _LETTER]] = True

    @staticmethod
    def _other_runs(cls: np.ndarray, white: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Make each run of non-space with a byte of no known class one piece; which bytes lie in or just before one."""
        inside = np.zeros(len(cls), bool)
        odd = np.flatnonzero(cls == _OTHER)
        if not len(odd):
            return inside
        edge = np.flatnonzero(white | (cls == _END))  # the last byte is an end
        k = np.unique(np.searchsorted(edge, odd))
        firsts, ends = np.where(k > 0, edge[k - 1] + 1, 0), edge[k]
        for a, z in zip(firsts.tolist(), ends.tolist()):
            start[a + 1:z] = False
            inside[max(a - 1, 0):z] = True
        return inside

    def _encode(self, data: bytes, whole: dict[int, str], glued: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends) of the texts in ``data``; texts in ``whole`` are given to the library, ``glued`` ones go on in the next."""
        if self.n > MOST_PIECES:
            self._forget()
        raw = np.frombuffer(data, np.uint8)
        at, cls, odd, plain = self._cut(raw)
        ends = cls == _END
        text = np.cumsum(ends) - ends
        size = np.diff(at, append=len(raw))
        entry = np.full(len(at), _NOTHING, np.int64)
        entry[ends] = np.where(glued, _NOTHING, 0)
        use = ~ends & ~np.isin(text, list(whole)) if whole else ~ends
        if self.drops_space:
            use &= (cls != _SPACE) & (cls != _WHITE)
        odd &= ~((cls == _WHITE) | (cls == _SPACE)) | ((cls == _SPACE) & (size > 1))
        short = np.flatnonzero(use & (size <= KEY_BYTES))
        if len(short):
            body, own = np.where(odd.repeat(size), raw, plain) if self.drops_space and odd.any() else plain, size[short]
            padded = np.concatenate([body, np.zeros(KEY_BYTES + 8, np.uint8)])
            view = np.ndarray((len(padded) - 7,), np.uint64, padded.data, strides=(1,))
            words = np.stack([view[at[short] + 8 * j] & _MASK[np.clip(own - 8 * j, 0, 8)] for j in range(3)])
            h, g = _hashes(words, own)
            got = self.table.find(h, g)
            new = np.flatnonzero(got < 0)
            if len(new):
                _, first, of = np.unique(h[new], return_index=True, return_inverse=True)
                k = short[new[first]]
                kinds = np.where(odd[k] | (cls[k] == _WHITE) | ((cls[k] == _SPACE) & self._blank(raw, at[k], size[k])), 0, np.where(cls[k] == _SPACE, 1, 2))
                flat = padded.tobytes()
                learnt = self._learn([flat[a:z] for a, z in zip(at[k].tolist(), (at[k] + size[k]).tolist())], size[k], kinds)
                self.table.add(h[new[first]], g[new[first]], learnt.astype(np.int32))
                got[new] = learnt[of]
            entry[short] = got
        for i in np.flatnonzero(use & (size > KEY_BYTES)).tolist():
            piece = data[at[i]:at[i] + size[i]]
            if piece not in self.long:
                self.long[piece] = int(self._keep(*self._alone([piece.decode()]))[0])
            entry[i] = self.long[piece]
        kept = self.n, self.n_ids
        if whole:
            entry[np.flatnonzero(ends)[list(whole)]] = self._keep(*self._alone(list(whole.values()), (END_ID,)))
        sizes = self.size[entry]
        total = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.start[entry] - (total - sizes), sizes) + np.arange(total[-1] if len(total) else 0)]
        self.n, self.n_ids = kept  # whole texts are not kept
        return ids, total[ends]

    @staticmethod
    def _blank(raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether pieces that begin with a space are white space alone."""
        then = _CLASS[raw[np.minimum(at + 1, len(raw) - 1)]]
        return (size == 1) | (then == _SPACE) | (then == _WHITE)

    def encode_lists(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts laid end to end, end of each): END_ID closes every text; null is an empty text."""
        parts: list[str] = []
        glued: list[bool] = []
        whole: dict[int, str] = {}
        for t in texts:
            t = t or ""
            if OTHER_SPACE.search(t) or any(s in t for s in self.special):
                whole[len(parts)] = t
                parts.append("")
                glued.append(False)
                continue
            while len(t) > LONG_TEXT:
                cut = next((i for i in range(LONG_TEXT, 0, -1) if t[i] in " \t\n\r\x0b\x0c" and t[i - 1] not in " \t\n\r\x0b\x0c"), None)
                if cut is None:
                    break
                parts.append(t[:cut])
                glued.append(True)
                t = t[cut:]
            parts.append(t)
            glued.append(False)
        if not parts:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        data = b"\xff".join([p.encode("utf-8", "surrogatepass") for p in parts]) + b"\xff"
        own = np.array(glued, bool)
        ids, ends = self._encode(data, whole, own)
        return ids, ends[~own]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, END_ID last, as little-endian unsigned 32-bit integers."""
        ids, ends = self.encode_lists(texts)
        raw = ids.astype("<u4").tobytes()
        return [raw[4 * a:4 * z] for a, z in zip([0, *ends[:-1].tolist()], ends.tolist())]


@cache
def encoder(path: str, drops_space: bool) -> Encoder:
    """One per worker."""
    return Encoder(path, drops_space)


def crc(ids: bytes) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids)
