"""Exact token ids of the tokenizers library, through a table of the chunks that its merges cannot cross.

A tokenizer of this kind cuts a text into pre-tokens and merges inside each alone. So the ids of a text are those
of its pre-tokens one after another, and a bounded table from pre-token to ids spares nearly all merging; what the table
lacks is merged for many texts at once. All this runs over arrays of the bytes of many texts. It holds for texts of Latin-1
characters, whose pre-token rule is stated here by classes of bytes; for other texts the table is keyed by runs between
white space and the library splits them; texts with the string of a special token, or with the character 0, go to the library whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import cache
from struct import pack

import numpy as np

#: Latin-1 characters that are letters, numbers and white space by Unicode.
LETTERS, NUMBERS, BLANKS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
WIDE_BLANKS = BLANKS + "\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

MAX_ENTRIES = 600_000
#: Longer chunks are merged each time, so that the table is bounded in bytes.
LONGEST_KEPT = 64
#: Characters of a group of texts; words looked up at once; bytes of a word that the table's keys hold.
GROUP, SLICE, KEY_BYTES = 1 << 18, 1 << 17, 16


def _byte_letters() -> list[str]:
    """The visible character by which byte-level vocabularies write each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Merges:
    """BPE merging of many chunks at once, for models that start from bytes; exact: one step merges, in each chunk, the pair of
    the lowest rank, the leftmost of equals, as the library does chunk by chunk."""

    def __init__(self, model: dict):
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, made = (np.array([vocab[x] for x in part], np.int64) for part in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        order = np.argsort((left << 32) | right, kind="stable")
        self.pairs, self.rank, self.made = ((left << 32) | right)[order], order, made
        self.inner, self.last = (np.array([vocab[c + end] for c in _byte_letters()], np.int64) for end in ("", suffix))

    @staticmethod
    def of(spec: dict) -> Merges | None:
        """Merges of a tokenizer file, or None where its model has rules that these don't know."""
        model = spec["model"]
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        letters = [c + end for c in _byte_letters() for end in ("", model.get("end_of_word_suffix") or "")]
        return Merges(model) if plain and model["merges"] and all(c in model["vocab"] for c in letters) else None

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.rank[at], _NEVER)

    def ids(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks (bytes of each, none is empty), and how many each has."""
        ends = np.cumsum(size)
        seq = self.inner[data]
        seq[ends - 1] = self.last[data[ends - 1]]
        done, counts = np.zeros(len(seq), np.int64), size.copy()  # ids of finished chunks lie where their bytes lay
        base, own = ends - size, np.arange(len(size))
        first, rank = base, self._ranks(seq, np.append(seq[1:], 0))
        rank[ends - 1] = _NEVER
        while len(own):
            # The lowest rank of each chunk, with its place.
            best = np.minimum.reduceat((rank << 32) | np.arange(len(rank)), first)
            on = best < (_NEVER << 32)
            if not on.all():
                place = np.repeat(on, size)
                out = ~place
                n, to = size[~on], base[own[~on]]
                done[_spans(to, n)] = seq[out]
                counts[own[~on]] = n
                shift = np.cumsum(out) - out
                at = (best[on] & _PLACE) - shift[best[on] & _PLACE]
                seq, rank, own, size = seq[place], rank[place], own[on], size[on]
                if not len(own):
                    break
                first = np.cumsum(size) - size
            else:
                at = best & _PLACE
            seq[at] = self.made[rank[at]]
            keep = np.ones(len(seq), bool)
            keep[at + 1] = False
            closing = at + 1 == first + size - 1  # the merged symbol ends its chunk
            seq, rank = seq[keep], rank[keep]
            at = at - np.arange(len(at))
            size = size - 1
            first = np.cumsum(size) - size
            rank[at] = np.where(closing, _NEVER, self._ranks(seq[at], seq[np.minimum(at + 1, len(seq) - 1)]))
            before = at[at > first]
            rank[before - 1] = self._ranks(seq[before - 1], seq[before])
        return done[_spans(base, counts)], counts


_NEVER, _PLACE = np.int64(1 << 30), np.int64((1 << 32) - 1)


def _spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of n each, one span after another."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class _Words:
    """Words of 1 to 16 bytes, none of them 0, to their ids: open addressing over arrays, with whole words as keys."""

    def __init__(self, entries: int):
        self.entries, bits = entries, (2 * (entries + SLICE) - 1).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.low, self.high = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.start, self.count = np.full(1 << bits, -1, np.int32), np.zeros(1 << bits, np.int32)
        self.pool, self.used, self.ids = np.zeros(1 << 16, np.uint32), 0, 0

    def places(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The place of each of up to SLICE words; places new with this call, and the number of a word at each of these."""
        if self.used >= self.entries:
            self.start.fill(-1)
            self.used = self.ids = 0
        at = (((low ^ (high * _MIX[0])) * _MIX[1] ^ (low >> np.uint64(29))) * _MIX[0] >> self.shift).astype(np.int64)
        live, found, new, words = np.arange(len(low)), np.zeros(len(low), np.int64), [], []
        while len(live):
            free = self.start[at] < 0
            if free.any():
                place, word = at[free], live[free]
                self.start[place] = word  # of several words the last one gets the place
                won = self.start[place] == word
                place, word = place[won], word[won]
                self.low[place], self.high[place] = low[word], high[word]
                new.append(place)
                words.append(word)
            same = (self.low[at] == low[live]) & (self.high[at] == high[live])
            found[live[same]] = at[same]
            live, at = live[~same], (at[~same] + 1) & self.mask
        new, words = np.concatenate(new or [live]), np.concatenate(words or [live])
        self.used += len(new)
        return found, new, words

    def learn(self, places: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        while self.ids + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.ids : self.ids + len(ids)] = ids
        self.start[places], self.count[places] = self.ids + np.cumsum(count) - count, count
        self.ids += len(ids)


_MIX = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)
#: The bytes of a word's first 8, by its length.
_KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_CLASSES = [re.compile(f"[{c}]") for c in (LETTERS, NUMBERS, BLANKS)]
#: Class of each Latin-1 character, LETTER and so on, and its lower case.
LETTER, NUMBER, BLANK, OTHER = range(4)
CLASS = np.array([next((k for k, c in enumerate(_CLASSES) if c.match(chr(b))), OTHER) for b in range(256)], np.uint8)
LOWER = np.array([ord(chr(b).lower()) for b in range(256)], np.uint8)


class TokenCodec:
    """Packed ids of whole texts, without special tokens added; special strings inside texts as the library's default has it."""

    def __init__(self, path: str, max_entries: int = MAX_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        self.words = library.normalizer is not None  # the lower-casing tokenizer of words, else the byte-level one
        self.special = [t.content for t in library.get_added_tokens_decoder().values()]
        self.runs = re.compile(f"[{WIDE_BLANKS}]*[^{WIDE_BLANKS}]+|[{WIDE_BLANKS}]+").findall
        self.spell, self.model, self.max_entries = _byte_letters(), library.model, max_entries
        with open(path, encoding="utf-8") as f:
            self.merges = Merges.of(json.load(f))
        self.fine = _Words(max_entries)
        self.long: dict[bytes, np.ndarray] = {}
        self.coarse: dict[str, bytes] = {}

    def _cut(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of each pre-token of texts that lie in data from first on (none is empty).

        Words: letters together, each number alone, other characters together; blanks separate. Byte level: letters, numbers and
        others together, each with a single blank ' ' before it; of a run of blanks inside a text the last stands apart.
        Both: an apostrophe that begins a pre-token takes s, d, m, t, ll, ve or re after it, and these end the pre-token."""
        kind = CLASS[data]
        begins = np.zeros(len(data) + 1, bool)
        begins[first] = True
        before = np.empty_like(kind)
        before[1:], before[0] = kind[:-1], BLANK
        start = kind != before
        blank = kind == BLANK
        if self.words:
            start |= kind == NUMBER
            open_ = before != OTHER
        else:
            ends = begins[1:]  # the last character of each text
            ends[-1] = True
            space = data == 32
            last = blank & ~ends  # the last blank of a run that a text goes on after
            last[:-1] &= ~blank[1:]
            glued = last & space
            start |= last
            start[1:] &= ~glued[:-1]
            open_ = before != OTHER
            open_[1:] &= ~glued[:-1]
        begins = begins[:-1].copy()
        begins[first] = True
        start |= begins
        open_ |= begins
        quote = np.flatnonzero((data == 39) & open_)
        if len(quote):
            room = np.append(first[1:], len(data))[np.searchsorted(first, quote, "right") - 1] - quote
            one, two = data[np.minimum(quote + 1, len(data) - 1)], data[np.minimum(quote + 2, len(data) - 1)]
            short = (room > 1) & np.isin(one, _SHORT)
            twice = (room > 2) & ~short & np.isin(one.astype(np.int32) << 8 | two, _DOUBLE)
            start[quote] = True
            for place, n in ((quote[short], 2), (quote[twice], 3)):
                start[place + 1] = False
                after = place + n
                start[after[after < len(data)]] = True
        at = np.flatnonzero(start)
        size = np.diff(at, append=len(data))
        if self.words:
            keep = ~blank[at]
            at, size = at[keep], size[keep]
        return at, size

    def _merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens given in Latin-1, and how many each has."""
        spelt = [w if w.isascii() else w.decode("latin-1").encode() for w in words]
        if self.merges is not None and len(words) >= _FEW:
            return self.merges.ids(np.frombuffer(b"".join(spelt), np.uint8), np.array([len(w) for w in spelt], np.int64))
        ids = [[t.id for t in self.model.tokenize("".join([self.spell[b] for b in w]))] for w in spelt]
        return np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64)

    def _long(self, word: bytes) -> np.ndarray:
        ids = self.long.get(word)
        if ids is None:
            ids = self._merged([word])[0]
            if len(word) <= LONGEST_KEPT:
                if len(self.long) >= self.max_entries // 4:
                    self.long.clear()
                self.long[word] = ids
        return ids

    def _latin(self, texts: list[bytes]) -> list[bytes]:
        """Packed ids of texts given in Latin-1, none of them empty."""
        raw = b"".join(texts)
        ends = np.cumsum([len(t) for t in texts])
        data = np.frombuffer(raw, np.uint8)
        if self.words:
            data = LOWER[data]
            raw = data.tobytes()
        start, size = self._cut(data, np.append(0, ends[:-1]))
        eights = np.ndarray(len(raw) + 8, "<u8", raw + bytes(KEY_BYTES), strides=(1,))  # 8 bytes from each place on
        out, counts, table = [], np.zeros(len(start), np.int64), self.fine
        for lo in range(0, len(start), SLICE):
            at, n = start[lo : lo + SLICE], size[lo : lo + SLICE]
            short = np.flatnonzero(n <= KEY_BYTES)
            at_, n_ = at[short], n[short]
            place, new, word = table.places(eights[at_] & _KEPT[np.minimum(n_, 8)], eights[at_ + np.minimum(n_, 8)] & _KEPT[np.maximum(n_ - 8, 0)])
            if len(new):
                table.learn(new, *self._merged([raw[s : s + k] for s, k in zip(at_[word].tolist(), n_[word].tolist())]))
            own = counts[lo : lo + SLICE]
            own[short] = table.count[place]
            begin = np.zeros(len(at), np.int64)
            begin[short] = table.start[place]
            pool, rest = table.pool, np.flatnonzero(n > KEY_BYTES)
            if len(rest):
                long = [self._long(raw[s : s + k]) for s, k in zip(at[rest].tolist(), n[rest].tolist())]
                own[rest] = [len(x) for x in long]
                begin[rest] = table.ids + np.cumsum(own[rest]) - own[rest]
                pool = np.concatenate([pool[: table.ids], *long])
            out.append(pool[_spans(begin, own)])
        ids = np.concatenate(out).astype("<u4", copy=False).tobytes() if out else b""
        upto = np.append(0, np.cumsum(counts))[np.searchsorted(start, ends)] * 4
        return [ids[a:b] for a, b in zip([0, *upto[:-1].tolist()], upto.tolist())]

    def _other(self, text: str) -> bytes:
        """A text of wider characters: the library splits its runs."""
        table, out = self.coarse, []
        for run in self.runs(text):
            ids = table.get(run)
            if ids is None:
                found = self.library.encode(run, add_special_tokens=False).ids
                ids = pack(f"<{len(found)}I", *found)
                if len(run) <= LONGEST_KEPT:
                    if len(table) >= self.max_entries // 4:
                        table.clear()
                    table[run] = ids
            out.append(ids)
        return b"".join(out)

    def _group(self, texts: list[str | None]) -> list[bytes]:
        out, plain, where = [], [], []
        for text in texts:
            ids = b""
            if text and ("\0" in text or any(s in text for s in self.special)):
                found = self.library.encode(text, add_special_tokens=False).ids
                ids = pack(f"<{len(found)}I", *found)
            elif text:
                try:
                    plain.append(text.encode("latin-1"))
                    where.append(len(out))
                except UnicodeEncodeError:
                    ids = self._other(text)
            out.append(ids)
        for k, ids in zip(where, self._latin(plain) if plain else ()):
            out[k] = ids
        return out

    def packed_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers, none for a null text; texts are held some GROUP characters at a time."""
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text or "")
            if size >= GROUP:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def packed(self, text: str | None) -> bytes:
        return self._group([text])[0]


#: What an apostrophe takes: one letter, or two.
_SHORT, _DOUBLE = [*b"sdmt"], [a << 8 | b for a, b in (b"ll", b"ve", b"re")]
#: Chunks from which on merging them together is faster.
_FEW = 64


@cache
def codec(path: str, max_entries: int = MAX_ENTRIES) -> TokenCodec:
    """One codec for each tokenizer file and Python worker."""
    return TokenCodec(path, max_entries)


@cache
def version_of(path: str) -> str:
    """Digest of a tokenizer file: names the version whose counts a cache holds."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()
