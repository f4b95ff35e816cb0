"""Pre-tokens of a byte-level BPE and their encodings, kept per worker process.

A batch of texts is cut into pre-tokens by the classes of its bytes, its distinct
pre-tokens are numbered by Arrow, and each distinct one is looked up once.  Those that
miss are merged side by side (``Merges``): every step merges the leftmost pair of least
rank of each.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters on which Python's and the tokenizer's character classes were compared one
#: by one; a text with any other character goes through the library whole.
_PLAIN = r"[\x00-\x1b\x20-\x84\x86-ɏ‐-‧‰-⁞€]*"
_ODD = b"\x1c\x1d\x1e\x1f"

_SPACE, _LETTER, _DIGIT, _OTHER, _END = range(5)


def _class(char: str) -> int:
    kind = unicodedata.category(char)
    return _SPACE if char.isspace() else _LETTER if kind[0] == "L" else _DIGIT if kind[0] == "N" else _OTHER


#: Class of each character below U+0250, by which plain texts are cut.
_CLASSES = np.array([_class(chr(c)) for c in range(0x250)], np.uint8)


def cut_text(buf: np.ndarray, clip: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pre-tokens of plain UTF-8 texts, each followed by a byte 0xFF.

    Returns (bytes, starts, ends of texts): starts of the pre-tokens in the bytes, which they
    cover, and for each text the number of pre-tokens up to its end.  With ``clip`` white
    space is dropped and digits stand alone; else a pre-token takes one space before it.
    """
    cls = np.full(256, _OTHER, np.uint8)
    cls[:128], cls[0xFF] = _CLASSES[:128], _END
    cls = cls[buf]
    lead = np.flatnonzero((buf >= 0xC0) & (buf < 0xFF))
    if len(lead):
        two = lead[buf[lead] < 0xE0]
        code = (buf[two].astype(np.int64) & 0x1F) << 6 | buf[two + 1] & 0x3F
        cls[two] = cls[two + 1] = _CLASSES[code]
    start = np.empty(len(buf), bool)
    start[0] = True
    np.not_equal(cls[1:], cls[:-1], out=start[1:])
    ends = np.flatnonzero(cls == _END)
    start[ends] = True
    if clip:
        start |= (cls == _DIGIT) & ((buf & 0xC0) != 0x80)
    # contractions: an apostrophe alone before certain letters
    tick = np.flatnonzero((buf == 0x27) & start)
    tick = tick[cls[tick + 1] == _LETTER]
    if not clip:
        tick = tick[(tick == 0) | (buf[tick - 1] != 0x20)]
    a, b = buf[tick + 1], buf[np.minimum(tick + 2, len(buf) - 1)]
    short = np.isin(a, np.frombuffer(b"stmd", np.uint8))
    long = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
    for some, n in ((short, 2), (long, 3)):
        at = tick[some]
        start[at + 1] = False
        start[at + n] = True
    if clip:
        keep = cls != _SPACE
        keep[ends] = False
        total = np.cumsum(start & keep)
        return buf[keep], np.flatnonzero(start[keep]), total[ends]
    # the last character of white space before a pre-token stands alone, or joins it if a space
    follow = np.flatnonzero(start[1:] & (cls[:-1] == _SPACE) & (cls[1:] != _SPACE) & (cls[1:] != _END)) + 1
    last = follow - 1 - ((buf[follow - 1] & 0xC0) == 0x80)
    start[last] = True
    start[follow] = buf[follow - 1] != 0x20
    total = np.cumsum(start)
    keep = np.ones(len(buf), bool)
    keep[ends] = False
    return buf[keep], np.flatnonzero(start[keep]), total[ends] - np.arange(1, len(ends) + 1)


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    own = [chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255 else None for b in range(256)]
    spare = iter(range(256, 512))
    return [c or chr(next(spare)) for c in own]


class Merges:
    """The ids of many pre-tokens at once."""

    #: bytes of the longest pre-token taken here; longer ones go to the library's model
    LONGEST = 48
    _NONE = np.int32(1 << 30)

    def __init__(self, model: dict):
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        chars = byte_characters()
        self.first = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + suffix] for c in chars], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.bits = max(8, (len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, self._NONE, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):  # linear probing, all keys at once
            free = self.keys[slot[left]] < 0
            try_now = left[free]
            self.keys[slot[try_now]] = keys[try_now]
            placed = self.keys[slot[try_now]] == keys[try_now]
            self.ranks[slot[try_now[placed]]] = try_now[placed]
            left = np.concatenate((left[~free], try_now[~placed]))
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a << 32 | b).ravel()
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.ranks[slot], self._NONE)
        left = np.flatnonzero((found != keys) & (found >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[left]]
            out[left] = np.where(found == keys[left], self.ranks[slot[left]], self._NONE)
            left = left[(found != keys[left]) & (found >= 0)]
        return out.reshape(a.shape)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces end to end, number of ids of each); none empty or over LONGEST."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        begin = np.cumsum(size) - size
        text = np.frombuffer(b"".join(pieces), np.uint8)
        count = np.zeros(len(pieces), np.int64)
        parts = []
        for n in np.unique(size).tolist():
            of = np.flatnonzero(size == n)
            for lo in range(0, len(of), 1 << 16):
                rows = of[lo : lo + (1 << 16)]
                sym = self._merged(self.first[text[begin[rows][:, None] + np.arange(n)]], self.last[text[begin[rows] + n - 1]])
                count[rows] = (sym >= 0).sum(axis=1)
                parts.append((rows, sym))
        at = np.cumsum(count) - count
        ids = np.empty(int(count.sum()), np.int64)
        for rows, sym in parts:
            k = np.arange(sym.shape[1])
            real = k < count[rows][:, None]
            ids[(at[rows][:, None] + k)[real]] = sym[real]
        return ids, count

    def _merged(self, sym: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The symbols of equally long pieces after all merges; -1 behind the last of each."""
        sym[:, -1] = last
        n = sym.shape[1]
        if n == 1:
            return sym
        out = np.full_like(sym, -1)
        rows, rank = np.arange(len(sym)), self.rank(sym[:, :-1], sym[:, 1:])
        cols = np.arange(n)
        while True:
            m = rank.argmin(axis=1)
            at = np.arange(len(rows))
            best = rank[at, m]
            live = best < self._NONE
            if not live.all():
                out[rows[~live], : sym.shape[1]] = sym[~live]
                rows, sym, rank, m, best = rows[live], sym[live], rank[live], m[live], best[live]
                at = np.arange(len(rows))
            if not len(rows):
                return out
            sym[at, m] = self.made[best]
            # what stands behind the merged pair moves up by one
            shift = cols[1 : sym.shape[1] - 1] > m[:, None]
            new = sym[:, :-1].copy()
            np.copyto(new[:, 1:], sym[:, 2:], where=shift)
            moved = rank[:, :-1].copy()
            if moved.shape[1]:
                np.copyto(moved, rank[:, 1:], where=cols[: moved.shape[1]] > m[:, None])
            sym, rank = new, moved
            if not rank.shape[1]:
                out[rows, :1] = sym
                return out
            for k in (m - 1, m):  # the two pairs that hold the new symbol
                some = np.flatnonzero((k >= 0) & (k < rank.shape[1]))
                a, b = sym[some, k[some]], sym[some, k[some] + 1]
                rank[some, k[some]] = self.rank(a, b)


class Pieces:
    """Splits texts as one tokenizer file does; ``encode`` gives the ids of one text."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.merges = Merges(spec["model"])
        added = spec.get("added_tokens") or []
        self._added = [t["content"].encode() for t in added]
        odd_added = any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or "<" not in t["content"] for t in added)
        pre, rule = spec["pre_tokenizer"], r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        self.clip = pre["type"] == "Sequence"
        if self.clip:
            known = [n["type"] for n in spec["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"] and pre["pretokenizers"][0]["pattern"] == {"Regex": rule}
        else:
            known = pre == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and spec["normalizer"] is None
        self._model = self.tokenizer.model
        self._coded = str.maketrans(dict(enumerate(byte_characters())))
        self._known = known and not odd_added
        self._full = regex.compile(_PLAIN).fullmatch

    def plain(self, raw: bytes) -> bytes | None:
        """The normalised text, or None if only the library can tell (odd characters, added tokens)."""
        if not self._known or (b"<" in raw and any(t in raw for t in self._added)):
            return None
        if raw.isascii():
            return (raw.lower() if self.clip else raw) if len(raw.translate(None, _ODD)) == len(raw) else None
        text = raw.decode("utf-8", "replace")
        if not self._full(text):
            return None
        return unicodedata.normalize("NFC", text).lower().encode() if self.clip else text.encode()

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encoded(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of ids of each) of pre-tokens."""
        long = {i: self._word(b) for i, b in enumerate(found) if len(b) > Merges.LONGEST}
        if not long:
            return self.merges.encode(found)
        ids, count = self.merges.encode([b for b in found if len(b) <= Merges.LONGEST])
        short = iter(np.split(ids, np.cumsum(count)[:-1]))
        parts = [np.array(long[i], np.int64) if i in long else next(short) for i in range(len(found))]
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))

    def _word(self, piece: bytes) -> list[int]:
        """Ids of one pre-token by the library's model."""
        return [t.id for t in self._model.tokenize(piece.decode("latin-1").translate(self._coded))]

    def normal(self, text: str) -> str:
        if not self.clip:
            return text
        return (text if text.isascii() else unicodedata.normalize("NFC", text)).lower()


@functools.lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    return Pieces(path)


class Table:
    """Encodings of the pre-tokens a worker has met, emptied to its base when it grows
    beyond ``LIMIT`` of them.  base: pre-tokens with known lengths, where lengths are all
    that is asked for."""

    LIMIT = 300_000

    def __init__(self, path: str, keep_ids: bool = False, base: dict[bytes, int] | None = None):
        self.p, self.keep_ids, self.base = pieces(path), keep_ids, {} if keep_ids else dict(base or {})
        self._reset()

    def _reset(self) -> None:
        self.number: dict[bytes, int] = dict(zip(self.base, range(len(self.base)), strict=True))
        self.length = np.zeros(max(1 << 14, 2 * len(self.base)), np.int64)
        self.length[: len(self.base)] = list(self.base.values())
        self.start = np.zeros(len(self.length), np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0

    def _numbers(self, found: list[bytes]) -> np.ndarray:
        """Table rows of distinct pre-tokens."""
        if len(self.number) > self.LIMIT:
            self._reset()
        get = self.number.get
        at = np.fromiter((get(x, -1) for x in found), np.int64, len(found))
        miss = np.flatnonzero(at < 0)
        for lo in range(0, len(miss), 1 << 16):
            part = miss[lo : lo + (1 << 16)]
            at[part] = np.arange(len(self.number), len(self.number) + len(part))
            self._add([found[i] for i in part.tolist()])
        return at

    def _add(self, found: list[bytes]) -> None:
        ids, count = self.p.encoded(found)
        n = len(self.number)
        while n + len(found) > len(self.length):
            self.length, self.start = (np.concatenate((x, np.zeros_like(x))) for x in (self.length, self.start))
        self.length[n : n + len(found)] = count
        if self.keep_ids:
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
            self.flat[self.used : self.used + len(ids)] = ids
            self.start[n : n + len(found)] = self.used + np.cumsum(count) - count
            self.used += len(ids)
        self.number.update(zip(found, range(n, n + len(found)), strict=True))

    def _looked_up(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(table rows of all pre-tokens end to end, number of pre-tokens of each text)."""
        found, ends = distinct_pieces(texts, self.p.clip)
        n = np.diff(np.concatenate(([0], ends)))
        return self._numbers(found[0])[found[1]] if len(found[1]) else np.empty(0, np.int64), n

    def _sorted_out(self, raws: list[bytes]) -> tuple[list[bytes], list[int], list[int]]:
        """(normalised texts to look up, their places, places of the others)."""
        texts, fast, slow = [], [], []
        for i, raw in enumerate(raws):
            if (text := self.p.plain(raw)) is None:
                slow.append(i)
            else:
                texts.append(text)
                fast.append(i)
        return texts, fast, slow

    def counts(self, raws: list[bytes]) -> np.ndarray:
        """Number of tokens of each text."""
        texts, fast, slow = self._sorted_out(raws)
        out = np.zeros(len(raws), np.int64)
        if fast:
            rows, n = self._looked_up(texts)
            total = np.concatenate(([0], np.cumsum(self.length[rows])))
            ends = np.cumsum(n)
            out[fast] = total[ends] - total[ends - n]
        for i in slow:
            out[i] = len(self.p.encode(raws[i].decode("utf-8", "replace")))
        return out

    def ids(self, raws: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, number of ids of each), each closed by ``end``."""
        texts, fast, slow = self._sorted_out(raws)
        count = np.zeros(len(raws), np.int64)
        flat = np.empty(0, np.int32)
        if fast:
            rows, n = self._looked_up(texts)
            length = self.length[rows]
            total = np.concatenate(([0], np.cumsum(length)))
            stop = np.cumsum(n)
            own = total[stop] - total[stop - n]
            source = np.repeat(self.start[rows] - total[:-1], length) + np.arange(total[-1])
            flat = np.empty(int(total[-1]) + len(fast), np.int32)
            closes = np.cumsum(own + 1) - 1
            inner = np.ones(len(flat), bool)
            inner[closes] = False
            flat[inner] = self.flat[source]
            flat[closes] = end
            count[fast] = own + 1
        if not slow:
            return flat, count
        parts = dict(zip(fast, np.split(flat, np.cumsum(count[fast])[:-1]), strict=True)) if fast else {}
        for i in slow:
            parts[i] = np.array([*self.p.encode(raws[i].decode("utf-8", "replace")), end], np.int32)
            count[i] = len(parts[i])
        return np.concatenate([parts[i] for i in range(len(raws))]), count


def distinct_pieces(texts: list[bytes], clip: bool) -> tuple[tuple[list[bytes], np.ndarray], np.ndarray]:
    """((distinct pre-tokens, index of each pre-token among them), ends of texts)."""
    buf, starts, ends = cut_text(np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8), clip)
    if not len(starts):
        return ([], np.empty(0, np.int64)), ends
    offsets = np.append(starts, len(buf)).astype(np.int64)
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(buf)]).dictionary_encode()
    own = coded.dictionary
    at = np.frombuffer(own.buffers()[1], np.int64)[own.offset : own.offset + len(own) + 1].tolist()
    data = own.buffers()[2].to_pybytes()
    return ([data[a:b] for a, b in zip(at, at[1:], strict=False)], coded.indices.to_numpy()), ends
