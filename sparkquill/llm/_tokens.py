"""Splitting of texts into the words that a tokenizer's merges never cross, and a bounded cache of their ids."""

from __future__ import annotations

import functools
import os
import unicodedata

import numpy as np

from sparkquill.llm._arrays import mix, powers

_U = np.uint64
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: At most this many words are remembered at a time.
CACHE_WORDS = 800_000


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def load_tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@functools.cache
def _classes() -> np.ndarray:
    import regex

    chars = "".join(map(chr, [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]))
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    for kind, pattern in ((SPACE, r"\p{White_Space}"), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        found = "".join(regex.findall(pattern, chars))
        out[np.frombuffer(found.encode("utf-32-le"), dtype="<u4")] = kind
    return out


@functools.cache
def _values() -> np.ndarray:
    """A random 64-bit number for each character."""
    return mix(np.arange(1, 0x110001, dtype=np.uint64))


def lowered(text: str) -> str:
    """NFC, then lower case character by character (without the rule for a final sigma)."""
    if text.isascii():
        return text.lower()
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()


#: Longer texts are split into words part by part: the arrays of a part have some 40 bytes for each byte of text.
PART_BYTES = 4 << 20
_ALNUM = np.array([chr(b).isalnum() and b < 0x80 for b in range(256)])
_GAP = np.array([b in (0x0A, 0x20) for b in range(256)])


def parts_of(raw: np.ndarray, limit: int | None = None) -> list[np.ndarray]:
    """A text's bytes in parts of about `limit`, cut before a space or line feed that follows an ASCII letter or digit: no word, run of white space
    or composed character crosses such a place, whichever of the styles splits it. A text without such places stays whole."""
    limit, cuts = limit or PART_BYTES, [0]
    while len(raw) - cuts[-1] > limit:
        at, found = cuts[-1] + limit, None
        while at < len(raw) and found is None:
            near = raw[at - 1 : at + (1 << 16)]
            hits = np.flatnonzero(_GAP[near[1:]] & _ALNUM[near[:-1]])
            at, found = (at, at + int(hits[0])) if len(hits) else (at + (1 << 16), None)
        if found is None:
            break
        cuts.append(found)
    return [raw[a:b] for a, b in zip(cuts, [*cuts[1:], len(raw)])]


class Pieces:
    """The words of some texts: character ranges in `text`, hashes, and the number of words of each text."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, style: str, specials: tuple[str, ...]):
        text = raw.tobytes().decode("utf-8", "replace")
        low = text.lower() if style == "lower" else text
        ends = np.zeros(len(raw) + 1, dtype=np.int64)
        np.cumsum((raw & 0xC0) != 0x80, out=ends[1:])
        bounds = ends[offsets]
        if len(text) != ends[-1] or (style == "lower" and not (text.isascii() or (unicodedata.is_normalized("NFC", text) and "Σ" not in text and len(low) == len(text)))) or any(s in text for s in specials):
            # lengths change or special tokens occur: text by text
            texts = [raw[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace") for i in range(len(offsets) - 1)]
            parts, sizes, cuts, special_at = [], [], [], []
            at = 0
            for t in texts:
                begin = at
                for part, special in _special_parts(t, specials):
                    part = part if special or style != "lower" else lowered(part)
                    if special:
                        special_at.append(at)
                    cuts.append(at)
                    parts.append(part)
                    at += len(part)
                sizes.append(at - begin)
            text = "".join(parts)
            bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            cuts = np.array(cuts, dtype=np.int64)
        else:
            text, cuts, special_at = low, bounds[:-1], []
        self.text = text
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        self.start, self.end = _split(points, np.unique(cuts[cuts < len(points)]), np.array(special_at, dtype=np.int64), style)
        total = np.zeros(len(points) + 1, dtype=np.uint64)
        up, down = powers(len(points))
        np.cumsum(_values()[points] * up[: len(points)], out=total[1:])
        length = (self.end - self.start).astype(np.uint64)
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start] + length * _U(0xD6E8FEB86659FD93)) if len(self.start) else np.zeros(0, np.uint64)
        self.count = np.diff(np.searchsorted(self.start, bounds))

    def word(self, i: int) -> str:
        return self.text[self.start[i] : self.end[i]]


def _special_parts(text: str, specials: tuple[str, ...]) -> list[tuple[str, bool]]:
    out, begin = [], 0
    while True:
        hits = [(p, s) for s in specials if (p := text.find(s, begin)) >= 0]
        if not hits:
            return [*out, (text[begin:], False)]
        p, s = min(hits)
        out += [(text[begin:p], False), (s, True)]
        begin = p + len(s)


def _split(points: np.ndarray, cuts: np.ndarray, specials: np.ndarray, style: str) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of words. Style "lower": letters, single numbers, other runs. Style "bytes": these (numbers in runs) with one space before, and white space."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _classes()[points]
    cut = np.zeros(n + 1, dtype=bool)
    cut[cuts] = cut[n] = True
    edge = cut[:n].copy()
    edge[0] = True
    edge[1:] |= kind[1:] != kind[:-1]
    if style == "lower":
        edge |= kind == NUMBER
    start = np.flatnonzero(edge)
    end = np.append(start[1:], n)
    run = kind[start]
    # contractions: an apostrophe alone, then letters of a fixed list; not where a space before joins the apostrophe
    new_start, new_end = start.copy(), end.copy()
    alone = np.flatnonzero((points[start] == 0x27) & (end - start == 1) & (run == OTHER))
    if len(alone):
        alone = alone[(alone + 1 < len(start))]
        alone = alone[(run[alone + 1] == LETTER) & ~cut[start[alone + 1]]]
        if style == "bytes":
            before = start[alone] - 1
            alone = alone[~((before >= 0) & (points[np.maximum(before, 0)] == 0x20) & ~cut[start[alone]])]
        if len(alone):
            follow = start[alone + 1]
            one = points[follow]
            two = np.where(follow + 1 < end[alone + 1], points[np.minimum(follow + 1, n - 1)], 0)
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = np.zeros(len(alone), dtype=bool)
            for a, b in ("re", "ve", "ll"):
                long |= (one == ord(a)) & (two == ord(b))
            taken = np.where(short, 1, np.where(long, 2, 0))
            new_end[alone] += taken
            new_start[alone + 1] += taken
    if style == "bytes":
        space = run == SPACE
        last_blank = points[end - 1] == 0x20
        follows = ~cut[end] & space  # white space with a word after it in the same text
        joins = np.zeros(len(start), dtype=bool)
        joins[1:] = (follows & last_blank)[:-1]
        new_start[joins] -= 1
        head_end = np.where(follows, end - 1, end)
        tail = follows & ~last_blank
        new_end = np.where(space, head_end, new_end)
        extra = end[tail]
        begin, stop = np.concatenate([new_start, extra - 1]), np.concatenate([new_end, extra])
        keep = stop > begin
        begin, stop = begin[keep], stop[keep]
        order = np.argsort(begin, kind="stable")
        begin, stop = begin[order], stop[order]
    else:
        keep = (run != SPACE) & (new_end > new_start)
        begin, stop = new_start[keep], new_end[keep]
    if len(specials):
        spans = np.append(cuts, n)
        stops = spans[np.searchsorted(spans, specials, side="right")]
        inside = np.searchsorted(specials, begin, side="right") - 1
        drop = (inside >= 0) & (begin < stops[np.maximum(inside, 0)])
        begin, stop = np.concatenate([begin[~drop], specials]), np.concatenate([stop[~drop], stops])
        order = np.argsort(begin, kind="stable")
        begin, stop = begin[order], stop[order]
    return begin, stop


@functools.cache
def _word_tokenizer(path: str):
    """The vocabulary's tokenizer for words (one a line) that are normalised already: its merges over bytes alone; and, where the
    vocabulary marks the ends of words, which ids end a word."""
    from tokenizers import Tokenizer, pre_tokenizers

    load_tokenizer(path)
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    if tokenizer.normalizer is not None:
        tokenizer.normalizer = None
    by_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
    if not suffix:
        tokenizer.pre_tokenizer = by_bytes
        return tokenizer, None
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "removed"), by_bytes])
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
    ends[[k for piece, k in vocabulary.items() if piece.endswith(suffix) or piece in special]] = True
    return tokenizer, ends


class WordIds:
    """Ids of words by hash; each word goes to the tokenizer once as long as at most `limit` are held."""

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        self.tokenizer, self.ends = _word_tokenizer(path)
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.slot: dict = {}
        self.known, self.known_slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # hashes in order, and their slots
        self.held = 0
        self.flat = np.zeros(1 << 16, dtype=np.int32)
        self.offset = np.zeros(1 << 15, dtype=np.int64)

    def slots(self, hashes: np.ndarray, word) -> np.ndarray:
        """Slots of distinct hashes in ascending order; word(i) gives the i-th word's text."""
        if self.held + len(hashes) > self.limit:
            self.clear()
        at = np.searchsorted(self.known, hashes)
        inside = at < len(self.known)
        inside[inside] = self.known[at[inside]] == hashes[inside]
        missing = np.flatnonzero(~inside)
        fresh = self.held + np.arange(len(missing))
        self._learn([word(i) for i in missing.tolist()])
        out = np.empty(len(hashes), dtype=np.int64)
        out[inside], out[missing] = self.known_slot[at[inside]], fresh
        self.known, self.known_slot = np.insert(self.known, at[missing], hashes[missing]), np.insert(self.known_slot, at[missing], fresh)
        return out

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some words, one after the other, and the number of each."""
        if self.ends is not None:  # every word ends in an id of its own kind, so one call takes many words
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(words)], add_special_tokens=False)[0].ids, dtype=np.int64)
            stop = np.flatnonzero(self.ends[ids]) + 1
            if len(stop) == len(words):
                return ids, np.diff(stop, prepend=0)
        each = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([y for x in each for y in x], dtype=np.int64), np.array([len(x) for x in each], dtype=np.int64)

    def _learn(self, words: list[str]) -> None:
        """Takes up new words in the next slots."""
        for lo in range(0, len(words), 4096):
            part = words[lo : lo + 4096]
            ids, lengths = self._encoded(part)
            base = self.held
            while base + len(part) + 1 > len(self.offset):
                self.offset = np.concatenate([self.offset, np.zeros_like(self.offset)])
            self.offset[base + 1 : base + len(part) + 1] = self.offset[base] + np.cumsum(lengths)
            while self.offset[base + len(part)] > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.offset[base] : self.offset[base + len(part)]] = ids
            self.held += len(part)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given as UTF-8, one after the other, and the number of each."""
        if self.held + len(words) > self.limit:
            self.clear()
        get = self.slot.get
        missing = [w for w in words if get(w) is None]
        self.slot.update(zip(missing, range(self.held, self.held + len(missing))))
        self._learn([w.decode("utf-8", "surrogatepass") for w in missing])
        return self.expand(np.fromiter(map(self.slot.__getitem__, words), dtype=np.int64, count=len(words)))

    def expand(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words in `slots`, one after the other, and the number of each."""
        return expand(self.flat, self.offset, slots)


@functools.cache
def shared_word_ids(path: str) -> WordIds:
    """One cache for all tasks that a Python worker runs."""
    return WordIds(path)


def expand(flat: np.ndarray, offset: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[offset[s]:offset[s + 1]] for every slot s, one after the other, and the lengths."""
    length = offset[slots + 1] - offset[slots]
    stop = np.cumsum(length)
    at = np.repeat(offset[slots] - (stop - length), length) + np.arange(stop[-1] if len(stop) else 0)
    return flat[at], length


def sums_by(counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of runs of `lengths` values."""
    total = np.concatenate([[0], np.cumsum(lengths)])
    at = np.concatenate([[0], np.cumsum(counts)])
    return total[at[1:]] - total[at[:-1]]
