"""Operator 5: toxicity of texts after noisy-channel deobfuscation.

A character language model is counted over all documents: all runs of up to ORDER characters of their words (letters of any
script, lower case) with the words' edges. Its table grows with the corpus and stays in Spark. Words that
look written around a filter (digits or signs between letters, a letter three times or more, letters spaced one by one) become
lattices: each sign stands for itself or for the letters it can replace, a repeated letter may be dropped, spaces
between single letters vanish. Lattices are made for distinct words only; the runs that a part of about PART_TOKENS of them can
spell are joined with the model's table, and a Viterbi search over states of the last ORDER - 1 letters finds the letters that
the language model and the channel costs together find likeliest. The restored words join back to the documents that hold them.

The score is a logistic model over word evidence: each word takes the largest log-odds of its 5-byte windows (word edges
included), which are learned from at most SAMPLE labelled documents (those with the smallest hash of their doc_id),
none of them held out. A document's features are the sum, the largest, the number and the share of such evidence; a restored word
counts in place of the written one. Evidence is in whole numbers, so a score depends on the text and the model alone. Windows count as
evidence from a z-value on that cross-validation picks from LEAST_Z: the fitted rows are dealt to FOLDS parts, each part's
features come from the windows of the other parts, and the value with the least log loss of logistic models fitted on the other parts is taken.
The logistic model is fitted on these features, too, as they are like those of unseen texts. Held-out rows play no part in any of this.

Words and runs of single letters may have any length: a search takes time in proportion to it, and what all its paths have in common is put aside on
the way (a character counts three times in a row at most). Runs of single letters end at the edges of texts. Characters are told apart by the low 15 bits
of their number. Null texts count as empty; these and texts without words get the score of no evidence. Several labels of a doc_id count by
their mean, rounded; of its rows the one with the smallest text is fitted. Without labels of both kinds all scores are near the
share of label 1, or 0.5. An empty table gives no rows. A null doc_id is scored and never fitted.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquill.llm._arrays import SPACE_SPLIT, Words, chunks, mix
from sparkquill.llm._stage import drop_staged, salted_lookup, staged
from sparkquill.llm._tokens import LETTER, _classes
from sparkquill.llm.quality_trees import held_out
from sparkquill.llm.setsketch import groups

SAMPLE = 30_000
BINS_LOG = 20
LEAST_DOCS = 4
LEAST_Z, FOLDS = (2.5, 3.0, 3.5, 4.0, 4.5, 5.0, 6.0), 5
#: Evidence is counted in steps of 1 / SCALE.
SCALE = 1 << 12
ORDER, SMOOTH, UNIFORM = 4, 4.0, 1 / 64
PART_TOKENS = 2000
#: Letters after which the search puts aside what its paths have in common.
COMMON = 64
_U = np.uint64

#: Letters that a digit or sign may stand for (fixed values).
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "h",
}
#: Costs (natural logarithms) of the channel.
REPLACED, DROPPED, KEPT_SIGN = 1.0, 0.4, 9.0
BEGIN, END = 1, 2

_EDGE = ".,;:?\"'()[]{}<>%&~`_/\\-"
_SIGNS = re.escape("".join(LEET))
_MIXED = re.compile(rf"[^\W\d_][{_SIGNS}]+[^\W\d_]|^[{_SIGNS}]{{1,3}}[^\W\d_]|[^\W\d_][013457@$]$")
_REPEATED = re.compile(r"([^\W\d_])\1\1")
_LONG_RUN = re.compile(r"(.)\1{3,}")
_SIGN = np.zeros(256, dtype=bool)
_SIGN[[ord(c) for c in LEET if ord(c) < 128]] = True
_LETTER = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])
_DIGIT = np.array([chr(b).isdigit() and b < 128 for b in range(256)])
_LAST = np.zeros(256, dtype=bool)
_LAST[[ord(c) for c in "013457@$"]] = True


# ---- what is suspicious, and what is a word of the language ----


def suspects(words: Words, raw: np.ndarray) -> list[tuple[int, int, str]]:
    """First word, word after the last, and token (lower case) of everything that looks written around a filter, in order. A text's
    suspects depend on that text alone."""
    found: list[tuple[int, int, str]] = []
    if not len(words.start):
        return found
    letter, sign = _LETTER[raw], _SIGN[raw]
    low = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)
    after = np.append(raw[1:], np.uint8(32))
    after[words.end - 1] = 32  # what follows a text's last word belongs to another text
    flag = np.zeros(len(raw), dtype=bool)
    flag[1:] = sign[:-1] & letter[1:]  # a sign before a letter, or one of the last pattern's signs after a letter, at the end but for punctuation
    flag[1:] |= letter[:-1] & _LAST[raw[1:]] & ~letter[1:] & ~_DIGIT[after[1:]] & ~_LETTER[after[1:]]
    if len(raw) > 2:
        flag[2:] |= (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]) & letter[2:]
        # signs past ASCII: the last byte of a pound sign or inverted mark, and of a euro sign
        flag[1:] |= (raw[:-1] == 0xC2) & ((raw[1:] == 0xA3) | (raw[1:] == 0xA1))
        flag[2:] |= (raw[:-2] == 0xE2) & (raw[1:-1] == 0x82) & (raw[2:] == 0xAC)
    n_flags = np.zeros(len(raw) + 1, dtype=np.int32)
    np.cumsum(flag, out=n_flags[1:])
    odd = n_flags[words.end] > n_flags[words.start]
    for i in np.flatnonzero(odd).tolist():
        written = raw[words.start[i] : words.end[i]].tobytes().decode("utf-8", "replace")
        core = re.sub(r"([#$%&*!+|])\1\1+$", "", written).strip(_EDGE).rstrip("!|*#+").lower()
        core = _LONG_RUN.sub(r"\1\1\1", core)
        if core and (_MIXED.search(core) or _REPEATED.search(core)):
            found.append((i, i + 1, core))
    # runs of three single letters or more within one text
    run = (words.end - words.start) == 1
    run &= _LETTER[raw[words.start]] | _SIGN[raw[words.start]]
    first_of_text = np.zeros(len(run) + 1, dtype=bool)
    first_of_text[words.bounds[words.bounds < len(run)]] = True
    begins = np.flatnonzero(run & (first_of_text[:-1] | ~np.concatenate([[False], run[:-1]])))
    ends = np.flatnonzero(run & (first_of_text[1:] | ~np.concatenate([run[1:], [False]]))) + 1
    for first, stop in zip(begins.tolist(), ends.tolist()):
        if stop - first >= 3:
            found.append((first, stop, " ".join(raw[words.start[k] : words.end[k]].tobytes().decode("utf-8", "replace") for k in range(first, stop)).lower()))
    found.sort()
    return found


# ---- the language model ----


def _symbol(c: str) -> int:
    return ord(c) & 0x7FFF


@functools.cache
def _lower() -> np.ndarray:
    """The lower-case character of each character, itself where that takes more than one; 0 where it isn't a letter."""
    kinds = _classes()
    out = np.arange(0x110000, dtype=np.int64)
    letters = np.flatnonzero(kinds == LETTER)
    low = [chr(c).lower() for c in letters.tolist()]
    out[letters] = [ord(x) if len(x) == 1 else c for c, x in zip(letters.tolist(), low)]
    out[kinds != LETTER] = 0
    return out


def _distinct_words(words: Words, raw: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Distinct words that are letters but for punctuation around them, each after a byte BEGIN, and how often they occur."""
    start, end = words.start.copy(), words.end.copy()
    if not len(start):
        return b"", np.zeros(0, np.int64)
    for _ in range(4):  # punctuation around words
        start += (start < end) & ~_LETTER[raw[np.minimum(start, len(raw) - 1)]]
        end -= (start < end) & ~_LETTER[raw[end - 1]]
    letters = np.zeros(len(raw) + 1, dtype=np.int32)
    np.cumsum(_LETTER[raw], out=letters[1:])
    clean = np.flatnonzero((end > start) & (letters[end] - letters[start] == end - start))
    _, index, count = np.unique(words.hash[clean], return_index=True, return_counts=True)
    start, size = start[clean[index]], end[clean[index]] - start[clean[index]]
    place = np.cumsum(size + 1) - size
    out = np.full(int(size.sum()) + len(size), BEGIN, dtype=np.uint8)
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(place, size) + step] = raw[np.repeat(start, size) + step]
    return out.tobytes(), count


def grams_of(text: bytes, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All runs of up to ORDER symbols (15 bits each) of words (each after a byte BEGIN) with their edges, and how often they occur.
    The longest runs are sorted; the shorter ones are their beginnings, as words end in ORDER - 1 empty symbols. Words with anything but letters don't count."""
    point = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), "<u4").astype(np.int64)
    begin = np.flatnonzero(point == BEGIN)
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.cumsum(point == BEGIN) - 1
    low = _lower()[point]
    odd = np.bincount(owner, weights=(low == 0) & (point != BEGIN)) > 0
    symbol = np.zeros(len(point) + (ORDER + 1) * len(begin), dtype=np.int64)
    symbol[np.arange(len(point)) + ORDER * owner] = np.where(point == BEGIN, BEGIN, low & 0x7FFF)
    symbol[np.append(begin[1:], len(point)) + ORDER * np.arange(len(begin))] = END
    weight = np.repeat(np.where(odd, 0, n), np.diff(np.append(begin, len(point))) + ORDER)
    at = np.flatnonzero(symbol[: len(weight)])
    code = np.zeros(len(at), dtype=np.int64)
    for j in range(ORDER):
        code = code << 15 | symbol[at + j]
    grams, inverse = np.unique(code, return_inverse=True)
    total = np.bincount(inverse, weights=weight[at]).astype(np.int64)
    codes, counts = [], []
    for _ in range(ORDER):
        some = (grams & 0x7FFF != 0) & (total > 0)
        codes.append(grams[some])
        counts.append(total[some])
        grams = grams >> 15
        first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        grams, total = grams[first], np.add.reduceat(total, first)
    return np.concatenate(codes), np.concatenate(counts)


def _scan_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text -> gram, n and token, n: the runs of the language model, and the suspicious tokens."""
    for _, raw, offsets in chunks(batches):
        words = Words(raw, offsets, SPACE_SPLIT)
        gram, n = grams_of(*_distinct_words(words, raw))
        odd: dict[str, int] = {}
        for _, _, token in suspects(words, raw):
            odd[token] = odd.get(token, 0) + 1
        grams = pa.concat_arrays([pa.array(gram, pa.int64()), pa.nulls(len(odd), pa.int64())])
        tokens = pa.concat_arrays([pa.nulls(len(gram), pa.string()), pa.array(list(odd), pa.string())])
        yield pa.RecordBatch.from_arrays([grams, tokens, pa.array(np.concatenate([n, np.array(list(odd.values()), np.int64)]), pa.int64())], ["gram", "token", "n"])


def _alternatives(c: str) -> list[tuple[str, float]]:
    """The letters behind a written character, and what the channel asks for each."""
    return [*((x, REPLACED) for x in LEET.get(c, "")), (c, KEPT_SIGN if c in LEET or not c.isalpha() else 0.0)]


def _letters(token: str) -> str:
    return token[::2] if len(token) > 2 and all(c == " " for c in token[1::2]) else token


def _extended(state: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    return (*state, symbol)[-(ORDER - 1) :]


def _code(symbols: tuple[int, ...]) -> int:
    out = 0
    for x in symbols:
        out = out << 15 | x
    return out


def spelled_grams(token: str) -> set[int]:
    """All runs whose counts a search of the token's lattice can ask for."""
    states, found, before = {(BEGIN,)}, set(), ""
    for c in _letters(token):
        new = set(states) if c == before else set()
        for state in states:
            for x, _ in _alternatives(c):
                found.add((state, _symbol(x)))
                new.add(_extended(state, _symbol(x)))
        states, before = new, c
    found |= {(state, END) for state in states}
    out = set()
    for state, symbol in found:
        for k in range(1, len(state) + 1):
            out |= {_code(state[-k:]), _code((*state[-k:], symbol))}
    return out


def surprise(counts: dict[int, int], state: tuple[int, ...], symbol: int) -> float:
    """Cost of a symbol after a state: counts of ever longer runs, each smoothed with the one before."""
    p = UNIFORM
    for k in range(1, len(state) + 1):
        p = (counts.get(_code((*state[-k:], symbol)), 0) + SMOOTH * p) / (counts.get(_code(state[-k:]), 0) + SMOOTH)
    return -float(np.log(p))


def restore(token: str, counts: dict[int, int]) -> str:
    """The likeliest letters behind a token: Viterbi over states of the last letters; of equal costs the first spelling in order of letters."""
    states: dict[tuple[int, ...], tuple[float, str]] = {(BEGIN,): (0.0, "")}
    before, done = "", []
    for i, c in enumerate(_letters(token), 1):
        new: dict[tuple[int, ...], tuple[float, str]] = {}
        for state, (cost, path) in states.items():
            if c == before and (c.isalpha() or c in LEET):
                best = (cost + DROPPED, path)
                if state not in new or best < new[state]:
                    new[state] = best
            for x, channel in _alternatives(c):
                to, best = _extended(state, _symbol(x)), (cost + channel + surprise(counts, state, _symbol(x)), path + x)
                if to not in new or best < new[to]:
                    new[to] = best
        states, before = new, c
        if i % COMMON == 0:  # comparisons of paths don't depend on what all begin with
            common = os.path.commonprefix([path for _, path in states.values()])
            done.append(common)
            states = {state: (cost, path[len(common) :]) for state, (cost, path) in states.items()}
    return "".join(done) + min((cost + surprise(counts, state, END), path) for state, (cost, path) in states.items())[1]


def _needed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, token (sorted by part) -> part, gram."""
    for table in groups(batches, 1):
        grams = set().union(*(spelled_grams(t) for t in table.column("token").to_pylist()))
        part = table.column("part")[0].as_py()
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), part)), pa.array(sorted(grams), pa.int64())], ["part", "gram"])


def _restored_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, gram, n, token (a part's counts, and its tokens) -> token, restored."""
    for table in groups(batches, 1):
        token, gram, n = (table.column(c).to_pylist() for c in ("token", "gram", "n"))
        counts = {g: k for g, k in zip(gram, n) if g is not None}
        tokens = [t for t in token if t is not None]
        yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.array([restore(t, counts) for t in tokens], pa.string())], ["token", "restored"])


def restored_tokens(counted: DataFrame) -> DataFrame:
    """token, n (its occurrences), restored for the suspicious tokens of `counted` (gram or token, n)."""
    grams = counted.filter("gram IS NOT NULL").select("gram", "n")
    tokens = counted.filter("token IS NOT NULL").select("token", "n")
    parts = max(1, -(-tokens.count() // PART_TOKENS))
    placed = staged(tokens.withColumn("part", F.pmod(F.xxhash64("token"), F.lit(parts))), "tokens")
    dealt = placed.select("part", "token").repartition("part").sortWithinPartitions("part", "token")
    known = dealt.mapInArrow(_needed_rows, "part long, gram long").join(grams, "gram").select("part", "gram", "n", F.lit(None).cast("string").alias("token"))
    both = known.unionByName(placed.select("part", "token"), allowMissingColumns=True)
    found = both.repartition("part").sortWithinPartitions("part").mapInArrow(_restored_rows, "token string, restored string")
    out = staged(found.join(placed.select("token", "n"), "token").select("token", "n", "restored"), "restored")
    drop_staged(placed)
    return out


# ---- evidence ----


def _windows(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, Words]:
    """Bins of all 5-byte windows of words with their edges, and the word of each."""
    words = Words(raw, offsets, SPACE_SPLIT)
    table = SPACE_SPLIT
    length = words.end - words.start
    n = np.maximum(length - 2, 0)  # with an edge on both sides a word of k bytes has k + 2 - 4 windows
    word = np.repeat(np.arange(len(n)), n)
    first = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n) + words.start[word] - 1 if len(word) else np.zeros(0, np.int64)
    padded = np.concatenate([[0], table[raw], [0, 0, 0, 0, 0]]).astype(np.uint64)
    lo, hi = words.start[word], words.end[word]
    key = np.zeros(len(word), np.uint64)
    for k in range(5):
        at = first + k
        byte = padded[at + 1]
        if k == 0:
            byte = np.where(at < lo, _U(0), byte)
        if k == 4:
            byte = np.where(at >= hi, _U(0), byte)
        key = key << _U(8) | byte
    return (mix(key) >> _U(64 - BINS_LOG)).astype(np.int64), word, words


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cell, text -> bin, cell, n: documents of each cell (label and fold, from 0 to 2 * FOLDS - 1) with a window of the bin."""
    total = np.zeros((2 * FOLDS, 1 << BINS_LOG), dtype=np.int32)
    for batch, raw, offsets in chunks(batches, limit=1 << 20):
        cells = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        bins, word, words = _windows(raw, offsets)
        seen = np.unique((words.doc[word] << BINS_LOG) | bins) if len(bins) else np.zeros(0, np.int64)
        cell = cells[seen >> BINS_LOG]
        for k in np.unique(cell).tolist():
            total[k] += np.bincount(seen[cell == k] & ((1 << BINS_LOG) - 1), minlength=1 << BINS_LOG).astype(np.int32)
    for k in range(2 * FOLDS):
        seen = np.flatnonzero(total[k])
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(np.full(len(seen), k), pa.int32()), pa.array(total[k][seen], pa.int64())], ["bin", "cell", "n"])


def _word_evidence(raw: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, Words]:
    """The largest weight of each word's windows, 0 at least."""
    bins, word, words = _windows(raw, offsets)
    value = np.zeros(len(words.start), dtype=np.int64)
    if len(bins):
        w = weights[bins]
        np.maximum.at(value, word[w > 0], w[w > 0])
    return value, words


def _part_rows(weights):
    """row columns..., text -> the same columns, the evidence of the unsuspicious words (total, most, number, words), and the suspects (starts, ends in bytes, tokens)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offsets in chunks(batches, limit=1 << 20):
            n = batch.num_rows
            value, words = _word_evidence(raw, offsets, weights.value) if weights is not None else (None, Words(raw, offsets, SPACE_SPLIT))
            value = np.zeros(len(words.start), np.int64) if value is None else value
            starts, ends, tokens = ([[] for _ in range(n)] for _ in range(3))
            gone, merged = np.zeros(len(words.start), dtype=bool), np.zeros(n, dtype=np.int64)
            for a, b, token in suspects(words, raw):
                d = int(words.doc[a])
                gone[a:b] = True
                merged[d] += b - a - 1
                starts[d].append(int(words.start[a] - offsets[d]))
                ends[d].append(int(words.end[b - 1] - offsets[d]))
                tokens[d].append(token)
            value[gone] = 0
            most = np.zeros(n, dtype=np.int64)
            np.maximum.at(most, words.doc, value)
            total = np.zeros(n, dtype=np.int64)
            np.add.at(total, words.doc, value)
            number = np.bincount(words.doc[value > 0], minlength=n).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns, *(pa.array(x, pa.int64()) for x in (total, most, number, words.count - merged)),
                    pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(tokens, pa.list_(pa.string())),
                ],
                [*batch.schema.names, "total", "most", "number", "words", "starts", "ends", "tokens"],
            )

    return rows


_PARTS = "total long, most long, number long, words long, starts array<long>, ends array<long>, tokens array<string>"


def _value_rows(weights):
    """token, n, restored -> token, n, restored, changed, value."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offsets in chunks(batches, text="restored"):
            value, words = _word_evidence(raw, offsets, weights.value)
            most = np.zeros(batch.num_rows, dtype=np.int64)
            np.maximum.at(most, words.doc, value)
            changed = [int(a != b) for a, b in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(changed, pa.int32()), pa.array(most, pa.int64())], ["token", "n", "restored", "changed", "value"])

    return rows


def _rewritten_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """..., text, starts, ends, news (null: leave as written) -> the text with the news in place."""
    for batch in batches:
        out = []
        for text, starts, ends, news in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("text", "starts", "ends", "news"))):
            raw, parts, at = (text or "").encode("utf-8", "surrogatepass"), [], 0
            for a, b, new in zip(starts, ends, news):
                if new is not None:
                    parts += [raw[at:a], new.encode("utf-8", "surrogatepass")]
                    at = b
            out.append(b"".join([*parts, raw[at:]]).decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], [*batch.schema.names[:2], "rewritten"])


def _rewritten(parts: DataFrame, key: str, other: str, values: DataFrame, everything: bool) -> DataFrame:
    """key, other, rewritten: whole texts with their suspects replaced by the restored tokens (with `everything`, by unchanged ones too)."""
    each = parts.select(key, F.posexplode("tokens").alias("at", "token"))
    met = salted_lookup(each, values.select("token", "n", "restored"), "token", key, "n")
    new = F.col("restored") if everything else F.when(F.col("restored") != F.col("token"), F.col("restored"))
    news = met.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", new.alias("new")))).alias("n")).select(key, F.transform("n", lambda x: x["new"]).alias("news"))  # one document's suspects
    rows = parts.join(news, key, "left").select(key, other, "text", "starts", "ends", F.coalesce("news", F.array().cast("array<string>")).alias("news"))
    kinds = {f.name: f.dataType.simpleString() for f in parts.schema.fields}
    return rows.mapInArrow(_rewritten_rows, f"{key} {kinds[key]}, {other} {kinds[other]}, rewritten string")


def _merged(parts: DataFrame, values: DataFrame) -> DataFrame:
    """The evidence of `parts` (with a number `row`) after their suspects' tokens have joined it: row, doc_id, total, most, number, words, n_restored."""
    base = ["row", "doc_id", "total", "most", "number", "words"]
    plain = parts.filter(F.size("tokens") == 0).select(*base, F.lit(0).cast("long").alias("n_restored"))
    some = parts.filter(F.size("tokens") > 0)
    each = some.select("row", F.explode("tokens").alias("token"))
    met = salted_lookup(each, values.select("token", "n", "changed", "value"), "token", "row", "n")
    more = met.groupBy("row").agg(F.sum("value").alias("t"), F.max("value").alias("m"), F.count_if(F.col("value") > 0).alias("k"), F.sum("changed").alias("n_restored"))
    joined = some.join(more, "row").select("row", "doc_id", (F.col("total") + F.col("t")).alias("total"), F.greatest("most", "m").alias("most"), (F.col("number") + F.col("k")).alias("number"), "words", "n_restored")
    return plain.unionByName(joined)


def _features():
    number = F.col("number").cast("double")
    return [F.log1p(F.col("total") / SCALE), F.col("most") / SCALE, F.log1p(number), number / F.greatest(F.col("words"), F.lit(1)), F.log1p(F.col("words").cast("double"))]


def _feature_rows(total: np.ndarray, most: np.ndarray, number: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The same, in numpy."""
    return np.stack([np.log1p(total / SCALE), most / SCALE, np.log1p(number), number / np.maximum(words, 1), np.log1p(words)], axis=-1)


N_FEATURES = 5


def _logistic(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Ridge logistic regression by Newton steps: intercept and weights."""
    a = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w = np.zeros(a.shape[1])
    penalty = np.diag([1e-6] + [1.0] * x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p) + 1e-9)[:, None]) + penalty, a.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def log_odds(n0: np.ndarray, n1: np.ndarray, size0: np.ndarray, size1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The log-odds of label 1 that a window shows, and their z-value, from the documents of each label with it and all of them."""
    odds = np.log((n1 + 0.5) / (size1 + 1)) - np.log((n0 + 0.5) / (size0 + 1))
    return odds, odds / np.sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5))


def _fold_rows(model):
    """y, fold, text (whole texts that hold no suspects any more) -> y, fold, words, and for each of LEAST_Z the evidence that the other folds
    give the text: totals, mosts, numbers."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, steps, z = model.value  # the place of each bin among those that count; evidence and z-value by (place, fold)
        for batch, raw, offsets in chunks(batches, limit=1 << 20):
            n = batch.num_rows
            bins, word, words = _windows(raw, offsets)
            at = slot[bins]
            word, at = word[at >= 0], at[at >= 0]
            fold = batch.column(1).to_numpy().astype(np.int64)[words.doc[word]]
            step, sure = steps[at, fold], z[at, fold]
            out = np.zeros((3, n, len(LEAST_Z)), dtype=np.int64)
            for k, least in enumerate(LEAST_Z):
                value = np.zeros(len(words.start), dtype=np.int64)
                some = (sure > least) & (step > 0)
                np.maximum.at(value, word[some], step[some])
                np.add.at(out[0, :, k], words.doc, value)
                np.maximum.at(out[1, :, k], words.doc, value)
                out[2, :, k] = np.bincount(words.doc[value > 0], minlength=n)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(LEAST_Z), pa.int32()), pa.array(x.ravel())) for x in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words.count, pa.int64()), *lists], ["y", "fold", "words", "totals", "mosts", "numbers"])

    return rows


def least_z(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> int:
    """The place in LEAST_Z with the least log loss in cross-validation (the largest value of equal ones); x: rows by LEAST_Z by features."""
    losses = []
    for k in range(len(LEAST_Z)):
        loss = 0.0
        for f in np.unique(fold).tolist():
            w = np.array(_logistic(x[fold != f, k], y[fold != f])) if (fold != f).any() else np.zeros(N_FEATURES + 1)
            p = 1 / (1 + np.exp(-np.clip(w[0] + x[fold == f, k] @ w[1:], -30, 30)))
            loss -= np.log(np.where(y[fold == f] == 1, p, 1 - p)).sum()
        losses.append(round(float(loss), 9))
    return max(k for k, loss in enumerate(losses) if loss == min(losses))


def _fitted(clean: DataFrame) -> tuple[np.ndarray, list[float]]:
    """Weights of all bins, and the logistic model, from the sample's texts (y, fold, text)."""
    spark = clean.sparkSession
    weights, final = np.zeros(1 << BINS_LOG, dtype=np.int64), [0.0] * (N_FEATURES + 1)
    sizes = np.zeros((2, FOLDS))
    for r in clean.groupBy("y", "fold").agg(F.count("*").alias("n")).toArrow().to_pylist():  # 2 * FOLDS rows
        sizes[r["y"], r["fold"]] = r["n"]
    if (sizes.sum(axis=1) == 0).any():
        if sizes.any():
            share = 0.999 if sizes[1].any() else 0.001
            final[0] = float(np.log(share / (1 - share)))
        return weights, final
    cells = clean.select((F.col("y") * FOLDS + F.col("fold")).cast("int").alias("cell"), "text").mapInArrow(_counter, "bin int, cell int, n long")
    each = [F.sum(F.when(F.col("cell") == k, F.col("n")).otherwise(F.lit(0))).alias(f"c{k}") for k in range(2 * FOLDS)]
    bins = cells.groupBy("bin").agg(*each).filter(sum((F.col(f"c{k}") for k in range(FOLDS + 1, 2 * FOLDS)), F.col(f"c{FOLDS}")) >= LEAST_DOCS).orderBy("bin").toArrow()  # 2**BINS_LOG rows at most
    n = np.array([bins.column(f"c{k}").to_numpy() for k in range(2 * FOLDS)], dtype=np.float64).reshape(2, FOLDS, -1)
    rest, rest_sizes = n.sum(axis=1, keepdims=True) - n, sizes.sum(axis=1, keepdims=True) - sizes
    odds, z = log_odds(rest[0].T, rest[1].T, rest_sizes[0], rest_sizes[1])  # by (bin, fold): from the other folds
    slot = np.full(1 << BINS_LOG, -1, dtype=np.int32)
    places = bins.column("bin").to_numpy()
    slot[places] = np.arange(len(places))
    sent = spark.sparkContext.broadcast((slot, np.where(rest[1].T >= LEAST_DOCS, np.rint(odds * SCALE), 0).astype(np.int64), z))
    found = clean.select("y", "fold", "text").mapInArrow(_fold_rows(sent), "y int, fold int, words long, totals array<long>, mosts array<long>, numbers array<long>").toArrow()  # a few numbers for each document of the sample
    y, fold, words = (found.column(c).to_numpy().astype(np.int64) for c in ("y", "fold", "words"))
    total, most, number = (found.column(c).combine_chunks().flatten().to_numpy().reshape(-1, len(LEAST_Z)) for c in ("totals", "mosts", "numbers"))
    x = _feature_rows(total, most, number, np.repeat(words[:, None], len(LEAST_Z), axis=1))
    order = np.lexsort([*x.reshape(len(x), -1).T, fold, y])  # sums in floating point shouldn't depend on the order of rows
    x, y, fold = x[order], y[order].astype(float), fold[order]
    best = least_z(x, y, fold)
    odds, z = log_odds(*n.sum(axis=1), *sizes.sum(axis=1))
    weights[places] = np.where(z > LEAST_Z[best], np.rint(odds * SCALE), 0)
    return weights, _logistic(x[:, best], y)


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5, remainder: int = 0, sample: int = SAMPLE, texts: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted, n_restored of every document; with `texts`, which writes and shuffles the texts of
    documents with suspicious words, also restored (the deobfuscated text where it differs)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = staged(docs.select("text").mapInArrow(_scan_rows, "gram long, token string, n long").groupBy("gram", "token").agg(F.sum("n").alias("n")), "tokens")
    restored = restored_tokens(counted)
    drop_staged(counted)

    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), modulus, remainder))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.round(F.avg(label)).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # its size bounds the broadcast and all that follows from it
    fitted = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    parts = staged(fitted.select("doc_id", "y", "text").mapInArrow(_part_rows(None), f"doc_id long, y int, text string, {_PARTS}"), "sample")
    clean = staged(_rewritten(parts, "doc_id", "y", restored, True), "sample_texts")
    weights, final = _fitted(clean.select("y", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold"), F.col("rewritten").alias("text")))
    shown = spark.sparkContext.broadcast(weights)
    drop_staged(parts, clean)

    values = staged(restored.mapInArrow(_value_rows(shown), "token string, n long, restored string, changed int, value long"), "values")
    drop_staged(restored)
    found = docs.mapInArrow(_part_rows(shown), f"doc_id long, text string, {_PARTS}")
    found = staged((found if texts else found.drop("text", "starts", "ends")).withColumn("row", F.monotonically_increasing_id()), "evidence")
    merged = _merged(found, values)
    if texts:
        changed = _rewritten(found.filter(F.size("tokens") > 0), "row", "doc_id", values, False).select("row", "rewritten")
        merged = merged.join(changed, "row", "left").withColumn("restored", F.when(F.col("n_restored") > 0, F.col("rewritten")))
    z = F.lit(final[0])
    for w, f in zip(final[1:], _features()):
        z = z + F.lit(w) * f
    score = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(40.0)), F.lit(-40.0))))
    out = merged.withColumn("score", score).withColumn("held_out", held_out(F.col("doc_id"), modulus, remainder)).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
    return out.select("doc_id", "held_out", "score", "predicted", "n_restored", *(["restored"] if texts else []))
