"""Language-model scores by online logistic mixing of bit predictors with hashed contexts.

A text is a series of tokens (its lower-cased words, then an end) and each token a series of binary decisions:

1. at places that the last words choose by their hash, whether the words up to the next such place are those that followed
   the same words most often in training texts; if so, nothing else is coded for them;
2. otherwise, for each word, whether training texts have it; for a known word: the PATH bits of its hash from the top, one after the other, then which of the words that share these bits
   (its share of their training tokens, exact);
3. for a new word: whether it stood earlier in this text (and then which one), or else its spelling, eight bits a byte and a
   closing byte 0.

The chance of each bit is a mix, in the logistic domain, of predictors that have counted it in training texts after hashed
contexts (none; the text's commonest short word so far; the word before; for spelling the last bytes of the word) and, for words,
in the text so far. Weights are gated by the bit's place in the token; they and the text's own counters start alike for
each text and follow its own bits, so a score depends on the model and the text alone. Weights and counters move on after each step: TOGETHER tokens, or one spelled word.

Tables of hashed contexts have a fixed size and are sums over all training texts. Exact counts of words and of what follows
at chosen places grow with the corpus: they reach a slice of texts as the rows that it asks for; no task holds them all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_AZ, crc32_of_id, materialize, new_path, read
from .runs import distinct, hashes

#: Bytes of the texts of a slice, at most (or one text).
SLICE = 8 << 20
#: Bits of a word's hash that are coded; tokens of a text between two changes of its weights; bytes of a short word, at most.
PATH, TOGETHER, SHORT = 12, 8, 3
#: Lines of 16 slots in the table of each context of words, as a power of two; these contexts.
LINES, CONTEXTS = 16, 2
#: Words before a place that choose it; one place in so many words.
ORDER, EVERY = 3, 16
#: Tokens that are scored at once, about (or one text); tokens whose places in the tables are made at once.
STEP, CHUNK = 100_000, 1 << 15
#: Weights at the start: predictors without context, of the contexts, and of the text itself; for spelling.
START = np.array([0.0, 0.45, 0.25, 0.3], np.float32)
RATE, SPELL_START, SPELL_RATE = np.float32(0.015), 0.4, 0.02
#: Observations that the wider context's chance counts for in a narrower one: in each context's table, and in the text.
TRUST, OWN_TRUST = (np.float32(2.0), np.float32(6.0)), np.float32(6.0)
#: The logit of the likeliest bit.
FAR = np.float32(np.log(1e5 - 1))
#: Hash slots for each order of the spelling contexts, and the orders in bytes.
SLOTS, ORDERS = 1 << 16, (1, 2, 3, 5)
#: Bytes of words whose spelling is counted at once, at most; longer words are counted in stretches.
STRETCH = 1 << 20
#: Words with so large a share of the training tokens are known to all tasks: they can't be more than 1 / HEAD.
HEAD = 2.0**-16
_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
END = np.uint64(0x5851F42D4C957F2D)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _near(text: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """For each byte those 1, 2, ... before it in its word, plus 1 (0: none)."""
    out = np.zeros((max(ORDERS), len(text)), np.uint16)
    more = text + np.uint16(1)
    for back, x in enumerate(out, 1):
        np.multiply(more[:-back], place[back:] >= back, out=x[back:])
    return list(out)


def _before(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The words' bytes with a closing byte each, how many each word has, and for each byte those 1, 2, ... before it in
    the word, plus 1 (0: none)."""
    text = np.frombuffer(b"\0".join([*words, b""]), np.uint8) if words else np.zeros(0, np.uint8)
    lengths = np.array([len(w) + 1 for w in words], np.int64)
    place = np.arange(len(text)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return text, lengths, _near(text, place)


#: The eight bits of each byte, from the top, and the node before each: a one and the bits so far.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)
_NODES = ((np.arange(256)[:, None] | 256) >> np.arange(8, 0, -1)).astype(np.uint64)


def _bits(text: np.ndarray, near: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The eight bits of each byte, and the slot of each order's context for each bit (stored by order)."""
    slots = np.empty((len(ORDERS), len(text), 8), np.uint64)
    node = _NODES[text]
    near = [x.astype(np.uint64) for x in near]
    for out, order in zip(slots, ORDERS):
        h = np.full(len(text), order, np.uint64)
        for x in near[:order]:
            h += x
            h *= _MIX
            h ^= h >> np.uint64(32)
        np.add(node, h[:, None], out=out)
    slots *= _MIX2
    slots >>= np.uint64(40)
    slots &= np.uint64(SLOTS - 1)
    return _BITS[text].reshape(-1), slots.view(np.int64).reshape(len(ORDERS), -1).T


def _stretches(words: list[bytes]) -> Iterator[tuple[list[bytes], list[int], list[bool]]]:
    """Words in groups of about STRETCH bytes: (bytes, bytes at its begin that are context alone, whether the word ends here).

    A longer word comes in stretches, each with the last bytes of the one before, so every byte is counted once and after its own context.
    """
    back = max(ORDERS)
    group, size = ([], [], []), 0
    for word in words:
        for a in range(0, max(len(word), 1), STRETCH):
            context = min(a, back)
            part = word[a - context : a + STRETCH]
            if size and size + len(part) >= STRETCH:
                yield group
                group, size = ([], [], []), 0
            for held, x in zip(group, (part, context, a + STRETCH >= len(word))):
                held.append(x)
            size += len(part) + 1
    if group[0]:
        yield group


def spelling_counts(words: list[bytes]) -> np.ndarray:
    """Ones and zeros of each order's slots over the words: (2, orders, slots).

    Equal bytes after equal contexts are added up before they become bits.
    """
    out = np.zeros((2, len(ORDERS), SLOTS), np.int64)
    for parts, skip, ends in _stretches(words):
        text, lengths, near = _before(parts)
        last = np.cumsum(lengths) - 1
        counted = np.ones(len(text), bool)
        counted[last[~np.array(ends)]] = False
        for i in np.flatnonzero(skip).tolist():
            counted[last[i] + 1 - lengths[i] :][: skip[i]] = False
        _count_spelling(text, near, counted, out)
    return out


def _count_spelling(text: np.ndarray, near: list[np.ndarray], counted: np.ndarray, out: np.ndarray) -> None:
    key = np.zeros(len(text), np.uint64)
    for x in [*near, text]:
        key = key * np.uint64(257) + x
    key = key[counted]
    one, number = distinct(key)
    sums = np.bincount(number, minlength=len(one)).astype(float)
    at = np.flatnonzero(counted)[one]
    for i in range(0, len(at), 1 << 16):
        cut = at[i : i + (1 << 16)]
        bits, slots = _bits(text[cut], [x[cut] for x in near])
        w = np.repeat(sums[i : i + (1 << 16)], 8)
        for y in (0, 1):
            on = bits == 1 - y
            for k in range(len(ORDERS)):
                out[y, k] += np.bincount(slots[on, k], w[on], SLOTS).astype(np.int64)


def spelling_counts_of(s: "Slice", tokens: np.ndarray, out: np.ndarray) -> None:
    """Add the spelling of the words at some tokens of a slice to out."""
    data = np.frombuffer(s.data, np.uint8)
    start, length = s.at[0, tokens].astype(np.int64), (s.at[1, tokens] - s.at[0, tokens]).astype(np.int64)
    long = length >= STRETCH >> 4
    if long.any():
        out += spelling_counts([s.word(t) for t in tokens[long].tolist()])
        start, length = start[~long], length[~long]
    ends = np.cumsum(length + 1)
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + STRETCH)))
        n = length[a:b] + 1
        last = np.cumsum(n) - 1
        place = np.arange(int(n.sum())) - np.repeat(last + 1 - n, n)
        text = data[np.minimum(np.repeat(start[a:b], n) + place, len(data) - 1)]
        text[last] = 0
        _count_spelling(text, _near(text, place), np.ones(len(text), bool), out)
        a = b


def stretch(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """What a predictor that has counted so many ones and zeros says, in the logistic domain."""
    return np.log((ones + np.float32(0.4)) / (zeros + np.float32(0.4)))


def log_odds(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """logit of ones / (ones + zeros), made in place of `ones`."""
    ones /= zeros
    np.log(ones, out=ones)
    return np.clip(ones, -FAR, FAR, out=ones)


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, np.float32(1e-5), np.float32(1 - 1e-5))
    return np.log(p / (1 - p))


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -11, 11)))


def spell(series: list[list[bytes]], table: np.ndarray) -> np.ndarray:
    """log2 of the chance of each series of words, spelled one after the other. table: stretched counts by order and slot.

    The weights, one for each order, move on after each word by the mean of its bits' errors.
    """
    out = np.zeros(len(series))
    by = sorted(range(len(series)), key=lambda i: -len(series[i]))
    live = len(by)
    weights = np.full((len(ORDERS), len(by)), SPELL_START)
    for step in range(len(series[by[0]]) if by else 0):
        while len(series[by[live - 1]]) <= step:
            live -= 1
        for a in range(0, live, 4096):
            lanes = by[a : min(a + 4096, live)]
            text, lengths, near = _before([series[i][step] for i in lanes])
            bits, slots = _bits(text, near)
            n = 8 * lengths
            w = weights[:, a : a + len(lanes)]
            x = [t[i].astype(float) for t, i in zip(table, slots.T)]
            p = squash(sum(v * np.repeat(u, n) for v, u in zip(x, w)))
            first = np.cumsum(n) - n
            out[lanes] += np.add.reduceat(np.log2(np.where(bits == 1, p, 1 - p)), first)
            off = bits - p
            for v, u in zip(x, w):
                u += SPELL_RATE * 8 * np.add.reduceat(v * off, first) / n
    return out


class Slice:
    """Tokens of some texts, one text after the other: their hashes, the distinct ones, and the contexts."""

    def __init__(self, texts: list[str]):
        parts = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.bytes = np.array([len(p) for p in parts], np.int64)
        self.data = b"\n".join([*parts, b""]).translate(LOWER_AZ)
        del parts
        data = np.frombuffer(self.data, np.uint8)
        space = _SPACE[data]
        edge = np.flatnonzero(np.r_[True, space][:-1] != space) if len(data) else np.zeros(0, np.int64)
        del space
        start, stop = edge[::2], edge[1::2]
        begin = np.cumsum(self.bytes + 1) - self.bytes - 1
        words = np.diff(np.searchsorted(start, np.r_[begin, len(data)]))
        self.n = words + 1
        self.start = np.cumsum(self.n) - self.n
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), self.n)
        at = np.arange(len(start)) + np.repeat(np.arange(len(texts)), words)
        self.h = np.full(len(self.doc), END)
        self.h[at] = hashes(data, start, stop)
        short = np.zeros(len(self.doc), bool)
        short[at] = stop - start <= SHORT
        self.short = short
        self.one, self.number = distinct(self.h)
        self.key = self.h[self.one]
        self.at = np.zeros((2, len(self.doc)), np.int32)
        self.at[:, at] = start, stop

    def word(self, token: int) -> bytes:
        return self.data[self.at[0, token] : self.at[1, token]]

    def contexts(self) -> list[np.ndarray]:
        """For each token the hashes of its contexts: the commonest short word of the text so far, the word before (0: none)."""
        first = self.start[self.doc]
        place = np.flatnonzero(self.short)
        before = np.cumsum(self.short) - self.short  # short words that stand before
        i = before - 1
        p = place[np.maximum(i, 0)] if len(place) else np.zeros(len(i), np.int64)
        there = (i >= 0) & (p >= first)
        # How often each short word has stood in its text; the last record so far names the commonest.
        doc = self.doc[place].astype(np.int64)
        pair = doc * len(self.key) + self.number[place]
        order = np.argsort(pair, kind="stable")
        fresh = np.flatnonzero(np.r_[True, pair[order][1:] != pair[order][:-1]][: len(place)])
        times = np.empty(len(place), np.int64)
        times[order] = np.arange(len(place)) - np.repeat(fresh, np.diff(np.r_[fresh, len(place)]))
        record = np.maximum.accumulate((doc << 40) + times)
        leads = np.maximum.accumulate(np.where((doc << 40) + times == record, np.arange(len(place)), 0))
        often = np.where(there, self.h[place[leads[np.maximum(i, 0)]]] if len(place) else np.uint64(0), np.uint64(0))
        return [often, np.where(np.arange(len(self.h)) > first, np.r_[np.uint64(0), self.h[:-1]], np.uint64(0))]


    def phrases(self) -> tuple[np.ndarray, ...]:
        """Begins and ends of the phrases between chosen places, hashes of their contexts and of themselves."""
        h, place = self.h, np.arange(len(self.h)) - self.start[self.doc]
        context = np.zeros(len(h), np.uint64)
        for back in range(ORDER, 0, -1):
            context = (context ^ (context >> np.uint64(31))) * _MIX
            context[back:] += h[:-back]
        context = (context ^ (context >> np.uint64(31))) * _MIX2
        at = np.flatnonzero((place >= ORDER) & ((context >> np.uint64(33)) % np.uint64(EVERY) == 0))
        stop = np.minimum(np.r_[at[1:], len(h)][: len(at)], (self.start + self.n)[self.doc[at]])
        # The hash of a phrase: a sum of its words' hashes, each times its odd place in the phrase.
        word = (h ^ (h >> np.uint64(29))) * _MIX2
        plain = np.r_[np.uint64(0), np.cumsum(word)]
        word *= np.uint64(2) * place.astype(np.uint64) + np.uint64(1)
        total = np.r_[np.uint64(0), np.cumsum(word)]
        s = (total[stop] - total[at]) - np.uint64(2) * place[at].astype(np.uint64) * (plain[stop] - plain[at])
        phrase = (s ^ (s >> np.uint64(32))) * _MIX + (stop - at).astype(np.uint64)
        return at, stop, context[at].view(np.int64), phrase.view(np.int64)


def path_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - PATH)).astype(np.int64)


def slots_of(context: np.ndarray, path: np.ndarray) -> np.ndarray:
    """The slots of each bit of a path after a context: 4 bits share a line of 16 slots."""
    out = np.empty((len(path), PATH), np.int32)
    for g in range(PATH // 4):
        h = (context + np.uint64(1 + g)) * _MIX + (path >> (PATH - 4 * g)).astype(np.uint64) * _MIX2
        h ^= h >> np.uint64(29)
        line = ((h * _MIX2) >> np.uint64(64 - LINES)).astype(np.int32) << 4
        four = (path >> (PATH - 4 - 4 * g)) & 15
        for b in range(4):
            out[:, 4 * g + b] = line + (1 << b) + (four >> (4 - b)).astype(np.int32)
    return out


def bits_of(path: np.ndarray) -> np.ndarray:
    return ((path[:, None] >> np.arange(PATH - 1, -1, -1)) & 1).astype(np.int8)


def context_counts(s: Slice, learnt: np.ndarray, out: np.ndarray) -> None:
    """Add the learnt tokens' bits to out: ones and zeros by context and slot, (2, contexts, slots)."""
    contexts, path = s.contexts(), path_of(s.h)
    at = np.flatnonzero(learnt)
    for i in range(0, len(at), 4 * CHUNK):
        cut = at[i : i + 4 * CHUNK]
        bits = bits_of(path[cut]).astype(bool)
        for k, c in enumerate(contexts):
            slots = slots_of(c[cut], path[cut])
            out[0, k] += np.bincount(slots[bits], minlength=out.shape[2]).astype(out.dtype)
            out[1, k] += np.bincount(slots[~bits], minlength=out.shape[2]).astype(out.dtype)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bool], list[str]]]:
    """Ids, whether held out, and texts, in slices that depend on the rows alone and not on how they come in batches."""
    ids, held, texts, size = [], [], [], 0
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            b = whole.slice(at, 256)
            for i, h, t in zip(b.column("doc_id").to_pylist(), b.column("held_out").to_pylist(), b.column("text").to_pylist()):
                ids.append(i)
                held.append(h)
                texts.append(t or "")
                size += len(t or "")
                if size >= SLICE:
                    yield ids, held, texts
                    ids, held, texts, size = [], [], [], 0
    if ids:
        yield ids, held, texts


#: What slices ask for and tasks have counted. kind 0: a word of a slice (key: its hash) and its training tokens there (n);
#: 1: a check of the slice (key: sum of its tokens' hashes); 2 and 3: a block of counts (key: its number) of contexts, of
#: spelling; 4: a phrase after a context (key: the context's hash), how often in training texts (n) and in others (held).
_ASK = "place long, kind int, key long, n long, phrase long, held int, blob binary"
_NAMES = [f.split()[0] for f in _ASK.split(", ")]
#: Parquet's second format, which stores ascending keys as differences.
_DELTAS = {"parquet.writer.version": "v2"}
BLOCK = 1 << 16


def _batch(place: int, kind: int, key: np.ndarray, n=None, phrase=None, held=None, blob=None) -> pa.RecordBatch:
    size = len(key)
    ints = lambda x, t: pa.nulls(size, t) if x is None else pa.array(x, t)
    return pa.RecordBatch.from_arrays([pa.array(np.full(size, place)), pa.array(np.full(size, kind, np.int32)), pa.array(key.astype(np.int64)), ints(n, pa.int64()), ints(phrase, pa.int64()), ints(held, pa.int32()), ints(blob, pa.binary())], names=_NAMES)


def _check(s: Slice) -> int:
    return int(np.sum(s.h * (np.arange(len(s.h), dtype=np.uint64) | np.uint64(1)), dtype=np.uint64).view(np.int64))


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each slice of a partition, and at the end the partition's counts."""
    from pyspark import TaskContext

    place = TaskContext.get().partitionId() << 20
    contexts = np.zeros((2, CONTEXTS, 16 << LINES), np.int32)
    spelling = np.zeros((2, len(ORDERS), SLOTS), np.int64)
    number = -1
    for number, (_, held, texts) in enumerate(_slices(batches)):
        s = Slice(texts)
        learnt = ~np.array(held, bool)[s.doc]
        seen = np.bincount(s.number[learnt], minlength=len(s.key))
        key = s.key.view(np.int64)
        by = np.argsort(key)  # ascending keys take less room in a file
        for i in range(0, len(key), 1 << 16):
            yield _batch(place + number, 0, key[by[i : i + (1 << 16)]], seen[by[i : i + (1 << 16)]])
        yield _batch(place + number, 1, np.array([_check(s)]))
        at, _, context, phrase = s.phrases()
        order = np.lexsort((phrase, context))
        context, phrase, away = context[order], phrase[order], ~learnt[at[order]]
        first = np.flatnonzero(np.r_[True, (context[1:] != context[:-1]) | (phrase[1:] != phrase[:-1])][: len(context)])
        away = np.add.reduceat(away.astype(np.int32), first) if len(first) else away
        n = np.diff(np.r_[first, len(context)]) - away
        for i in range(0, len(first), 1 << 16):
            cut = slice(i, i + (1 << 16))
            yield _batch(place + number, 4, context[first[cut]], n[cut], phrase[first[cut]], away[cut])
        del at, context, phrase, order
        context_counts(s, learnt, contexts)
        # Spelling is learnt from the words that the slice's training texts have once: new words are more like these than like common ones.
        spelling_counts_of(s, s.one[(seen == 1) & (s.key != END)], spelling)
    if number >= 0:
        for kind, counts in ((2, contexts.reshape(-1)), (3, spelling.astype(np.int32).reshape(-1))):
            for b in range(0, len(counts), BLOCK):
                yield _batch(place, kind, np.array([b // BLOCK]), blob=[zlib.compress(counts[b : b + BLOCK].tobytes(), 1)])


def _add_blobs(frame):
    import pandas as pd

    total = np.zeros(BLOCK, np.int64)
    for b, wide in zip(frame["blob"], frame["wide"]):
        total += np.frombuffer(zlib.decompress(b), np.int64 if wide else np.int32)
    return pd.DataFrame({"kind": [frame["kind"].iloc[0]], "key": [frame["key"].iloc[0]], "wide": [True], "blob": [zlib.compress(total.tobytes(), 1)]})


def _counts(asked: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the tasks' counts. Tasks are added up in groups first, so none gets a block of all tasks."""
    shape, kinds = "kind int, key long, wide boolean, blob binary", (16 << LINES, SLOTS)
    part = asked.where("kind in (2, 3)").select("kind", "key", F.lit(False).alias("wide"), "blob", F.pmod(F.hash("place"), F.lit(64)).alias("salt")).groupBy("kind", "key", "salt").applyInPandas(_add_blobs, shape)
    out = [np.zeros((2, CONTEXTS, 16 << LINES)), np.zeros((2, len(ORDERS), SLOTS))]
    for r in part.groupBy("kind", "key").applyInPandas(_add_blobs, shape).toLocalIterator():
        out[r.kind - 2].reshape(-1)[r.key * BLOCK : (r.key + 1) * BLOCK] = np.frombuffer(zlib.decompress(r.blob), np.int64)
    return out[0], out[1]


def _load(folder: str, place: int, s: Slice) -> dict[int, np.ndarray]:
    """The answers for a slice by kind: rows of key (ascending), c, top_c, top."""
    import pyarrow.dataset
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder)
    where = f"{root}/part={place >> 20}"
    if system.get_file_info(where).type == fs.FileType.NotFound:
        raise RuntimeError("the rows of a partition are not those of the first reading")
    t = pyarrow.dataset.dataset(where, filesystem=system, format="parquet").to_table(columns=["kind", "key", "c", "top_c", "top"], filter=pyarrow.dataset.field("place") == place, use_threads=False)
    kind, *rest = (t.column(x).to_numpy() for x in t.column_names)
    rows = np.stack(rest)
    if rows[0, kind == 1].tolist() != [_check(s)]:
        raise RuntimeError("the rows of a partition are not those of the first reading")
    return {k: (own := rows[:, kind == k])[:, np.argsort(own[0])] for k in (0, 4)}


def _find(rows: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The values of each wanted key, 0 where there is none; keys (the first row) ascend."""
    if not rows.shape[1]:
        return np.zeros((len(rows) - 1, len(wanted)), np.int64)
    at = np.minimum(np.searchsorted(rows[0], wanted), rows.shape[1] - 1)
    return np.where(rows[0, at] == wanted, rows[1:, at], 0)


_SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


class Model:
    """What training texts have told. mass: tokens of each path. tables: stretched counts of contexts and of spelling."""

    def __init__(self, tokens: int, words: int, once: int, mass: np.ndarray, contexts: np.ndarray, spelling: np.ndarray, head: np.ndarray):
        self.tokens, self.words, self.mass, self.head = tokens, words, mass, head
        self.new = np.float32(stretch(np.float32(tokens - once), np.float32(once)))
        self.contexts = np.ascontiguousarray(np.moveaxis(contexts, 0, 1), np.float32)  # context, ones and zeros, slot
        self.spelling = stretch(spelling[0], spelling[1]).astype(np.float32)
        tree = np.zeros(2 << PATH)
        tree[1 << PATH :] = mass
        for i in range((1 << PATH) - 1, 0, -1):
            tree[i] = tree[2 * i] + tree[2 * i + 1]
        self.plain = np.full(1 << PATH, 0.5, np.float32)  # by node: the bit's chance without a context
        ones, zeros = tree[3::2][: (1 << PATH) - 1], tree[2::2][: (1 << PATH) - 1]
        self.plain[1:] = (ones + 0.4) / (ones + zeros + 0.8)

    def cost(self, s: Slice, c: np.ndarray, followed: np.ndarray, held: np.ndarray) -> np.ndarray:
        """log2 of the chance of each text. c: training tokens of each of the slice's distinct words; followed: what is
        known of the contexts at chosen places (rows of key, c, top_c, top); held: whether a text is held out."""
        known = (c > 0)[s.number]
        path = path_of(s.h)
        out, coded = self._phrases(s, followed, held)
        share = np.zeros(len(s.key))
        own = c > 0
        share[own] = np.log2(c[own] / self.mass[path_of(s.key[own])])
        out += np.bincount(s.doc, share[s.number] * coded, len(s.n))
        out += self._new_words(s, ~known & coded)
        contexts = s.contexts()
        by = np.argsort(-s.n, kind="stable")
        d0 = 0
        while d0 < len(by):  # texts of like length are worked on together
            d1 = max(d0 + 1, min(len(by), d0 + STEP // int(s.n[by[d0]])))
            lanes = by[d0:d1]
            out[lanes] += self._mixed(s, lanes, known, coded, path, contexts)
            d0 = d1
        return out

    def _phrases(self, s: Slice, followed: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log2 of the chances at the chosen places, and which tokens are not yet coded after them.

        A hit's chance follows the training texts and, by whether the last phrase was hit, the text's own hits so far.
        """
        at, stop, context, phrase = s.phrases()
        n, top_n, top = _find(followed, context)
        told = np.flatnonzero(n > np.where(held[s.doc[at]], 0, 1))
        doc, hit = s.doc[at[told]].astype(np.int64), phrase[told] == top[told]
        chance = (top_n[told] + 0.2) / (n[told] + 1.0)
        last = np.r_[False, hit[:-1]][: len(hit)] & (np.r_[-1, doc[:-1]][: len(doc)] == doc)
        state = 2 * doc + last
        order = np.argsort(state, kind="stable")
        h = hit[order].astype(np.int64)
        first = np.flatnonzero(np.r_[True, state[order][1:] != state[order][:-1]][: len(order)])
        size = np.diff(np.r_[first, len(order)])
        before = np.cumsum(h) - h
        hits, trials = np.empty(len(h), np.int64), np.empty(len(h), np.int64)
        hits[order] = before - np.repeat(before[first], size)
        trials[order] = np.arange(len(h)) - np.repeat(first, size)
        p = (hits + 2 * np.where(last, (1 + chance) / 2, chance)) / (trials + 2)
        edge = np.zeros(len(s.h) + 1, np.int32)
        np.add.at(edge, at[told][hit], 1)
        np.add.at(edge, stop[told][hit], -1)
        return np.bincount(doc, np.log2(np.where(hit, p, 1 - p)), len(s.n)).astype(float), np.cumsum(edge[:-1]) == 0

    def _new_words(self, s: Slice, new: np.ndarray) -> np.ndarray:
        """Repeats of new words, and their spelling."""
        at = np.flatnonzero(new)
        if not len(at):
            return np.zeros(len(s.n))
        doc = s.doc[at]
        pair = (doc.astype(np.uint64) << np.uint64(32)) | s.number[at].astype(np.uint64)
        order = np.argsort(pair, kind="stable")
        first = np.zeros(len(at), bool)
        first[order] = np.r_[True, pair[order][1:] != pair[order][:-1]]
        begin = np.searchsorted(doc, doc, side="left")
        before = np.arange(len(at)) - begin
        unlike = np.cumsum(first) - first
        unlike = unlike - unlike[begin]  # distinct new words of this text so far
        again = (before - unlike + 0.5) / (before + 1)
        cost = np.where(first, np.log2(1 - again), np.log2(again / np.maximum(unlike, 1)))
        out = np.bincount(doc, cost, len(s.n)).astype(float)
        spelled, of = at[first], doc[first]
        texts, begin = np.unique(of, return_index=True)
        cuts = [*begin.tolist(), len(of)]
        out[texts] += spell([[s.word(t) if s.h[t] != END else b"" for t in spelled[a:b].tolist()] for a, b in zip(cuts[:-1], cuts[1:])], self.spelling)
        return out

    def _mixed(self, s: Slice, lanes: np.ndarray, known: np.ndarray, coded: np.ndarray, path: np.ndarray, contexts: list[np.ndarray]) -> np.ndarray:
        """Whether each word is known, and its path, for some texts by falling length."""
        whole = s.n[lanes]
        token = np.repeat(s.start[lanes] - (np.cumsum(whole) - whole), whole) + np.arange(whole.sum())
        lane = np.repeat(np.arange(len(lanes)), whole)[coded[token]]
        token = token[coded[token]]
        n = np.bincount(lane, minlength=len(lanes))
        by = np.argsort(-n, kind="stable")  # lanes by falling number of tokens
        turn = np.empty(len(by), np.int64)
        turn[by] = np.arange(len(by))
        place = np.arange(len(token)) - (np.cumsum(n) - n)[lane]
        steps = -(-n[by] // TOGETHER)
        live = np.searchsorted(-steps, -np.arange(int(steps[0])), side="left")
        edge = np.r_[0, np.cumsum(live)]
        width, size = 1 + PATH, int(edge[-1]) * TOGETHER
        # Row of a token: its step's begin, the text's turn, its place in the step. Rows without a token count for nothing.
        row = (edge[place // TOGETHER] + turn[lane]) * TOGETHER + place % TOGETHER
        own, real = np.zeros(size, np.int64), np.zeros(size, np.float32)
        own[row], real[row] = token, 1
        told = known[own]
        x = np.zeros((2 + CONTEXTS, size, width), np.float32)  # by predictor
        y = np.zeros((size, width), np.float32)
        node = np.zeros((size, width), np.int32)
        on = np.empty((size, width), np.float32)
        prior = np.full((size, width), squash(self.new), np.float32)
        y[:, 0], on[:, 0], x[0, :, 0] = told, real, self.new
        on[:, 1:] = (real * told)[:, None]
        flat = logit(self.plain)
        for i in range(0, size, CHUNK):
            r = slice(i, min(i + CHUNK, size))
            t = own[r]
            p = path[t]
            nodes = (1 << np.arange(PATH)) | (p[:, None] >> (PATH - np.arange(PATH)))
            y[r, 1:], node[r, 1:] = bits_of(p), nodes
            wide = self.plain[nodes]
            x[0, r, 1:] = flat[nodes]
            for k, c in enumerate(contexts):
                n = self.contexts[k]
                slots = slots_of(c[t], p)
                ones, zeros = n[0][slots], n[1][slots]
                ones += TRUST[k] * wide
                zeros += TRUST[k] * (1 - wide)
                if not k:
                    wide = ones / (ones + zeros)
                x[1 + k, r, 1:] = log_odds(ones, zeros)
            prior[r, 1:] = wide
        prior *= OWN_TRUST
        rest = OWN_TRUST - prior
        weights = np.empty((len(START), len(lanes), width), np.float32)
        weights[:] = START[:, None, None]
        weights[:, :, 0] = np.array([1, 0, 0, 0])[:, None]
        zeros, ones = np.zeros((2, len(lanes) << PATH), np.float32)  # of each text's nodes
        node += (np.repeat(np.arange(size // TOGETHER) - np.repeat(edge[:-1], live), TOGETHER) << PATH).astype(np.int32)[:, None]
        hits, misses = on * y, on * (1 - y)
        out = np.zeros(len(lanes))
        for a, b in zip((edge[:-1] * TOGETHER).tolist(), (edge[1:] * TOGETHER).tolist()):
            k = (b - a) // TOGETHER
            shape = (k, TOGETHER, width)
            at, bit, use = node[a:b], y[a:b].reshape(shape), on[a:b].reshape(shape)
            x[-1, a:b] = log_odds(ones[at] + prior[a:b], zeros[at] + rest[a:b])
            v = x[:, a:b].reshape(-1, *shape)
            z = v[0] * weights[0, :k, None]
            for u, w in zip(v[1:], weights[1:]):
                z += u * w[:k, None]
            p = squash(z)
            off = bit - p
            out[:k] += (np.log2(np.abs(1 - bit - p)) * use).sum(axis=(1, 2), dtype=float)
            off *= use
            off *= RATE
            for u, w in zip(v, weights):
                w[:k] += (u * off).sum(axis=1)
            np.add.at(ones, at.reshape(-1), hits[a:b].reshape(-1))
            np.add.at(zeros, at.reshape(-1), misses[a:b].reshape(-1))
        return out[turn]


def _score(folder: str, model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place = TaskContext.get().partitionId() << 20
        for number, (ids, held, texts) in enumerate(_slices(batches)):
            s = Slice(texts)
            del texts
            found, own = _load(folder, place + number, s), s.key.view(np.int64)
            c = np.maximum(_find(found[0], own)[0], _find(model.head, own)[0])
            cost, n = model.cost(s, c, found[4], np.array(held, bool)), len(ids)
            base = np.log10((c + 1) / (model.tokens + model.words + 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(held), pa.array(s.n), pa.array(np.bincount(s.doc, (c > 0)[s.number], n).astype(np.int64)), pa.array(np.full(n, model.tokens, np.int64)), pa.array(np.bincount(s.doc, base[s.number], n)), pa.array(cost * np.log10(2)), pa.array(-cost / np.maximum(s.bytes, 1))],
                names=[f.split()[0] for f in _SCORE.split(", ")],
            )

    return run


def score(docs: DataFrame) -> DataFrame:
    """Scores of every document by a model of those whose crc32 of the id (as text), mod 7, is not 2: the columns of _SCORE.

    Null text: no words, so its end alone. A null id counts as a training document. Repeated rows are learnt from and
    scored one by one. Without training documents every word is new. No documents: no rows. Other columns are not read.
    Words are told apart by 64-bit hashes.

    docs must give the same rows in the same partitions each time it runs, as a table read from files does; if it doesn't,
    the job fails.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.pmod(crc32_of_id(), F.lit(7)) == 2, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    path = new_path(spark, "asked")
    rows.mapInArrow(_ask, _ASK).write.options(**_DELTAS).parquet(path)
    asked = spark.read.schema(_ASK).parquet(path)
    contexts, spelling = _counts(asked)
    words = materialize(asked.where("kind = 0 and n > 0").groupBy("key").agg(F.sum("n").alias("c")), "words")
    of = F.shiftrightunsigned("key", 64 - PATH)
    mass, distinct_words, once = np.zeros(1 << PATH), 0, 0
    for r in words.groupBy(of.alias("path")).agg(F.sum("c").alias("c"), F.count("*").alias("n"), F.count_if(F.col("c") == 1).alias("once")).collect():
        mass[r.path], distinct_words, once = r.c, distinct_words + r.n, once + r.once
    tokens = int(mass.sum())
    # The commonest words, whose rows would be as many as the slices, go to all tasks; the others' rows are joined.
    common = F.col("c") >= max(1, HEAD * tokens)
    head = np.array(sorted((r.key, r.c) for r in words.where(common).collect()), np.int64).reshape(-1, 2).T
    spare = [F.lit(0).cast("long").alias(x) for x in ("c", "top_c", "top")]
    known = asked.where("kind = 0").select("place", "kind", "key").join(words.where(~common), "key").select("place", "kind", "key", "c", *spare[1:])
    checks = asked.where("kind = 1").select("place", "kind", "key", *spare)
    phrases = asked.where("kind = 4")
    after = phrases.groupBy("key", "phrase").agg(F.sum("n").alias("n"), F.sum("held").alias("held"))
    after = after.groupBy("key").agg(F.sum("n").alias("c"), F.sum("held").alias("held"), F.max(F.struct("n", "phrase")).alias("m")).where("c > 1 or (c > 0 and held > 0)")
    told = phrases.select("place", "kind", "key").join(after, "key").select("place", "kind", "key", "c", F.col("m.n").alias("top_c"), F.col("m.phrase").alias("top"))
    folder = new_path(spark, "answers")
    known.unionByName(told).unionByName(checks).withColumn("part", F.shiftright("place", 20)).repartition("part").sortWithinPartitions("part", "place", "kind", "key").write.options(**_DELTAS).partitionBy("part").parquet(folder)
    return rows.mapInArrow(_score(folder, Model(tokens, distinct_words, once, mass, contexts, spelling, head)), _SCORE)


def op1_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"))
