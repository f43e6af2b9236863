"""Passages of held-out evaluation items inside a corpus.

Spaced-seed hashing.  Texts become words without case, punctuation, markup,
escapes and invisible characters.  A seed is a fixed mask over consecutive word
positions; only the positions set in the mask are hashed, so the others may
differ.  Seeds of the corpus are joined with those of the items (by hash, with
the items' side broadcast in blocks of a fixed number of words), and around the
hits the two texts are aligned on the diagonals the hits lie on: a leak is a
stretch of the item's own words that stands in the document, with about one word
in ten altered and at most one interruption by other lines.  A part of a passage
that is too short for a seed needs a run of three words that is rare where it
stands; one or two words elsewhere in a document are no part.

Words shared by several items in long runs (stock paragraphs) are not an item's
own and neither seed nor count.  How many items share a run is counted over all
items, whatever the blocks.  Nothing is dropped for being common as such: a seed
is left out only where half of the seeds around it are rarer, so every stretch
keeps the rarer half of its seeds.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 20
SHARE = 0.87  # least share of equal words in a stretch: about one in ten altered, and what dropping or doubling a word costs
ALTERED = 0.1  # altered words of a passage that is only long enough with an altered end
STOCK_WORDS = 12  # a run of so many words in two items belongs to neither
MASKS = ("1101100101", "1110101011", "11011011", "1010111001", "1100110011")
NEAR = 4  # diagonals so near are one place of the document
CELLS = 1_000_000  # words of an alignment held at once
BLOCK_WORDS = 1_000_000  # words of items held by a task at once; more are taken in blocks
SLIVER = 1e-9  # rounding of shares

WORD = re.compile(r"[^\W_]+")
WORD_ASCII = re.compile(r"[a-z0-9]+")
TAG = re.compile(r"</?[a-zA-Z][^<>\n]{0,200}>")
ESCAPE = re.compile(r"\\(?:[nrtbfv0]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4})")
PERCENT = re.compile(r"%(?:20|0A|0D|09|2C|2E|22|27)", re.I)


class _Plain(dict):
    """Translation of characters, filled as they are met: invisible ones go, wide and ligature forms become plain."""

    def __missing__(self, code: int):
        c = chr(code)
        if unicodedata.category(c) in ("Cf", "Mn") or c == "­":
            out: str | int | None = None
        else:
            out = unicodedata.normalize("NFKC", c) if code > 127 else code
        self[code] = out
        return out


_plain = _Plain()


def _escape(m: re.Match) -> str:
    s = m.group()
    return chr(int(s[2:], 16)) if s[1] in "xu" else " "


def words(text: str) -> list[str]:
    """Words of a text, lower case, free of markup, escapes and invisible characters."""
    if "\\" in text:
        text = ESCAPE.sub(_escape, text)
    for _ in range(3):  # escapes may be escaped again
        plain = html.unescape(text) if "&" in text else text
        if plain == text:
            break
        text = plain
    if "<" in text:
        text = TAG.sub(" ", text)
    if "%" in text:
        text = PERCENT.sub(" ", text)
    if text.isascii():
        return WORD_ASCII.findall(text.lower())
    return WORD.findall(text.translate(_plain).casefold())


_rng = np.random.default_rng(20040101)
SHAPES = [np.arange(STOCK_WORDS), np.arange(3), *[np.flatnonzero(np.array(list(m)) == "1") for m in MASKS]]
FACTORS = [_rng.integers(1, 2**62, len(m), dtype=np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1) for m in SHAPES]
STOCK, RUN, SEEDS = 0, 1, range(2, len(SHAPES))  # shapes of grams: stock runs, runs of three, seeds


def word_code(word: str) -> int:
    return int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def grams(words_of: np.ndarray, shape: int) -> np.ndarray:
    """Hashes of the grams of a shape at every position of a text."""
    return seed_hashes(words_of, SHAPES[shape], FACTORS[shape], np.arange(max(0, len(words_of) - SHAPES[shape][-1])))


def sharers(items: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
    """Of each item, shape and position the number of items that hold its gram."""
    out: list[list[np.ndarray]] = [[] for _ in items]
    for shape in range(len(SHAPES)):
        line = np.concatenate([i[shape] for i in items]) if items else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(items)), [len(i[shape]) for i in items])
        _, gram = np.unique(line, return_inverse=True)
        gram = gram.ravel()
        pairs = np.unique(np.stack([gram, owner], 1), axis=0)[:, 0] if len(line) else np.zeros(0, np.int64)
        count = np.bincount(pairs, minlength=1)[gram] if len(line) else pairs
        for n, part in enumerate(np.split(count, np.cumsum([len(i[shape]) for i in items])[:-1]) if items else []):
            out[n].append(part)
    return out


def rarer_half(count: np.ndarray) -> np.ndarray:
    """True where at most half of the counts around (MIN_WORDS positions) are smaller: every stretch keeps its rarer half."""
    n, side = len(count), MIN_WORDS // 2
    if not n:
        return np.zeros(0, bool)
    around = np.lib.stride_tricks.sliding_window_view(np.pad(count, side, constant_values=-1), 2 * side + 1)
    seen = (around >= 0).sum(1)
    return 2 * ((around >= 0) & (around < count[:, None])).sum(1) <= seen


class Items:
    """Seed table of a block of evaluation items; bounded, and sent to every task.

    ``shared`` says of each item how many of all items hold its grams (as
    ``sharers``); without it the block is all there is.
    """

    def __init__(self, rows: list[tuple[int, str | None]], shared: list[list[np.ndarray]] | None = None):
        self.ids = [int(i) for i, _ in rows]
        texts = [words(t) if t else [] for _, t in rows]
        self.vocab: dict[str, int] = {}
        self.words = [np.array([self.vocab.setdefault(w, len(self.vocab)) for w in t], np.int64) for t in texts]
        if shared is None:
            code = np.array([word_code(w) for w in self.vocab], np.int64)
            shared = sharers([[grams(code[w], k) for k in range(len(SHAPES))] for w in self.words])
        self.own, self.rare = [], []
        for w, counts in zip(self.words, shared):
            own, rare, m = np.ones(len(w), bool), np.zeros(len(w), bool), len(counts[RUN])
            for k in np.flatnonzero(counts[STOCK] > 1):
                own[k : k + STOCK_WORDS] = False
            self.own.append(own)
            # rare runs of three own words find the parts of a passage that are too short for a seed
            rare[:m] = rarer_half(counts[RUN])
            for k in range(3):
                rare[:m] &= own[k : k + m]
            self.rare.append(rare)
        self.hashes, self.places = [], []
        for shape in SEEDS:
            mask = SHAPES[shape]
            hs, ps = [np.zeros(0, np.uint64)], [np.zeros((0, 2), np.int64)]
            for n, (w, own, counts) in enumerate(zip(self.words, self.own, shared)):
                m = len(w) - mask[-1]
                if m <= 0:
                    continue
                ok = np.flatnonzero(np.all([own[k : k + m] for k in mask], axis=0))
                ok = ok[rarer_half(counts[shape][ok])]
                hs.append(seed_hashes(w, mask, FACTORS[shape], ok))
                ps.append(np.stack([np.full(len(ok), n), ok], 1))
            h, p = np.concatenate(hs), np.concatenate(ps)
            order = np.argsort(h, kind="stable")
            self.hashes.append(h[order])
            self.places.append(p[order])


def seed_hashes(w: np.ndarray, mask: np.ndarray, factor: np.ndarray, at: np.ndarray) -> np.ndarray:
    h = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k, f in zip(mask, factor):
            h = (h + w[at + k].astype(np.uint64) + np.uint64(1)) * f
            h ^= h >> np.uint64(29)
    return h


def run_hashes(w: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of three known words of a text, and their positions."""
    known = w >= 0
    at = np.flatnonzero(known[:-2] & known[1:-1] & known[2:])
    return seed_hashes(w, SHAPES[RUN], FACTORS[RUN], at), at


def run_diagonals(n: int, items: Items, runs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Diagonals on which a text has a rare run of the item, wherever it stands."""
    start = np.flatnonzero(items.rare[n])
    h = seed_hashes(items.words[n], SHAPES[RUN], FACTORS[RUN], start)
    order = np.argsort(h, kind="stable")
    h, start = h[order], start[order]
    lo, hi = np.searchsorted(h, runs[0], "left"), np.searchsorted(h, runs[0], "right")
    size = hi - lo
    which = np.repeat(lo - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
    return np.unique(np.repeat(runs[1], size) - start[which])


def live_marks(item: np.ndarray, doc: np.ndarray, diagonals: np.ndarray, rare: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, item position and strength of the equal words that count, in the order of the diagonals.

    A mark counts where its diagonal is locally alive: enough marks among the words
    around it, or a ``rare`` run of three.  The diagonals are taken in chunks, so that any number of them fits.
    """
    n, rows = len(item), max(1, CELLS // len(item))
    out = []
    for c in range(0, len(diagonals), rows):
        at = diagonals[c : c + rows, None] + np.arange(n)
        where = (at >= 0) & (at < len(doc)) & (item == doc[np.clip(at, 0, len(doc) - 1)])
        sums = np.pad(np.cumsum(where, 1, dtype=np.int32), ((0, 0), (5, 4)), mode="constant")
        sums[:, n + 5 :] = sums[:, n + 4 : n + 5]
        local = sums[:, 9:] - sums[:, :n]
        live = where & (local >= 4)
        if rare is not None and n > 2:
            run = where[:, :-2] & where[:, 1:-1] & where[:, 2:] & rare[:-2]
            for j in range(3):
                live[:, j : n - 2 + j] |= run
        k, i = np.nonzero(live)
        out.append((diagonals[c + k], i, local[k, i]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def placed(diag: np.ndarray, pos: np.ndarray, n: int, size_doc: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What the document holds of the item at one place each: (marks of n words, the item words that lie within
    the document as (from, to), first and last diagonal with these marks).

    A place is a diagonal with the near ones, so that words may be dropped or
    doubled; copies of a passage are places of their own.
    """
    centre = np.unique(diag)
    lo, hi = np.searchsorted(diag, centre - NEAR), np.searchsorted(diag, centre + NEAR, "right")
    seen: dict[tuple, list[int]] = {}
    rows = max(1, CELLS // n)
    for c in range(0, len(centre), rows):
        size = (hi - lo)[c : c + rows]
        which = np.repeat(lo[c : c + rows] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        marks = np.zeros((len(size), n), bool)
        marks[np.repeat(np.arange(len(size)), size), pos[which]] = True
        for d, key in zip(centre[c : c + rows].tolist(), np.packbits(marks, axis=1)):
            seen.setdefault((key.tobytes(), max(0, -d), min(n, size_doc - d)), [d, d])[1] = d
    marks = np.unpackbits(np.frombuffer(b"".join(k for k, _, _ in seen), np.uint8).reshape(len(seen), -1), axis=1, count=n).astype(bool)
    ends, within = np.array(list(seen.values())), np.array([k[1:] for k in seen])
    order = np.argsort(-marks.sum(1), kind="stable")
    return marks[order], within[order], ends[order, 0], ends[order, 1]


def longest_stretch(item: np.ndarray, own: np.ndarray, doc: np.ndarray, diagonals: np.ndarray, rare: np.ndarray, weak: np.ndarray) -> int:
    """Words of the longest stretch of the item's own words that the document holds.

    Per diagonal (document position minus item position) equal words are marked.
    Every place of the document is judged on its own, and every two places in their
    order as the parts of a passage with other lines in between.  ``weak`` diagonals
    have rare runs of the item but need no seed: they hold the short parts.
    """
    n = len(item)
    diag, pos, local = live_marks(item, doc, diagonals)
    d, i, _ = live_marks(item, doc, weak, rare)
    if len(np.unique(np.r_[pos, i])) < MIN_WORDS * SHARE:
        return 0
    best = drifting(diag, pos, local, own) if len(diag) else 0
    diag, pos = np.r_[diag, d], np.r_[pos, i]
    order = np.argsort(diag, kind="stable")
    marks, within, first, last = placed(diag[order], pos[order], n, len(doc))
    size = marks.sum(1)
    for m, k, (lo, hi) in zip(marks, size, within):
        if min(n, int(k / SHARE)) > best:
            best = max(best, dense(np.flatnonzero(m), own, lo, hi))
    rows = max(1, CELLS // len(marks))
    for c in range(0, len(marks), rows):
        both = size[c : c + rows, None] + size - marks[c : c + rows].astype(np.float32) @ marks.T.astype(np.float32)
        both[first[c : c + rows, None] >= last] = 0
        for x, y in zip(*np.nonzero(np.minimum(n, both / SHARE) >= max(best + 1, MIN_WORDS * 1.0))):
            if min(n, both[x, y] / SHARE) >= best + 1:
                best = max(best, parted(marks[c + x], marks[y], own, within[c + x, 0], within[y, 1]))
    return best


def parted(before: np.ndarray, after: np.ndarray, own: np.ndarray, lo: int, hi: int) -> int:
    """Longest stretch that begins with marks of one place and goes on with those of a later one.

    The parts need only be tried where marks of the first place alone are followed
    by marks of the second alone: any other parting has fewer marks.
    """
    best = 0
    alone = np.flatnonzero(before != after)
    head = before[alone]
    for p in alone[:-1][head[:-1] & ~head[1:]]:
        seg = np.r_[np.flatnonzero(before[: p + 1]), np.flatnonzero(after[p + 1 :]) + p + 1]
        best = max(best, dense(seg, own, lo, hi))
    return best


def drifting(diag: np.ndarray, pos: np.ndarray, local: np.ndarray, own: np.ndarray) -> int:
    """Longest stretch along the strongest diagonal of each word: long passages may drift over many near diagonals.

    It may step between near diagonals and once over a wider gap.
    """
    order = np.lexsort((diag, -local, pos))
    marks, at = np.unique(pos[order], return_index=True)
    best, diag = 0, diag[order][at]
    # cut where the order breaks or a second wide gap comes
    step = np.diff(diag)
    wide = np.abs(step) > NEAR
    back = step < -8
    starts = np.flatnonzero(np.r_[True, back])
    for s, e in zip(starts, np.r_[starts[1:], len(marks)]):
        gaps = np.flatnonzero(wide[s : e - 1]) + s + 1 if e - s > 1 else np.zeros(0, int)
        cuts = np.r_[s, gaps, e]
        for p in range(len(cuts) - 1):
            seg = marks[cuts[p] : cuts[min(p + 2, len(cuts) - 1)]]
            best = max(best, dense(seg, own))
    return best


def dense(seg: np.ndarray, own: np.ndarray, lo: int = 0, hi: int = 0) -> int:
    """Length of the longest window of own item positions that is mostly marked; ends are marked, gaps short.

    A window just short of MIN_WORDS may take altered words at its ends, one at
    each, from the item words ``lo`` to ``hi`` that lie within the document, if no
    more than ALTERED of the words are altered then.

    SHARE of the words must be marked.  Time and memory are linear in the marks, but
    for sorting.
    """
    if len(seg) < MIN_WORDS * SHARE:
        return 0
    best = 0
    breaks = np.flatnonzero((np.diff(seg) > 4) | (np.diff(np.cumsum(~own)[seg]) > 0))
    for part in np.split(seg, breaks + 1):
        m = len(part)
        if m < MIN_WORDS * SHARE:
            continue
        # the window from mark i to mark j is good where end[j] is not less than begin[i]
        k = np.arange(m)
        begin, end = k - SHARE * part - SLIVER, k + 1 - SHARE * (part + 1)
        # last good j of each i: the greatest j whose best end from j on is not less than begin[i]
        later = np.maximum.accumulate(end[::-1])[::-1]
        j = np.searchsorted(-later, -begin, side="right") - 1
        some = j >= k
        if some.any():
            best = max(best, int((part[j[some]] - part[k[some]] + 1).max()))
        if best < MIN_WORDS and hi > lo:
            best = max(best, with_altered_ends(part, own, lo, hi))
    return best


def with_altered_ends(part: np.ndarray, own: np.ndarray, lo: int, hi: int) -> int:
    """MIN_WORDS if a window that lacks a word or two reaches them with altered words at its ends, else 0."""
    for lack in (1, 2):
        # a window that is to have MIN_WORDS - lack words ends at one place only
        want = part + MIN_WORDS - lack - 1
        j = np.searchsorted(part, want)
        i = np.flatnonzero((j < len(part)) & (part[np.minimum(j, len(part) - 1)] == want))
        j = j[i]
        left, right = part[i] - 1, part[j] + 1
        free_l, free_r = (left >= lo) & own[left], (right < hi) & own[np.minimum(right, len(own) - 1)]
        ok = (free_l | free_r) if lack == 1 else (free_l & free_r)
        if (ok & (j - i + 1 >= (1 - ALTERED) * MIN_WORDS)).any():
            return MIN_WORDS
    return 0


def leaks_of(texts: list[str | None], items: Items) -> list[tuple[int, int, int]]:
    """(number of the text, number of the item, words) of the leaks in a batch of texts."""
    look = items.vocab.get
    ids: list[np.ndarray] = []
    for t in texts:
        w = words(t) if t else []
        ids.append(np.fromiter(map(look, w, [-1] * len(w)), np.int64, len(w)))
    size = np.array([len(x) for x in ids])
    start = np.r_[0, np.cumsum(size)]
    flat = np.concatenate(ids) if len(ids) else np.zeros(0, np.int64)
    if not len(flat):
        return []
    doc = np.repeat(np.arange(len(ids)), size)
    known = np.r_[0, np.cumsum(flat >= 0)]
    hits = []
    for shape, hs, places in zip(SEEDS, items.hashes, items.places):
        mask, factor = SHAPES[shape], FACTORS[shape]
        m = len(flat) - mask[-1]
        if m <= 0 or not len(hs):
            continue
        at = np.flatnonzero((known[mask[-1] + 1 : mask[-1] + 1 + m] - known[:m] >= len(mask)) & (doc[:m] == doc[mask[-1] : mask[-1] + m]))
        if len(at):
            at = at[np.all([flat[at + k] >= 0 for k in mask], axis=0)]
        h = seed_hashes(flat, mask, factor, at)
        lo, hi = np.searchsorted(hs, h, "left"), np.searchsorted(hs, h, "right")
        some = np.flatnonzero(hi > lo)
        n = (hi - lo)[some]
        which = np.repeat(lo[some] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        p = np.repeat(at[some], n)
        hits.append(np.stack([doc[p], places[which, 0], p - start[doc[p]] - places[which, 1]], 1))
    out = []
    runs: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # of the document at hand
    if sum(map(len, hits)):
        h = np.unique(np.concatenate(hits), axis=0)
        edges = np.flatnonzero(np.r_[True, (h[1:, 0] != h[:-1, 0]) | (h[1:, 1] != h[:-1, 1]), True])
        for a, b in zip(edges[:-1], edges[1:]):
            d, i = int(h[a, 0]), int(h[a, 1])
            # near diagonals of a hit catch words dropped or doubled beside it
            diag = np.unique(h[a:b, 2][:, None] + np.arange(-2, 3))
            if d not in runs:
                runs = {d: run_hashes(ids[d], items)}
            n = longest_stretch(items.words[i], items.own[i], ids[d], diag, items.rare[i], run_diagonals(i, items, runs[d]))
            if n >= MIN_WORDS:
                out.append((d, i, n))
    return out


def counted(items: DataFrame, text: str, item_key: str) -> DataFrame:
    """(item, text, marks): every item with the grams it shares with others, as structs (shape, pos, n); counted by Spark over all items."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, t in zip(batch[0].to_pylist(), batch[1].to_pylist()):
                code = np.array([word_code(w) for w in words(t)] if t else [], np.int64)
                for shape in range(len(SHAPES)):
                    h = grams(code, shape)
                    yield pa.record_batch({"no": pa.array(np.full(len(h), n)), "shape": pa.array(np.full(len(h), shape, np.int32)), "pos": pa.array(np.arange(len(h), dtype=np.int32)), "h": pa.array(h.view(np.int64))})

    # several rows may have one id, so rows are told apart by a number of their own
    numbered = items.select(F.col(item_key).alias("item"), F.col(text).alias("text")).where("item is not null").withColumn("no", F.struct("item", F.xxhash64("text")))
    numbered = numbered.groupBy("no").agg(F.first("item").alias("item"), F.first("text").alias("text")).withColumn("no", F.xxhash64("no"))
    line = numbered.select("no", "text").mapInArrow(cut, "no long, shape int, pos int, h long")
    shared = line.groupBy("shape", "h").agg(F.countDistinct("no").cast("int").alias("n")).where("n > 1")
    marks = line.join(shared, ["shape", "h"]).groupBy("no").agg(F.collect_list(F.struct("shape", "pos", "n")).alias("marks"))
    return numbered.join(marks, "no", "left").select("item", "text", "marks")


def shared_of(text: str | None, marks: list | None) -> list[np.ndarray]:
    """Counts of an item as ``sharers`` gives them, from the marks of ``counted``."""
    n = len(words(text)) if text else 0
    out = [np.ones(max(0, n - shape[-1]), np.int64) for shape in SHAPES]
    for shape, pos, k in marks or ():
        out[shape][pos] = k
    return out


def leaked_items(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_key: str = "item_id", block: int = BLOCK_WORDS) -> DataFrame:
    """(key, item_key, n_words): every document with the items it leaks and the words of the longest stretch.

    Map-only over the whole corpus.  Items of no more than ``block`` words together
    are one seed table; more are taken in blocks of that size, with their shared
    grams counted by Spark, and give the same rows.  Null, empty and blank texts leak
    nothing; items whose own text has fewer than MIN_WORDS words cannot be found;
    repeated documents each come out, repeated rows of an item count once; documents
    or items of any length are read whole.
    """
    spark = docs.sparkSession
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, `{item_key}` bigint, n_words int"

    def search(table: Items) -> DataFrame:
        sent = spark.sparkContext.broadcast(table)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = sent.value
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    part = batch.slice(at, 1000)
                    got = leaks_of(part[1].to_pylist(), t)
                    yield pa.record_batch({
                        key: part[0].take(pa.array([d for d, _, _ in got], pa.int64())),
                        item_key: pa.array([t.ids[i] for _, i, _ in got], pa.int64()),
                        "n_words": pa.array([n for _, _, n in got], pa.int32()),
                    })

        return docs.select(key, text).mapInArrow(run, schema)

    def blocks(rows, size) -> Iterator[list]:
        held, n = [], 0
        for row in rows:
            held.append(row)
            n += size(row)
            if n > block:
                yield held
                held, n = [], 0
        yield held

    n_words = lambda r: len(words(r[1])) if r[1] else 0
    each = items.select(item_key, text).where(f"{item_key} is not null").distinct().orderBy(item_key, text).toLocalIterator()
    first = next(blocks(each, n_words))
    rest = next(each, None)
    if rest is None:
        return search(Items([(r[0], r[1]) for r in first]))
    tables = blocks(counted(items, text, item_key).orderBy("item", "text").toLocalIterator(), n_words)
    out = [search(Items([(r[0], r[1]) for r in b], [shared_of(r[1], r[2]) for r in b])) for b in tables]
    total = out[0]
    for more in out[1:]:
        total = total.unionByName(more)
    return total


def p9_found(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return leaked_items(docs, spark.read.parquet(f"{sf_dir}/eval_items.parquet")).select("doc_id", "item_id").distinct()
