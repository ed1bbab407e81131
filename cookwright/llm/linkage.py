"""Matching records of two sources without a common key.

Each record is compared with every record of the other side whose title shares a word with its own, by sketches of the
fields and then by the ingredients themselves; so what is found doesn't depend on the size of the tables. Records whose
titles share no word, through slips in short titles, are sought in blocks of equal least hashes of ingredient words
(weighted by their rarity), and as neighbours under composite sort keys that begin with such hashes.
What is close is scored with weighted field similarities, and a one-to-one assignment of the highest total confidence
decides between rivals.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cookwright.functions.encoding import repair
from cookwright.plans.frames import spread, stored

#: Sort keys that begin with the publisher, the title and the ingredients: only the last can bring titles together that
#: share no word, and all others meet in blocks.
KEYS = (0, 0, 2)
#: Records of the other side on each side that a record is compared with under each key, and the places they lie within.
WINDOW, REACH = 30, 600
#: Words of a title up to which slips may leave it no word in common with its match: such records also meet in blocks of
#: three equal least hashes of their foods, under so many keys.
SHORT, FOOD_BLOCKS = 4, 4
#: Records that share a title word, beyond which their block is compared in parts, each part of one side with each of the
#: other (a bound on the rows that a task holds). Length of a range that is compared in place, and pairs compared at once.
PART, WIDE, AT_ONCE = 500_000, 1_000, 1 << 20
#: Least similarities of titles and of ingredients, and of the whole, for a match.
LEAST_TITLE, LEAST_FOODS, LEAST = 0.5, 0.43, 0.5
WEIGHTS = {"title": 0.4, "foods": 0.5, "publisher": 0.1}
#: Differing bits, of 128 and of 64, up to which sketches of foods and of titles may belong to a match, and of both
#: together. At scale 0.1 these let 4,415 of 4,415 pairs pass that the similarities accept.
FOOD_BITS, TITLE_BITS, BITS = 46, 28, 62
#: Places of the table of word frequencies (bounded, so that it can be broadcast; words that share one count together),
#: and the share of records from which a word is as rare as any.
BUCKETS, RARE = 1 << 18, 0.018
#: Rivals on the smaller side, and links, up to which a group is assigned exactly in one task; larger groups by auction,
#: whose total is less than the highest one by at most so much for each record.
EXACT, EXACT_LINKS, EPSILON = 200, 20_000, 0.001

# Words that carry no content in a title, and in a by-line.
_TITLE_STOP = frozenset("and with of the a an in to for our my best updated reader readers favourite favorite easy version recipe new s och med på i en ett vår bästa uppdaterad läsarnas favorit enkel recept y con de la el las los al e un una mejor receta nuestra nuestro actualizado actualizada fácil favorita favorito und mit auf vom von unser unsere beste bester einfach aktualisiert leser liebling rezept".split())
_BYLINE_STOP = frozenset("the from by test kitchen of and example www com recipes recipe http https".split())
_LETTERS = re.compile(r"[a-z]+")


def fold(text: str) -> str:
    """Lower case without accents, damage of multi-byte encodings undone."""
    text = text.lower() if text.isascii() else repair(text).lower()
    if text.isascii():
        return text
    text = unicodedata.normalize("NFKD", text.replace("ß", "ss"))
    return "".join(c for c in text if not unicodedata.combining(c))


def title_words(title: str | None) -> list[str]:
    return sorted({w for w in _LETTERS.findall(fold(title)) if w not in _TITLE_STOP}) if title else []


def publisher(text: str | None) -> tuple[str, str]:
    """A by-line as its bare letters, and a short form that abbreviations of the first word share."""
    words = [w for w in _LETTERS.findall(fold(text.replace("'s ", " ").replace("’s ", " "))) if w not in _BYLINE_STOP] if text else []
    joined = "".join(words)
    return joined, (joined[:4] + joined[-4:] if joined else "")


def _h(word: str) -> int:
    return xxhash.xxh32_intdigest(word) >> 1


def _features(side: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}

        def words(line: str) -> tuple:
            if (got := known.get(line)) is None:
                if len(known) > 100_000:
                    known.clear()
                got = known[line] = tuple({_h(w) for w in _LETTERS.findall(fold(line)) if len(w) > 2})
            return got

        for batch in batches:
            out = []
            for key, title, lines, source in zip(*(c.to_pylist() for c in batch.columns)):
                foods = sorted({w for x in lines or () if x for w in words(x)})
                name = title_words(title)
                if name and foods:
                    full, short = publisher(source)
                    joined = "".join(_LETTERS.findall(fold(title)))
                    same = xxhash.xxh64_intdigest(f"{side}:{' '.join(name)}:{joined}:{full}:{foods}") >> 1
                    out.append((same, side, key, " ".join(name), joined, foods, full, short))
            if out:
                kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["uid", "side", "key", "title", "letters", "foods", "publisher", "short"])

    return run


#: ``uid`` is a hash of everything else but the key: equal for exact copies.
_FEATURES = "uid long, side int, key string, title string, letters string, foods array<int>, publisher string, short string"


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count = np.zeros(BUCKETS, dtype=np.int64)
    for b in batches:
        count += np.bincount(b.column(0).flatten().to_numpy(zero_copy_only=False) % BUCKETS, minlength=BUCKETS)
    at = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(count[at])], names=["bucket", "n"])


def word_weights(reps: DataFrame, records: int) -> np.ndarray:
    """The weight of the words of each bucket: the log of how rare they are among all distinct records, at most that of
    ``RARE`` and never nothing. It depends on shares only, not on the size of the tables; ``BUCKETS`` numbers come back."""
    out = np.full(BUCKETS, -np.log(RARE), dtype=np.float32)
    for r in reps.select("foods").mapInArrow(_count_words, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = np.clip(np.log(records / r.n), 0.05, -np.log(RARE))
    return out


@lru_cache(maxsize=1)
def _mixers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return rng.integers(1, 1 << 62, 256, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 62, 256, dtype=np.uint64)


def _minhashes(tokens: np.ndarray, starts: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """``n`` hashes of each record, each of one of its tokens: of two records they are equal as often as their
    (weighted) Jaccard similarity says. Records lie behind one another, each with at least one token."""
    a, b = _mixers()
    distinct, at = np.unique(tokens, return_inverse=True)
    x = distinct.astype(np.uint64) + np.uint64(1)
    out = np.empty((len(starts), n), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = a[k] * x + b[k]
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            # the race of exponential variables: a token wins as often as its weight's share
            wait = h.astype(np.float64) if weights is None else -np.log((h.astype(np.float64) + 1) / 2.0**64) / weights[distinct % BUCKETS]
            order = np.argsort(wait, kind="stable")
            place = np.empty(len(order), dtype=np.int64)
            place[order] = np.arange(len(order))
            out[:, k] = h[order[np.minimum.reduceat(place[at], starts)]]
    return out


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)


def _blocks_of(side: int, uid: int, words: list[str], foods: list[np.ndarray], parts: dict[str, int]) -> list[int]:
    """The blocks that a record is compared in: one for each word of its title (for a word of many records, the cells of
    its part of them and every part of the other side) and, of a short title, some of its foods."""
    out = []
    for w in words:
        n = parts.get(w, 1)
        mine = uid % n
        out += [xxhash.xxh64_intdigest(f"{w} {mine} {k}" if side else f"{w} {k} {mine}") >> 1 for k in range(n)]
    if len(words) <= SHORT:
        out += [xxhash.xxh64_intdigest(x.tobytes()) >> 1 for x in foods]
    return out


def _sketches(shared):
    """``uid, side, food, food2, title, pub, keys, blocks, foods``: sketches of foods and title, every sort key of a
    record, and its blocks."""
    bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
    by_pub, by_title, by_food = KEYS
    part = lambda h: (h >> np.uint64(40)).astype(np.int64) & 0xFFFFF
    sketch = lambda h: (((h >> np.uint64(17)) & np.uint64(1)) * bits).sum(axis=1, dtype=np.uint64).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed: dict[str, list[int]] = {}
        weights, parts = shared.value

        def grams(title: str) -> list[int]:
            out = []
            for w in title.split():
                if w not in hashed:
                    if len(hashed) > 100_000:
                        hashed.clear()
                    hashed[w] = [_h(f" {w} "[i : i + 3]) for i in range(len(w))]
                out += hashed[w]
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            titles = batch.column("title").to_pylist()
            f = _minhashes(*_flat(batch.column("foods")), 128 + max(2 * sum(KEYS), 3 * FOOD_BLOCKS), weights)
            g = _minhashes(*_flat(pa.array([grams(t) for t in titles], pa.list_(pa.int32()))), 64)
            t = _minhashes(*_flat(pa.array([[_h(w) for w in t.split()] for t in titles], pa.list_(pa.int32()))), sum(KEYS))
            pub = np.array([_h(x) if x else 0 for x in batch.column("short").to_pylist()], dtype=np.int64)
            keys = np.empty((batch.num_rows, sum(KEYS)), dtype=np.int64)
            for k in range(sum(KEYS)):
                one, two = part(f[:, 128 + 2 * k]), part(f[:, 129 + 2 * k])
                first, second, third = (pub & 0xFFFFF, part(t[:, k]), one) if k < by_pub else (part(t[:, k]), one, two) if k < by_pub + by_title else (one, two, part(t[:, k]))
                keys[:, k] = (k - sum(KEYS) // 2 << 60) | first << 40 | second << 20 | third
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, sum(KEYS), dtype=np.int32)), pa.array(keys.ravel()))
            foods = np.ascontiguousarray(f[:, 128 : 128 + 3 * FOOD_BLOCKS]).reshape(len(f), FOOD_BLOCKS, 3)
            blocks = pa.array([_blocks_of(s, u, t.split(), x, parts) for s, u, t, x in zip(batch.column("side").to_pylist(), batch.column("uid").to_pylist(), titles, foods)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("side"), pa.array(sketch(f[:, :64])), pa.array(sketch(f[:, 64:128])), pa.array(sketch(g)), pa.array(pub.astype(np.int32)), listed, blocks, batch.column("foods")], names=[*_SORTED, "keys", "blocks", "foods"])

    return run


def _close(t: dict[str, np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which neighbours may match: sketches near, publishers not at odds."""
    apart = lambda *cs: sum(np.bitwise_count((t[c][left] ^ t[c][right]).view(np.uint64)).astype(np.int32) for c in cs)
    pub = (t["pub"][left] == t["pub"][right]) | (t["pub"][left] == 0) | (t["pub"][right] == 0)
    foods, titles = apart("food", "food2"), apart("title")
    return pub & (foods <= FOOD_BITS) & (titles <= TITLE_BITS) & (foods + titles <= BITS) & (t["uid"][left] != t["uid"][right])


def _window_pairs(t: dict[str, np.ndarray], anchors: int = 1, only_across: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Close pairs of a record of the side ``anchors`` and one of its ``WINDOW`` neighbours of the other side, before
    or after it and within ``REACH`` places, as positions (anchor, other)."""
    mine, other = np.flatnonzero(t["side"] == anchors), np.flatnonzero(t["side"] != anchors)
    after = np.searchsorted(other, mine)
    out = []
    for d in range(min(WINDOW, len(other))):
        for at in (after + d, after - 1 - d):
            ok = (at >= 0) & (at < len(other))
            i, j = mine[ok], other[at[ok]]
            near = np.abs(i - j) <= REACH
            if only_across is not None:
                near &= (np.minimum(i, j) < only_across) & (np.maximum(i, j) >= only_across)
            i, j = i[near], j[near]
            hit = _close(t, i, j)
            out.append((i[hit], j[hit]))
    if not out:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


_SORTED = ["uid", "side", "food", "food2", "title", "pub"]
_KINDS = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
_SLIDE = "tag int, a long, b long, uid long, side int, food long, food2 long, title long, pub int, at int"


def _slide(anchors: int):
    """Pairs within the windows of a sorted partition (tag 0), and its first and last rows for its neighbours (2p+1, 2p+2)."""

    def frame(tag: np.ndarray, t: dict[str, np.ndarray] | None, a=None, b=None) -> pa.RecordBatch:
        none = lambda kind: pa.nulls(len(tag), kind)
        cols = [pa.array(tag, pa.int32()), *(pa.array(x, pa.int64()) if x is not None else none(pa.int64()) for x in (a, b))]
        cols += [pa.array(t[c], k) if t else none(k) for c, k in zip(_SORTED, _KINDS)]
        return pa.RecordBatch.from_arrays([*cols, pa.array(np.arange(len(tag)), pa.int32())], names=["tag", "a", "b", *_SORTED, "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = TaskContext.get().partitionId()
        held: dict[str, np.ndarray] | None = None
        head: dict[str, np.ndarray] | None = None
        for batch in batches:
            now = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in _SORTED}
            old = 0 if held is None else len(held["uid"])
            t = now if held is None else {c: np.concatenate([held[c], now[c]]) for c in _SORTED}
            i, j = _window_pairs(t, anchors)
            new = np.maximum(i, j) >= old
            i, j = (i[new], j[new]) if anchors == 0 else (j[new], i[new])
            if len(i):
                yield frame(np.zeros(len(i), dtype=np.int32), None, t["uid"][i], t["uid"][j])
            if head is None or len(head["uid"]) < REACH:
                head = {c: (now[c] if head is None else np.concatenate([head[c], now[c]]))[:REACH] for c in _SORTED}
            held = {c: t[c][-REACH:] for c in _SORTED}
        if held is not None:
            yield frame(np.full(len(head["uid"]), 2 * p + 1, dtype=np.int32), head)
            yield frame(np.full(len(held["uid"]), 2 * p + 2, dtype=np.int32), held)

    return run


def _across(pdf: pd.DataFrame, anchors: int) -> pd.DataFrame:
    """Pairs over the border of two partitions: the last rows of one (even tag) and the first of the next (odd)."""
    pdf = pdf.assign(after=pdf.tag % 2).sort_values(["after", "at"])
    t = {c: pdf[c].to_numpy() for c in _SORTED}
    i, j = _window_pairs(t, anchors, int((pdf.after == 0).sum()))
    i, j = (i, j) if anchors == 0 else (j, i)
    return pd.DataFrame({"a": t["uid"][i], "b": t["uid"][j]})


def _foods_agree(left: np.ndarray, right: np.ndarray, tokens: np.ndarray, starts: np.ndarray, sizes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Which pairs of records may have foods as like as a match needs: the similarity itself, but for words that share a
    place of 4,096 (they can only make it larger). Pairs come in the order of ``right``."""
    out = np.zeros(len(left), dtype=bool)

    def flat(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin = np.concatenate([[0], np.cumsum(sizes[rows])])
        return tokens[np.arange(begin[-1]) - np.repeat(begin[:-1] - starts[rows], sizes[rows])], begin[:-1]

    rights, of = np.unique(right, return_inverse=True)
    for first in range(0, len(rights), 256):
        some = rights[first : first + 256]
        a, z = np.searchsorted(of, [first, first + len(some)])
        theirs, their_begin = flat(some)
        held = np.zeros((len(some), 4096), dtype=bool)
        held[np.repeat(np.arange(len(some)), sizes[some]), theirs % 4096] = True
        other = np.add.reduceat(weights[theirs % BUCKETS], their_begin, dtype=np.float64)[of[a:z] - first]
        for at in range(a, z, AT_ONCE // 8):
            to = min(z, at + AT_ONCE // 8)
            mine, begin = flat(left[at:to])
            w = weights[mine % BUCKETS]
            one = np.add.reduceat(w, begin, dtype=np.float64)
            both = np.add.reduceat(w * held[np.repeat(of[at:to] - first, sizes[left[at:to]]), mine % 4096], begin, dtype=np.float64)
            out[at:to] = both >= (LEAST_FOODS - 1e-4) * (one + other[at - a : to - a] - both)
    return out


def _block_pairs(t: dict[str, np.ndarray], tokens: np.ndarray, starts: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of whole blocks, every pair of a left and a right record that may match, as positions."""
    block, pub = np.unique(t["k"], return_inverse=True)[1].astype(np.int64) << 32, t["pub"].astype(np.int64)
    order = np.lexsort((pub, block))
    lefts, rights = order[t["side"][order] == 0], order[t["side"][order] == 1]
    code, base, own = (block + pub)[lefts], block[rights], pub[rights]
    # a record without a publisher meets the whole block; any other its publisher's records and those without one
    begin = np.searchsorted(code, base + own)
    end = np.where(own > 0, np.searchsorted(code, base + own + 1), np.searchsorted(code, base + (1 << 32)))
    begin0, end0 = np.searchsorted(code, base), np.where(own > 0, np.searchsorted(code, base + 1), 0)
    right, lo, n = np.concatenate([rights, rights]), np.concatenate([begin, begin0]), np.concatenate([end - begin, end0 - begin0])
    some = np.flatnonzero(n > 0)
    some = some[np.argsort(right[some], kind="stable")]
    right, lo, n = right[some], lo[some], n[some]
    food, food2, title = (t[c][lefts].view(np.uint64) for c in ("food", "food2", "title"))
    sizes = np.diff(np.concatenate([starts, [len(tokens)]]))

    def near(at, r) -> np.ndarray:
        foods = np.bitwise_count(food[at] ^ t["food"][r].view(np.uint64)) + np.bitwise_count(food2[at] ^ t["food2"][r].view(np.uint64))
        titles = np.bitwise_count(title[at] ^ t["title"][r].view(np.uint64))
        return np.flatnonzero((foods <= FOOD_BITS) & (titles <= TITLE_BITS) & (foods + titles <= BITS))

    out, held, count = [], [], 0

    def settle() -> None:
        nonlocal held, count
        if held:
            i, j = (np.concatenate(x) for x in zip(*held))
            by = np.argsort(j, kind="stable")
            i, j = i[by], j[by]
            ok = _foods_agree(i, j, tokens, starts, sizes, weights)
            out.append((i[ok], j[ok]))
        held, count = [], 0

    def add(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal count
        if len(i):
            held.append((lefts[i], j))
            count += len(i)
            if count > AT_ONCE // 4:
                settle()

    for k in np.flatnonzero(n >= WIDE):
        for a in range(lo[k], lo[k] + n[k], AT_ONCE):
            hit = near(slice(a, min(a + AT_ONCE, lo[k] + n[k])), right[k : k + 1]) + a
            add(hit, np.full(len(hit), right[k]))
    narrow = n < WIDE
    right, lo, n = right[narrow], lo[narrow], n[narrow]
    total = np.concatenate([[0], np.cumsum(n)])
    a = 0
    while a < len(n):
        z = max(a + 1, int(np.searchsorted(total, total[a] + AT_ONCE, side="right")) - 1)
        i = np.arange(total[z] - total[a]) + np.repeat(lo[a:z] - (total[a:z] - total[a]), n[a:z])
        j = np.repeat(right[a:z], n[a:z])
        hit = near(i, j)
        add(i[hit], j[hit])
        a = z
    settle()
    if not out:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate([i for i, _ in out]), np.concatenate([j for _, j in out])


def _within_blocks(shared):
    """``a, b``: the pairs of every block of a partition that is sorted by block (``k``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, _ = shared.value

        def pairs(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            b = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
            t = {c: b.column(c).to_numpy(zero_copy_only=False) for c in ("k", *_SORTED)}
            i, j = _block_pairs(t, *_flat(b.column("foods")), weights)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(t["uid"][i]), pa.array(t["uid"][j])], names=["a", "b"])

        held: list[pa.RecordBatch] = []  # what may belong to a block that goes on
        for batch in batches:
            if not batch.num_rows:
                continue
            k = batch.column("k").to_numpy()
            if held and k[-1] != held[-1].column("k")[-1].as_py() or not held and k[-1] != k[0]:
                at = int(np.searchsorted(k, k[-1]))
                yield from pairs([*held, batch.slice(0, at)])
                held, batch = [], batch.slice(at)
            held.append(batch)
        if held:
            yield from pairs(held)

    return run


def _alike(a: str, b: str) -> bool:
    """Whether two words agree up to one slip: a letter more, less, changed, or two swapped."""
    if a == b:
        return True
    if min(len(a), len(b)) < 4 or abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    x, y = a[k:], b[k:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:])


def _runs(letters: str) -> set[str]:
    return {letters[i : i + 3] for i in range(max(1, len(letters) - 2))}


def title_similarity(a: str, b: str, letters_a: str = "", letters_b: str = "") -> float:
    """Share of the words that both titles have, slips and lost blanks forgiven: twice the common over all. If it is
    larger, the same of runs of three of the titles' bare letters, which misplaced blanks leave alone."""
    x, y = a.split(), b.split()
    left = [w for w in x if w not in y]
    right = [w for w in y if w not in x]
    same = len(x) - len(left)
    for w in list(left):
        for v in right:
            if _alike(w, v):
                left.remove(w)
                right.remove(v)
                same += 1
                break
    glued = 0
    for w in left:  # two words written as one
        if any(w in (u + v, v + u) for u in y for v in y if u != v):
            glued += 1
    for w in right:
        if any(w in (u + v, v + u) for u in x for v in x if u != v):
            glued += 1
    by_words = min(1.0, (2 * same + 2 * glued) / max(1, len(x) + len(y)))
    if by_words == 1.0 or not letters_a or not letters_b:
        return by_words
    p, q = _runs(letters_a), _runs(letters_b)
    return max(by_words, 2 * len(p & q) / (len(p) + len(q)))


def publishers_agree(full_a: str, full_b: str, short_a: str, short_b: str) -> float:
    """1 where both are stated and agree up to spelling, 0.5 where one is not stated, 0 where they are at odds."""
    if not full_a or not full_b:
        return 0.5
    return 1.0 if short_a == short_b and (full_a == full_b or _abbreviated(full_a, full_b)) else 0.0


def confidence(title: float, foods: float, by: float) -> float:
    """Weighted similarity of the fields, 0 where a field rules the match out. A publisher not stated is neutral."""
    if foods < LEAST_FOODS or by == 0 or title < LEAST_TITLE:
        return 0.0
    total = WEIGHTS["title"] * title + WEIGHTS["foods"] * foods + WEIGHTS["publisher"] * by
    return round(total, 6) if total >= LEAST else 0.0


def _abbreviated(a: str, b: str) -> bool:
    """Whether the shorter by-line is the longer with its first word cut."""
    if len(a) > len(b):
        a, b = b, a
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return k >= 3 and b.endswith(a[k:]) or abs(len(a) - len(b)) <= 1 and a[:3] == b[:3]


def _score(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, _ = shared.value
        for p in batches:
            scores = []
            for ta, tb, la, lb, fa, fb, pa_, pb, sa, sb in zip(p.title_a, p.title_b, p.letters_a, p.letters_b, p.foods_a, p.foods_b, p.publisher_a, p.publisher_b, p.short_a, p.short_b):
                by = publishers_agree(pa_, pb, sa, sb)
                both = np.intersect1d(fa, fb, assume_unique=True)
                shared_, one, other = w[both % BUCKETS].sum(), w[fa % BUCKETS].sum(), w[fb % BUCKETS].sum()
                foods = float(shared_) / max(1e-9, float(one) + float(other) - float(shared_))
                scores.append(confidence(title_similarity(ta, tb, la, lb), foods, by) if by and foods >= LEAST_FOODS else 0.0)
            out = p[["a", "b"]].assign(confidence=scores)
            yield out[out.confidence > 0]

    return run


def _hungarian(profit: np.ndarray) -> list[tuple[int, int]]:
    """The assignment of rows to columns with the highest total profit (rows <= columns), by shortest paths."""
    n, m = profit.shape
    cost = profit.max() - profit
    u, v, match, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            free = ~used[1:]
            cur = cost[i0 - 1] - u[i0] - v[1:]
            better = free & (cur < least[1:])
            least[1:][better] = cur[better]
            way[1:][better] = j0
            j1 = int(np.argmin(np.where(free, least[1:], np.inf))) + 1
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j] and profit[match[j] - 1, j - 1] > 0]


def _assign(pdf: pd.DataFrame) -> pd.DataFrame:
    """One group of rivals, exactly."""
    rows, cols = sorted(set(pdf.ea)), sorted(set(pdf.eb))
    ri, ci = {k: n for n, k in enumerate(rows)}, {k: n for n, k in enumerate(cols)}
    profit = np.zeros((len(rows), len(cols)))
    for x in pdf.itertuples():
        profit[ri[x.ea], ci[x.eb]] = max(profit[ri[x.ea], ci[x.eb]], x.confidence)
    flip = len(rows) > len(cols)
    got = _hungarian(profit.T if flip else profit)
    return pd.DataFrame([(rows[j], cols[i]) if flip else (rows[i], cols[j]) for i, j in got], columns=["ea", "eb"])


def auction(edges: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """``ea, eb``: an assignment of ``edges`` (``ea, eb, confidence``, each pair once) whose total confidence is within
    ``epsilon`` a record of the highest. No group is gathered: in each round every unassigned record bids for its best
    partner at present prices, and each partner goes to the highest bid. Prices only rise, so it ends."""
    spark = edges.sparkSession
    edges = stored(edges)
    held = spark.createDataFrame([], "ea string, eb string, price double")
    while True:
        free = edges.join(held.select("ea"), "ea", "left_anti").join(held.select("eb", "price"), "eb", "left")
        worth = free.select("ea", "eb", F.coalesce("price", F.lit(0.0)).alias("price")).join(edges, ["ea", "eb"]).withColumn("value", F.col("confidence") - F.col("price")).where("value > 0")
        n = F.row_number().over(Window.partitionBy("ea").orderBy(F.desc("value"), "eb"))
        two = worth.withColumn("n", n).where("n <= 2")
        bids = two.groupBy("ea").agg(F.max(F.when(F.col("n") == 1, F.struct("value", "eb", "price"))).alias("best"), F.coalesce(F.max(F.when(F.col("n") == 2, F.col("value"))), F.lit(0.0)).alias("second"))
        offers = bids.select("ea", "best.eb", (F.col("best.price") + F.col("best.value") - F.col("second") + F.lit(epsilon)).alias("price"))
        won = stored(offers.groupBy("eb").agg(F.max_by(F.struct("ea", "price"), F.struct("price", "ea")).alias("w")).select("w.ea", "eb", "w.price"))
        if not won.limit(1).count():
            return held.select("ea", "eb")
        held = stored(held.join(won.select("eb"), "eb", "left_anti").select("ea", "eb", "price").union(won))


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: the smallest node of each node's component. Labels are passed to neighbours, and each node takes
    over its label's label, until nothing moves; so the rounds grow with the logarithm of a chain's length."""
    both = stored(edges.select("x", "y").union(edges.select("y", "x")).distinct())
    labels = stored(both.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("node"), F.least("x", "y").alias("label")))
    while True:
        heard = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("heard"))
        passed = stored(labels.join(heard, "node").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label")))
        further = passed.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = stored(passed.join(further, "label").select("node", "old", F.least("label", "further").alias("label")))
        if not new.where("label <> old").limit(1).count():
            return new.select("node", "label")
        labels = new.select("node", "label")


def assignment(edges: DataFrame) -> DataFrame:
    """``ea, eb``: of rival ``edges`` (``ea, eb, confidence``) the one-to-one choice with the highest total confidence,
    group by group; a group too large for one task goes to the auction."""
    label = components(edges.select(F.concat(F.lit("l"), "ea").alias("x"), F.concat(F.lit("r"), "eb").alias("y")))
    own = label.where("node like 'l%'").select(F.expr("substring(node, 2)").alias("ea"), "label")
    size = label.groupBy("label").agg(F.least(F.count_if(F.col("node").like("l%")), F.count_if(F.col("node").like("r%"))).alias("n"))
    grouped = stored(edges.join(own, "ea").join(size, "label"))
    links = grouped.groupBy("label", "n").agg(F.count("*").alias("links")).withColumn("small", (F.col("n") <= EXACT) & (F.col("links") <= EXACT_LINKS)).select("label", "small")
    grouped = stored(grouped.join(links, "label"))
    exact = grouped.where("small").groupBy("label").applyInPandas(_assign, "ea string, eb string")
    large = grouped.where("not small").select("ea", "eb", "confidence")
    return exact.union(auction(large)) if large.limit(1).count() else exact


def match(left: DataFrame, right: DataFrame) -> DataFrame:
    """``left, right, confidence``: the records of two tables that describe one thing.

    Both frames have ``key, title, lines, publisher, entity``: lines are an array of strings, ``entity`` is equal for
    records known to be one (a null stands for the key). Titles and most ingredients have to agree up to wording, the
    publishers where both are stated. Records without a title or any line take no part. Words of the lines count by
    their rarity among all records. Of several candidates one entity of each table is matched to one of the other, with
    the highest total confidence; all its records are returned, and so are records of the right table that are copies
    of the matched one, which they have to be as like as a match is. Keys are strings; repeated keys count once.

    Exact copies are collapsed before sorting, so no group of copies can fill the windows. Records whose titles share a
    word are all compared: no window or sample bounds that, and a word of many records is compared in parts. The sort by
    hashed keys with a record's own hash as tie-breaker splits hot keys over partitions; windows go over partition borders.
    """
    spark = left.sparkSession
    cols = [F.col("key").cast("string"), F.col("title"), F.col("lines"), F.col("publisher")]
    feats = spread(left.select(*cols)).mapInArrow(_features(0), _FEATURES).unionByName(spread(right.select(*cols)).mapInArrow(_features(1), _FEATURES))
    feats = stored(feats)
    fields = ["title", "letters", "foods", "publisher", "short"]
    reps = stored(feats.groupBy("uid").agg(F.any_value("side").alias("side"), F.any_value(F.struct(*fields)).alias("r")).select("uid", "side", "r.*"))
    count = {r.side: r.n for r in reps.groupBy("side").agg(F.count("*").alias("n")).collect()}
    records, anchors = sum(count.values()), int(count.get(1, 0) <= count.get(0, 0))
    often = reps.select(F.explode(F.split("title", " ")).alias("w")).groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") > PART)
    shared = spark.sparkContext.broadcast((word_weights(reps, max(1, records)), {r.w: -(-r.n // PART) for r in often.collect()}))
    # sketches and keys are made once and stored: range partitioning reads its input twice
    sketches = ", ".join(f"{c} {'int' if c in ('side', 'pub') else 'long'}" for c in _SORTED)
    slim = stored(reps.select("uid", "side", "title", "foods", "short").mapInArrow(_sketches(shared), f"{sketches}, keys array<long>, blocks array<long>, foods array<int>"))
    rows = slim.select(F.explode("keys").alias("k"), *_SORTED)
    n = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), records // 1_000))
    ordered = rows.repartitionByRange(n, "k", "uid").sortWithinPartitions("k", "uid")
    slid = stored(ordered.select(*_SORTED).mapInArrow(_slide(anchors), _SLIDE))
    border = slid.where("tag > 0").withColumn("border", F.floor(F.col("tag") / 2)).groupBy("border").applyInPandas(partial(_across, anchors=anchors), "a long, b long")
    blocks = slim.select(F.explode("blocks").alias("k"), *_SORTED, "foods").repartition(n, "k").sortWithinPartitions("k")
    within = blocks.mapInArrow(_within_blocks(shared), "a long, b long")
    pairs = slid.where("tag = 0").select("a", "b").union(border).union(within).distinct()
    scored = stored(_scored(pairs, reps, fields, shared))
    # back from classes of copies to entities
    ent = lambda f: f.select(F.col("key").cast("string").alias("key"), F.coalesce(F.col("entity").cast("string"), F.col("key").cast("string")).alias("entity")).groupBy("key").agg(F.min("entity").alias("entity"))
    whole = lambda s, f: feats.where(F.col("side") == s).select("key", "uid").distinct().join(ent(f), "key")
    lefts = whole(0, left).select(F.col("key").alias("left"), F.col("uid").alias("a"), F.col("entity").alias("ea"))
    rights = whole(1, right).select(F.col("key").alias("right"), F.col("uid").alias("b"), F.col("entity").alias("eb"))
    full = stored(scored.join(lefts, "a").join(rights, "b"))
    edges = full.groupBy("ea", "eb").agg(F.max("confidence").alias("confidence"))
    da, db = (edges.groupBy(c).agg(F.count("*").alias(f"n_{c}")) for c in ("ea", "eb"))
    edges = stored(edges.join(da, "ea").join(db, "eb"))
    rival = edges.where("n_ea > 1 or n_eb > 1").select("ea", "eb", "confidence")
    chosen = stored(edges.where("n_ea = 1 and n_eb = 1").select("ea", "eb").union(assignment(rival)))
    # rivals left over for a matched record of the left table: copies of its match, if they are like it
    over = rival.join(chosen.select("eb"), "eb", "left_anti").join(chosen.withColumnRenamed("eb", "first"), "ea")
    named = full.select("eb", "b").distinct()
    beside = stored(over.join(named, "eb").join(named.select(F.col("eb").alias("first"), F.col("b").alias("a")), "first").select("ea", "eb", "confidence", "a", "b"))
    like = _scored(beside.select("a", "b").distinct(), reps, fields, shared).select("a", "b")
    copies = beside.join(like, ["a", "b"]).groupBy("eb").agg(F.max_by("ea", F.struct("confidence", "ea")).alias("ea")).select("ea", "eb")
    return full.join(chosen.union(copies), ["ea", "eb"]).groupBy("left", "right").agg(F.max("confidence").alias("confidence"))


def _scored(pairs: DataFrame, reps: DataFrame, fields: list[str], shared) -> DataFrame:
    """``a, b, confidence`` of the pairs that may match."""
    side = lambda s: reps.select(F.col("uid").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in fields))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(_score(shared), "a long, b long, confidence double")


def stated(source: Column, url: Column) -> Column:
    """The publisher, or the url's host where no publisher is stated."""
    return F.coalesce(source, F.try_parse_url(url, F.lit("HOST")))
