"""Held-out evaluation texts that appear in a training corpus.

The items form a BM25 inverted index with block-max postings; its terms are runs of TERM_WORDS words,
which texts of the same field seldom share by chance. Every passage of every document is a
query, answered by block-max WAND: all items whose score reaches the item's own threshold come back.
The threshold is the smallest score that any run of MIN_RUN consecutive words of the item gives, so
no passage that holds such a run is missed. What comes back is verified word by word.

Item sets beyond one broadcast index are cut into blocks, but the corpus is read once: of every run
of MIN_RUN words the term of the least hash is an anchor, a run that two texts share has the same
anchor in both, and only passages that hold an anchor of some item (a bitmap of fixed size) are kept
for the blocks.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.session import stage

MIN_RUN = 12
#: Words of an index term.
TERM_WORDS = 3
#: Words of a passage; neighbouring passages share MIN_RUN - 1 words, so that no run is cut.
PASSAGE_WORDS = 48
BLOCK = 8
#: Items and characters of their texts that one broadcast index may hold (about 150 MB in a worker); more are searched in several blocks.
MAX_INDEX_ITEMS = 20_000
MAX_INDEX_CHARS = 2_000_000
#: Bits of the bitmap of anchors (16 MB).
ANCHOR_BITS = 1 << 27
K1, B = 0.9, 0.4
_WORD = re.compile(r"[^\W_]+")
_END = 1 << 62
_MARK = "\x1f"


def words_of(text: str | None) -> list[str]:
    text = text or ""
    if "\u0130" in text or "\u03a3" in text:  # letters whose lower case depends on where a word ends
        return [w.lower() for w in _WORD.findall(text)]
    return _WORD.findall(text.lower())


def terms_of(words: list[str] | tuple[str, ...]) -> list[tuple[str, ...]]:
    return list(zip(*(words[k:] for k in range(TERM_WORDS)), strict=False))


@dataclass
class Posting:
    """Items of a term with their impacts, in blocks with their largest impact."""

    items: list[int]
    impacts: list[float]
    block_max: list[float]
    most: float


class ItemIndex:
    """Inverted index of items; impacts are divided by the item's threshold, so that 1 is every item's threshold."""

    def __init__(self, items: list[tuple[int, str | None]]):
        texts = [(i, words_of(t)) for i, t in items]
        texts = [(i, w) for i, w in texts if len(w) >= MIN_RUN]  # a shorter item holds no run
        self.ids = [i for i, _ in texts]
        self.texts = [f" {' '.join(w)} " for _, w in texts]
        n = len(texts)
        df = Counter(t for _, w in texts for t in set(terms_of(w)))
        mean = sum(len(w) for _, w in texts) / n if n else 1
        lists: dict[tuple[str, ...], list[tuple[int, float]]] = {}
        for at, (_, w) in enumerate(texts):
            impact = {}
            for term, tf in Counter(terms_of(w)).items():
                idf = math.log(1 + (n - df[term] + 0.5) / (df[term] + 0.5))
                impact[term] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean))
            least = min(sum(impact[t] for t in set(terms_of(w[k : k + MIN_RUN]))) for k in range(len(w) - MIN_RUN + 1))
            for term, x in impact.items():
                lists.setdefault(term, []).append((at, x / least))
        self.terms = {
            t: Posting([i for i, _ in p], [x for _, x in p], [max(x for _, x in p[k : k + BLOCK]) for k in range(0, len(p), BLOCK)], max(x for _, x in p)) for t, p in lists.items()
        }

    def search(self, terms: set[tuple[str, ...]], threshold: float = 1 - 1e-9) -> list[int]:
        """Positions of all items that score at least the threshold for these terms: block-max WAND."""
        cursors = [[0, p] for t in terms if (p := self.terms.get(t))]
        if sum(p.most for _, p in cursors) < threshold:
            return []
        found = []
        while True:
            cursors.sort(key=lambda c: c[1].items[c[0]] if c[0] < len(c[1].items) else _END)
            while cursors and cursors[-1][0] >= len(cursors[-1][1].items):
                cursors.pop()
            bound, pivot = 0.0, -1
            for k, (_, p) in enumerate(cursors):
                bound += p.most
                if bound >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = cursors[pivot][1].items[cursors[pivot][0]]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][1].items[cursors[pivot + 1][0]] == item:
                pivot += 1
            # the blocks that would hold the pivot item bound its score more tightly
            tight, step = 0.0, _END
            for c in cursors[: pivot + 1]:
                at = c[0]
                items = c[1].items
                block = at // BLOCK
                while block < len(c[1].block_max) and items[min(len(items), (block + 1) * BLOCK) - 1] < item:
                    block += 1
                if block < len(c[1].block_max):
                    tight += c[1].block_max[block]
                    step = min(step, items[min(len(items), (block + 1) * BLOCK) - 1] + 1)
            if pivot + 1 < len(cursors):
                step = min(step, cursors[pivot + 1][1].items[cursors[pivot + 1][0]])
            if tight >= threshold:
                score = 0.0
                for c in cursors[: pivot + 1]:
                    _skip(c, item)
                    if c[0] < len(c[1].items) and c[1].items[c[0]] == item:
                        score += c[1].impacts[c[0]]
                        c[0] += 1
                if score >= threshold:
                    found.append(item)
            else:  # no item before step can reach the threshold
                for c in cursors[: pivot + 1]:
                    _skip(c, max(step, item + 1))

    def leaks(self, words: list[str]) -> list[int]:
        """Identifiers of the items of which a run of MIN_RUN words stands among the words of a text."""
        grams = terms_of(words)
        known = self.terms
        hits = {g for g in grams if g in known}
        if sum(known[g].most for g in hits) < 1 - 1e-9:  # no passage can reach a threshold
            return []
        out: set[int] = set()
        for begin in range(0, max(1, len(words) - MIN_RUN + 1), PASSAGE_WORDS - MIN_RUN + 1):
            passage = words[begin : begin + PASSAGE_WORDS]
            if len(passage) < MIN_RUN:
                break
            terms = hits.intersection(grams[begin : begin + PASSAGE_WORDS - TERM_WORDS + 1])
            for at in self.search(terms):
                if self.ids[at] not in out and any(f" {' '.join(passage[k : k + MIN_RUN])} " in self.texts[at] for k in range(len(passage) - MIN_RUN + 1)):
                    out.add(self.ids[at])
        return sorted(out)


def _skip(cursor: list, item: int) -> None:
    at, items = cursor[0], cursor[1].items
    while at < len(items) and items[at] < item:
        at += 1
    cursor[0] = at


def anchors(words: list[str]) -> list[tuple[int, int]]:
    """(place of the term, bit) of the anchors: the term of the least hash in each run of MIN_RUN words, the first of equal ones."""
    hashes = [int.from_bytes(blake2b(" ".join(t).encode(), digest_size=8).digest(), "big") for t in terms_of(words)]
    size, out, last = MIN_RUN - TERM_WORDS + 1, [], -1
    for k in range(len(hashes) - size + 1):
        if last < k:
            last = min(range(k, k + size), key=lambda i: (hashes[i], i))
            out.append((last, hashes[last] % ANCHOR_BITS))
        elif hashes[k + size - 1] < hashes[last]:
            last = k + size - 1
            out.append((last, hashes[last] % ANCHOR_BITS))
    return out


def _anchor_bitmap(keyed: DataFrame) -> bytes:
    """One bit for every anchor of the items, put together on the executors; ANCHOR_BITS / 8 bytes whatever the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = {bit for t in batch.column(1).to_pylist() for _, bit in anchors(words_of(t))}
            yield pa.RecordBatch.from_arrays([pa.array([b + 1 for b in sorted(bits)], pa.int64())], names=["bit"])  # buckets start at 1

    bits = keyed.mapInArrow(run, "bit bigint")
    parts = bits.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = bytearray(-(-ANCHOR_BITS // 32768) * 4096)
    for r in parts.collect():  # at most ANCHOR_BITS / 32768 rows of 4 KB
        at = (r["bucket"] - 1) * 4096
        out[at : at + len(r["bits"])] = r["bits"]
    return bytes(out)


def _suspects(texts: DataFrame, bitmap: bytes) -> DataFrame:
    """(doc_id, text): the stretches of words around anchors that some item has, with MIN_RUN words on either side."""
    shared = texts.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            ids, parts = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                begin = end = -1
                for at, bit in anchors(words):
                    if not known[bit // 8] >> bit % 8 & 1:
                        continue
                    low, high = max(0, at - MIN_RUN), at + TERM_WORDS + MIN_RUN
                    if low > end:
                        if end > 0:
                            ids.append(doc_id)
                            parts.append(_MARK.join(words[begin:end]))
                        begin = low
                    end = high
                if end > 0:
                    ids.append(doc_id)
                    parts.append(_MARK.join(words[begin:end]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.string())], names=["doc_id", "text"])

    return texts.mapInArrow(run, "doc_id bigint, text string")


def find_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of every document whose words hold a run of MIN_RUN consecutive words of an item.

    Null and empty texts and items of fewer words hold none; items of the same text all come out.
    Map-only; an index holds at most MAX_INDEX_ITEMS items and about MAX_INDEX_CHARS characters. With more
    items, the corpus is read once for the passages that may hold any, and those meet the indexes.
    """
    spark = documents.sparkSession
    keyed = items.select(F.col("item_id").cast("bigint").alias("item_id"), "item_text")
    size = keyed.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("item_text")), F.lit(0)).alias("c")).first()
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    parts = max(1, math.ceil(size["n"] / MAX_INDEX_ITEMS), math.ceil(size["c"] / MAX_INDEX_CHARS))
    if parts == 1:
        return _search(texts, keyed)
    suspects = stage(_suspects(texts, _anchor_bitmap(keyed)), "leakage-suspects")
    found = None
    for part in range(parts):
        mine = _search(suspects, keyed.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part), lambda t: t.split(_MARK))
        found = mine if found is None else found.unionByName(mine)
    return found.distinct()  # a document may hold an item in several passages


def _search(texts: DataFrame, items: DataFrame, cut=words_of) -> DataFrame:
    """Every text against the index of some items, of a size that find_leaks has bounded."""
    shared = texts.sparkSession.sparkContext.broadcast(ItemIndex([tuple(r) for r in items.collect()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            pairs = [(d, i) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i in index.leaks(cut(t))]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["doc_id", "item_id"])

    return texts.mapInArrow(run, "doc_id bigint, item_id bigint")
