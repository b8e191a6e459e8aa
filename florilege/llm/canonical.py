"""Freely typed names mapped to the entries of a canonical list.

A symmetric-delete dictionary of the list is broadcast: each name's number words together with its
letters, sorted and with up to two of them left out, lead to the name. A typed value leaves out
letters likewise, so every name within two slips, with the words in any order, is among its hits.
Hits are ranked by weighted Damerau-Levenshtein distance, the least over all orders of the words of
both sides, then by how often the entry occurs as typed exactly, then by the smaller identifier. Values
that mean no entry are reported.

A slip costs 7 to 10 tenths, so that fewer slips always cost less than more, and at most two slips is
the same as a cost of at most 20: costs need to be worked out only where entries tie in slips.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import blake2b
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from florilege.functions.text import GREEK
from florilege.operators.skew import hot_threshold, salt
from florilege.session import stage

SLIPS = 2
#: Names (of all entries, other names included) and delete keys of a list that may be broadcast as one dictionary: about 100 MB in a worker.
#: Beyond either the lists meet by a shuffle join, with the same rows.
MAX_BROADCAST_NAMES = 5_000
MAX_BROADCAST_KEYS = 500_000
#: Salted parts of a delete key that many values share.
SALTS = 64
_WORD = re.compile(r"[^\W_]+")
_GREEK = str.maketrans(GREEK)


def name_parts(value: str | None) -> tuple[str, tuple[str, ...]]:
    """(number words sorted and joined, other words); Greek letters spelled out."""
    words = _WORD.findall((value or "").lower().translate(_GREEK))
    return " ".join(sorted(w for w in words if w.isdecimal())), tuple(w for w in words if not w.isdecimal())


_MASK = (1 << 63) - 1


@lru_cache(maxsize=100_000)
def _weight(text: str) -> int:
    return int.from_bytes(blake2b(text.encode(), digest_size=8).digest(), "big") & _MASK


def delete_keys(numbers: str, words: tuple[str, ...]) -> set[int]:
    """Symmetric-delete keys: the letters, in no order, with up to SLIPS of them left out, and the numbers.

    A key is the sum of its letters' 63-bit weights and the numbers' weight, so that leaving out a
    letter is one subtraction; keys that meet by chance only cost a verification.
    """
    letters = "".join(words)
    base = _weight("#" + numbers) + sum(map(_weight, letters))
    several = {c for c in set(letters) if letters.count(c) > 1}
    drops = [(c, _weight(c)) for c in sorted(set(letters))]
    keys = {base & _MASK}
    for i, (c, w) in enumerate(drops):
        one = base - w
        keys.add(one & _MASK)
        if c in several:
            keys.add((one - w) & _MASK)
        for _, v in drops[i + 1 :]:
            keys.add((one - v) & _MASK)
    return keys


def bounded_distance(a: str, b: str, limit: int) -> int | None:
    """Unrestricted Damerau-Levenshtein distance if it is at most ``limit`` (up to SLIPS), else None."""
    if abs(len(a) - len(b)) > limit:
        return None
    begin, most = 0, min(len(a), len(b))
    while begin < most and a[begin] == b[begin]:
        begin += 1
    if begin == len(a) == len(b):
        return 0
    end = 0
    while end < most - begin and a[-1 - end] == b[-1 - end]:
        end += 1
    begin, end = max(0, begin - 1), max(0, end - 1)  # a swap may reach one letter into what is the same
    a, b = a[begin : len(a) - end], b[begin : len(b) - end]
    rows = [list(range(len(b) + 1))]
    for i, c in enumerate(a):
        rows = _rows_after(rows, a[:i], c, b)
        if min(rows[-1]) > limit:
            return None
    return rows[-1][-1] if rows[-1][-1] <= limit else None


def _rows_after(rows: list[list[int]], done: str, word: str, target: str) -> list[list[int]]:
    """Rows of the unrestricted Damerau-Levenshtein table for done + word, exact up to SLIPS."""
    rows = list(rows)
    a = done + word
    for i in range(len(done) + 1, len(a) + 1):
        prev, row = rows[i - 1], [i]
        c = a[i - 1]
        for j in range(1, len(target) + 1):
            b = target[j - 1]
            best = prev[j - 1] + (c != b)
            if prev[j] + 1 < best:
                best = prev[j] + 1
            if row[j - 1] + 1 < best:
                best = row[j - 1] + 1
            if c != b and i > 1 and j > 1:
                if a[i - 2] == b and c == target[j - 2]:
                    best = min(best, rows[i - 2][j - 2] + 1)
                if i > 2 and a[i - 3] == b and c == target[j - 2]:  # swapped around a letter too many
                    best = min(best, rows[i - 3][j - 2] + 2)
                if j > 2 and a[i - 2] == b and c == target[j - 3]:  # swapped around a missing letter
                    best = min(best, rows[i - 2][j - 3] + 2)
            row.append(best)
        rows.append(row)
    return rows


#: With more words than this on a side, orders are searched together letter by letter instead of one by one.
_FEW_WORDS = 4


@lru_cache(maxsize=50_000)
def orders_of(words: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(sorted({"".join(p) for p in permutations(words)}))


def slips_between(words: tuple[str, ...], target: tuple[str, ...], limit: int = SLIPS) -> int | None:
    """Fewest slips between some order of the words, joined, and some order of the target's; None beyond the limit."""
    if abs(sum(map(len, words)) - sum(map(len, target))) > limit:
        return None
    if max(len(words), len(target)) > _FEW_WORDS:
        cost = slip_cost(words, target, limit)
        return None if cost is None else -(-cost // 10)
    mine, theirs = orders_of(words), orders_of(target)
    if not set(mine).isdisjoint(theirs):
        return 0
    best = None
    for order in mine:
        for other in theirs:
            d = bounded_distance(order, other, limit)
            if d is not None:
                if d == 1:
                    return 1
                best, limit = d, d - 1
    return best


_VOWELS = set("aeiouy")
SWAP, DOUBLED, VOWEL, OTHER = 7, 7, 8, 10


def _draw(word: str, before: str, rest: tuple[str, ...], n: int) -> Iterator[tuple[str, str, str, tuple[str, ...]]]:
    """All ways to take n letters: (letters, what is left of the word, the letter before it in the word, words left)."""
    if n == 0:
        yield "", word, before, rest
    elif word:
        for letters, *state in _draw(word[1:], word[0], rest, n - 1):
            yield word[0] + letters, *state
    else:
        for k, w in enumerate(rest):
            if k == 0 or w != rest[k - 1]:
                yield from _draw(w, "", rest[:k] + rest[k + 1 :], n)


def slip_cost(words: tuple[str, ...], target: tuple[str, ...], limit: int = SLIPS) -> int | None:
    """The least cost in tenths of turning some order of the words into some order of the target's, None beyond ``limit`` slips.

    Swapped neighbours and a doubled letter of a word cost 7, a vowel for a vowel 8, other slips 10; a
    swap around a letter too many or missing is two slips. Both texts are built letter by letter, cheapest
    first; where both stand between words, what follows does not depend on what went before, so the
    parts may come in any order and the one that holds the first word left comes next.
    """
    most = 10 * limit
    start = ("", "", tuple(sorted(words)), "", "", tuple(sorted(target)), None)
    if start[2] == start[5]:
        return 0
    heap: list[tuple[int, int, tuple]] = [(0, 0, start)]
    done: set[tuple] = set()
    serial = 0
    while heap:
        cost, _, state = heapq.heappop(heap)
        if state in done:
            continue
        done.add(state)
        a, a0, left, b, b0, other, first = state
        if not (a or left or b or other):
            return cost
        steps: list[tuple[int, tuple, tuple]] = []
        ones_a, ones_b = list(_draw(a, a0, left, 1)), list(_draw(b, b0, other, 1))
        for x, *to_a in ones_a:
            for y, *to_b in ones_b:
                steps.append((0 if x == y else VOWEL if x in _VOWELS and y in _VOWELS else OTHER, to_a, to_b))
            steps.append((DOUBLED if a and a0 == x else OTHER, to_a, [b, b0, other]))
        for y, *to_b in ones_b:
            steps.append((DOUBLED if b and b0 == y else OTHER, [a, a0, left], to_b))
        if cost + SWAP <= most:
            twos_a, twos_b = list(_draw(a, a0, left, 2)), list(_draw(b, b0, other, 2))
            steps += [(SWAP, to_a, to_b) for x, *to_a in twos_a for y, *to_b in twos_b if x[0] == y[1] != x[1] == y[0]]
            if cost + SWAP + OTHER <= most:
                steps += [(SWAP + OTHER, to_a, to_b) for x, *to_a in _draw(a, a0, left, 3) for y, *to_b in twos_b if x[0] == y[1] and x[2] == y[0]]
                steps += [(SWAP + OTHER, to_a, to_b) for x, *to_a in twos_a for y, *to_b in _draw(b, b0, other, 3) if y[0] == x[1] and y[2] == x[0]]
        for more, (a1, p, left1), (b1, q, other1) in steps:
            total = cost + more
            gap = abs(len(a1) + sum(map(len, left1)) - len(b1) - sum(map(len, other1)))
            if total + gap * DOUBLED > most:
                continue
            mark = first if first is not None else (left[0], left.count(left[0])) if left else None
            if not a1 and not b1:  # between words on both sides
                if mark is not None and left1.count(mark[0]) == mark[1]:
                    continue
                p = q = ""
                mark = (left1[0], left1.count(left1[0])) if left1 else None
            serial += 1
            heapq.heappush(heap, (total, serial, (a1, p, left1, b1, q, other1, mark)))
    return None


@dataclass
class NameIndex:
    """The dictionary: exact list names, names by their words, and delete key -> positions of (entry, words)."""

    exact: set[str] = field(default_factory=set)
    names: list[tuple[int, tuple[str, ...]]] = field(default_factory=list)
    keys: dict[int, list[int]] = field(default_factory=dict)
    frequency: dict[int, int] = field(default_factory=dict)

    def add(self, entry: int, name: str) -> None:
        numbers, words = name_parts(name)
        if not words:
            return
        at = len(self.names)
        self.names.append((entry, tuple(sorted(words))))
        for key in delete_keys(numbers, words):
            self.keys.setdefault(key, []).append(at)

    def meaning(self, value: str | None) -> int | None:
        """The entry that a value means, None for none; values that are exactly a list name mean none here."""
        if value is None or value in self.exact:
            return None
        numbers, words = name_parts(value)
        return self.meaning_of(numbers, tuple(sorted(words)))

    def meaning_of(self, numbers: str, words: tuple[str, ...]) -> int | None:
        """The entry nearest to these words; the result does not depend on their order."""
        if not words:
            return None
        hits: set[int] = set()
        get = self.keys.get
        for key in delete_keys(numbers, words):
            at = get(key)
            if at:
                hits.update(at)
        return self.nearest(words, hits) if hits else None

    def nearest(self, words: tuple[str, ...], hits: set[int]) -> int | None:
        least, close = SLIPS, []
        for entry, target in {self.names[at] for at in hits}:
            d = slips_between(words, target, least)
            if d is not None:
                if d < least:
                    least, close = d, []
                close.append((entry, target))
        if len({e for e, _ in close}) <= 1:
            return close[0][0] if close else None
        return min((slip_cost(words, target, least), -self.frequency.get(entry, 0), entry) for entry, target in close)[2]


class Lookup:
    """One worker's memory of what it has looked up, by the value and by its words."""

    def __init__(self, index: NameIndex, size: int = 200_000):
        of_words = lru_cache(maxsize=size)(index.meaning_of)

        def by_value(value: str | None) -> int | None:
            if value is None or value in index.exact:
                return None
            numbers, words = name_parts(value)
            return of_words(numbers, tuple(sorted(words)))

        self.meaning = lru_cache(maxsize=size)(by_value)


def fits_broadcast(library: DataFrame) -> bool:
    """Whether the names and the delete keys of a list stay below the bounds; counted before anything is brought to the driver."""
    names = library.select(F.explode(F.split(F.concat_ws(";", "compound", "also_called"), ";")).alias("n"))
    letters = F.size(F.array_distinct(F.split(F.regexp_replace(F.lower("n"), r"[^\p{L}]+", ""), "")))  # distinct letters, rounded up
    row = names.agg(F.count(F.lit(1)).alias("n"), F.sum((letters + 1) * (letters + 2) / 2).alias("k"), F.sum(F.length("n")).alias("c")).first()
    return row["n"] <= MAX_BROADCAST_NAMES and (row["k"] or 0) <= MAX_BROADCAST_KEYS and (row["c"] or 0) <= MAX_BROADCAST_KEYS * 4


def list_names(library: DataFrame) -> list[tuple[int, str, str | None]]:
    """The canonical list, of a size that fits_broadcast has checked."""
    return [tuple(r) for r in library.select(F.col("library_id").cast("bigint"), "compound", "also_called").collect()]


def build_index(entries: list[tuple[int, str, str | None]], frequency: dict[int, int] | None = None) -> NameIndex:
    index = NameIndex(frequency=frequency or {})
    for entry, compound, others in entries:
        if compound is not None:
            index.exact.add(compound)
        for name in [compound or "", *(others or "").split(";")]:
            index.add(entry, name)
    return index


def exact_frequency(named: DataFrame, entries: list[tuple[int, str, str | None]]) -> dict[int, int]:
    """How many rows carry each list name exactly: counts over all rows, one row per list name comes back."""
    by_name = {c: e for e, c, _ in sorted(entries, key=lambda x: -x[0]) if c is not None}  # of the same name the smallest
    if not by_name:
        return {}
    counts = named.filter(F.col("name").isin(*by_name)).groupBy("name").count().collect()
    return {by_name[r["name"]]: r["count"] for r in counts}


def match_rows(named: DataFrame, library: DataFrame) -> DataFrame:
    """Rows (src_table, row_id, name) whose name is not a list name but means one: src_table, row_id, library_id.

    Map-only: the dictionary is broadcast (bounded by MAX_BROADCAST_NAMES and MAX_BROADCAST_KEYS), each
    worker keeps what it has looked up. Null names mean none; repeated rows each come out; an empty
    list matches nothing. Beyond the bounds, match_by_join gives the same rows.
    """
    if not fits_broadcast(library):
        return match_by_join(named, library)
    entries = list_names(library)
    index = build_index(entries, exact_frequency(named, entries))
    shared = named.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meaning = Lookup(shared.value).meaning
        for batch in batches:
            coded = batch.column(2).dictionary_encode()
            ids = pa.array([meaning(x) for x in coded.dictionary.to_pylist()], pa.int64())
            mine = ids.take(coded.indices)
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), mine], names=["src_table", "row_id", "library_id"])
            yield out.filter(mine.is_valid())

    return named.select("src_table", "row_id", "name").mapInArrow(run, "src_table string, row_id bigint, library_id bigint")


def match_by_join(named: DataFrame, library: DataFrame) -> DataFrame:
    """The same for lists of any size: delete keys of distinct values and of list names meet in a shuffle join.

    Values of the same words are looked up once. A key that many values share is salted.
    """
    named = named.select("src_table", "row_id", "name")
    names = library.select(
        F.col("library_id").cast("bigint").alias("library_id"), F.explode(F.split(F.concat_ws(";", "compound", "also_called"), ";")).alias("list_name")
    )
    exact = library.filter("compound is not null").groupBy(F.col("compound").alias("name")).agg(F.min(F.col("library_id").cast("bigint")).alias("entry"))
    counted = named.filter("name is not null").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    frequency = counted.join(exact, "name").groupBy(F.col("entry").alias("library_id")).agg(F.sum("n").alias("frequency"))
    values = stage(_with_words(counted.join(exact, "name", "left_anti").select("name"), "name"), "names-words")
    theirs = _with_words(names.join(frequency, "library_id", "left").na.fill(0, ["frequency"]), "list_name").select("library_id", "frequency", "numbers", F.col("words").alias("target")).distinct()
    mine = stage(_with_keys(values.select("numbers", "words").distinct(), "words"), "names-keys")
    hot = F.broadcast(mine.groupBy("key").count().filter(F.col("count") >= hot_threshold(mine.count())).select("key", F.lit(True).alias("is_hot")))
    salted = mine.join(hot, "key", "left").withColumn("salt", F.when(F.col("is_hot"), salt(F.col("words"), SALTS)).otherwise(0)).drop("is_hot")
    spread = _with_keys(theirs, "target").join(hot, "key", "left")
    spread = spread.withColumn("salt", F.explode(F.when(F.col("is_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("is_hot")
    pairs = salted.join(spread, ["key", "numbers", "salt"]).select("numbers", "words", "library_id", "target", "frequency").distinct()

    near = _scored(pairs, "slips", lambda w, t: slips_between(w, t))
    least = F.rank().over(Window.partitionBy("numbers", "words").orderBy("slips"))
    near = near.filter("slips is not null").withColumn("place", least).filter("place = 1").drop("place")
    several = F.min("library_id").over(Window.partitionBy("numbers", "words")) != F.max("library_id").over(Window.partitionBy("numbers", "words"))
    near = stage(near.withColumn("several", several), "names-near")
    costed = _scored(near.filter("several"), "cost", lambda w, t: slip_cost(w, t)).unionByName(near.filter("not several").withColumn("cost", F.lit(0)))
    best = F.row_number().over(Window.partitionBy("numbers", "words").orderBy("cost", F.desc("frequency"), "library_id"))
    meant = costed.withColumn("place", best).filter("place = 1").select("numbers", "words", "library_id")
    return named.join(values.join(meant, ["numbers", "words"]).select("name", "library_id"), "name").select("src_table", "row_id", "library_id")


def _scored(pairs: DataFrame, name: str, score) -> DataFrame:
    """Pairs of words with a whole-number score of words and target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            both = zip(batch.column(at("words")).to_pylist(), batch.column(at("target")).to_pylist(), strict=True)
            yield batch.append_column(name, pa.array([score(tuple(w.split(" ")), tuple(t.split(" "))) for w, t in both], pa.int32()))

    return pairs.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in pairs.dtypes) + f", {name} int")


def _with_words(df: DataFrame, name: str) -> DataFrame:
    """Add ``numbers`` and ``words`` (sorted, joined) of a name; names without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [name_parts(v) for v in batch.column(batch.schema.get_field_index(name)).to_pylist()]
            yield batch.append_column("numbers", pa.array([n for n, _ in parts], pa.string())).append_column("words", pa.array([" ".join(sorted(w)) for _, w in parts], pa.string()))

    return df.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", numbers string, words string").filter("words <> ''")


def _with_keys(df: DataFrame, words: str) -> DataFrame:
    """A row for each delete key of ``numbers`` and the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            both = zip(batch.column(at("numbers")).to_pylist(), batch.column(at(words)).to_pylist(), strict=True)
            yield batch.append_column("keys", pa.array([sorted(delete_keys(n, tuple(w.split(" ")))) for n, w in both], pa.list_(pa.int64())))

    return df.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", keys array<bigint>").select(*df.columns, F.explode("keys").alias("key"))


def named_rows(compounds: DataFrame, peaks: DataFrame) -> DataFrame:
    """The two tables of typed names as src_table, row_id, name."""
    return compounds.select(F.lit("plant_compounds").alias("src_table"), F.col("occurrence_id").cast("bigint").alias("row_id"), F.col("compound_name").alias("name")).unionByName(
        peaks.select(F.lit("standard_data").alias("src_table"), F.col("peak_id").cast("bigint").alias("row_id"), F.col("compound_name").alias("name"))
    )


def unmatched_names(named: DataFrame, library: DataFrame) -> DataFrame:
    """The typed values that are no list name and mean none, with how often each occurs."""
    exact = library.filter("compound is not null").select(F.col("compound").alias("name")).distinct()
    counted = named.groupBy("name").agg(F.count(F.lit(1)).alias("n_rows")).join(exact, "name", "left_anti")
    counted = stage(counted.withColumn("row_id", F.monotonically_increasing_id()), "names-counted")  # written, so the numbers stay
    matched = match_rows(counted.select(F.lit("").alias("src_table"), "row_id", "name"), library).select("row_id")
    return counted.join(matched, "row_id", "left_anti").select("name", "n_rows")
