"""Loading peak lines although some do not parse: a minimum-cost error parse.

Two dynamic programs run on each line. The first walks the line's quotes, delimiters and text runs
through the quoting automaton; a quote may be deleted or inserted at cost 1 each. The second
aligns the resulting fields with the declared columns; a delimiter may be inserted (an empty
column) or deleted (two fields merged) at cost 1 each, and a field that is no valid value of its
column costs TYPE_COST. Quote edits weigh more than any number of delimiter edits: of the parses
with the fewest quote edits, one for each number of fields, the one whose alignment costs least is
taken. Both programs take time in proportion to the line. A line of cost zero loads; otherwise the
edits of the cheapest parse state the reason:

* a quote edit: ``quoting``; otherwise a delimiter edit: ``column_count``; otherwise ``invalid_value``.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUMBER = re.compile(r"[+-]?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
TYPE_COST = 0.01
_TOKENS = re.compile(r'"|,|[^",]+')
_START, _PLAIN, _QUOTED, _CLOSED = range(4)


@dataclass(frozen=True)
class Column_:
    """A declared column: its name, whether it is a number above 0 (up to ``most``), and whether it may be empty."""

    name: str
    number: bool = False
    most: float = float("inf")
    may_be_empty: bool = True

    def accepts(self, value: str) -> bool:
        if value == "":
            return self.may_be_empty
        if not self.number:
            return True
        return NUMBER.fullmatch(value) is not None and 0 < float(value) <= self.most


#: The eight columns of a peak line with their ranges.
PEAK_COLUMNS = (
    Column_("component_rt", True, 120, False),
    Column_("base_peak_mz", True, may_be_empty=False),
    Column_("base_peak_area", True),
    Column_("component_area", True, may_be_empty=False),
    Column_("compound_name", may_be_empty=False),
    Column_("match_factor", True, 100, False),
    Column_("sample_name"),
    Column_("file_name", may_be_empty=False),
)


def value_of(field: str) -> str:
    """A field without its quotes and outer spaces."""
    if len(field) >= 2 and field[0] == '"' == field[-1]:
        field = field[1:-1].replace('""', '"')
    return field.strip()


def _step(state: int, token: str) -> int | None:
    """The quoting automaton: the next state, or None where the token does not fit."""
    if token == ",":
        return _QUOTED if state == _QUOTED else _START
    if token == '"':
        return {_START: _QUOTED, _QUOTED: _CLOSED, _CLOSED: _QUOTED}.get(state)
    return {_START: _PLAIN, _PLAIN: _PLAIN, _QUOTED: _QUOTED}.get(state)


def quote_parses(tokens: list[str], width: int) -> tuple[int, list[tuple[list[str], list[str]]]]:
    """Cheapest parses by quote edits: (edits, [(fields with their quotes, edit texts)]), one parse for each number of fields.

    Zero-cost lines are one walk through the automaton. Ties prefer fewer insertions, then the
    earliest alternative; parses of a field count nearer ``width`` come first.
    """
    state, fields, begin = _START, [], 0
    for i, token in enumerate(tokens):
        after = _step(state, token)
        if after is None:
            break
        if token == "," and state != _QUOTED:
            fields.append("".join(tokens[begin:i]))
            begin = i + 1
        state = after
    else:
        if state != _QUOTED:
            return 0, [([*fields, "".join(tokens[begin:])], [])]
    # best[(state, fields so far)] = (edits, insertions, back link); a back link is (earlier link, emitted text, edit text)
    cap = 2 * width + 2
    best: dict[tuple[int, int], tuple[int, int, tuple | None]] = {(_START, 1): (0, 0, None)}
    for i, token in enumerate([*tokens, None]):
        todo = sorted(best.items(), key=lambda x: x[1][:2])
        for (s, k), (edits, ins, link) in todo:  # insert one quote before this token
            after = _step(s, '"')
            if after is not None:
                new = (edits + 1, ins + 1, (link, '"', f"insert quote at {i}"))
                if (after, k) not in best or new[:2] < best[after, k][:2]:
                    best[after, k] = new
        if token is None:
            break
        moved: dict[tuple[int, int], tuple[int, int, tuple | None]] = {}

        def offer(key, value, moved=moved):
            if key not in moved or value[:2] < moved[key][:2]:
                moved[key] = value

        for (s, k), (edits, ins, link) in best.items():
            after = _step(s, token)
            if after is not None:
                new_field = token == "," and s != _QUOTED
                offer((after, min(cap, k + new_field)), (edits, ins, (link, "\x00" if new_field else token, None)))
            if token == '"':
                offer((s, k), (edits + 1, ins, (link, "", f"delete quote at {i}")))
        best = moved
    ends = {x: v for x, v in best.items() if x[0] != _QUOTED}
    least = min(v[0] for v in ends.values())
    out, seen = [], set()
    for (_, k), (edits, _, link) in sorted(ends.items(), key=lambda x: (abs(x[0][1] - width), x[1][1], x[0])):
        if edits > least or k in seen:
            continue
        seen.add(k)
        parts: list[str] = []
        said: list[str] = []
        while link is not None:
            link, text, edit = link
            parts.append(text)
            if edit:
                said.append(edit)
        out.append(("".join(reversed(parts)).split("\x00"), said[::-1]))
    return least, out


#: Characters and pieces that a number put together of several fields may have; longer ones count as no valid number.
MERGED_NUMBER = 64


def align(values: list[str], columns: tuple[Column_, ...]) -> tuple[float, list[str | None], list[str]]:
    """Cheapest alignment of field values with columns by delimiter edits: (cost, a value per column, edit texts).

    A column takes any run of fields. Whether a run is a valid text depends only on whether any of its
    fields is non-empty, so the best start of a run is a running minimum; only numbers put together of a
    few fields are tried run by run. The time is in proportion to the number of fields.
    """
    n, width = len(values), len(columns)
    if n == width:
        return sum(TYPE_COST for v, c in zip(values, columns, strict=True) if not c.accepts(v)), list(values), []
    inf = float("inf")
    empty_from = [0] * (n + 1)  # the first field of the run of empty fields that ends before i
    for i in range(1, n + 1):
        empty_from[i] = empty_from[i - 1] if values[i - 1] == "" else i
    cost = array("d", [inf]) * (n + 1)
    cost[0] = 0.0
    takes: list[array] = []
    for column in columns:
        new, took = array("d", [inf]) * (n + 1), array("q", [0]) * (n + 1)
        blank = 0.0 if column.accepts("") else TYPE_COST
        filled = TYPE_COST if column.number else 0.0  # a run that holds a non-empty field, numbers apart
        low, low_at = inf, -1  # the least cost[k] - k of starts whose run up to here holds a non-empty field
        void, void_at = inf, -1  # and of starts whose run up to here is empty fields only
        for i in range(n + 1):
            if i:
                if cost[i - 1] - i + 1 < void:
                    void, void_at = cost[i - 1] - i + 1, i - 1
                if values[i - 1] != "":  # with this field, the runs that were empty are not
                    if void < low:
                        low, low_at = void, void_at
                    void, void_at = inf, -1
            best, take = cost[i] + 1 + blank, 0
            if low_at >= 0 and low + i - 1 + filled < best:
                best, take = low + i - 1 + filled, i - low_at
            if void_at >= 0 and void + i - 1 + blank < best:
                best, take = void + i - 1 + blank, i - void_at
            if column.number and i - empty_from[i] < MERGED_NUMBER:
                merged = ""
                for k in range(i - 1, max(-1, i - MERGED_NUMBER - 1), -1):
                    merged = values[k] + merged
                    if len(merged) > MERGED_NUMBER or i - k - 1 >= best:
                        break
                    if merged != "" and cost[k] + i - k - 1 < best and column.accepts(merged):
                        best, take = cost[k] + i - k - 1, i - k
            new[i], took[i] = best, take
        takes.append(took)
        cost = new
    i, out, said = n, [], []
    for j in range(width - 1, -1, -1):
        take = takes[j][i]
        out.append("".join(values[i - take : i]))
        if take == 0:
            said.append(f"insert delimiter for {columns[j].name}")
        elif take > 1:
            said.append(f"delete {take - 1} delimiter(s) in {columns[j].name}")
        i -= take
    return cost[n], out[::-1], said[::-1]


def parse_line(line: str | None, columns: tuple[Column_, ...] = PEAK_COLUMNS) -> tuple[str | None, float, list[str], list[str | None]]:
    """(reason or None, cost, edits, a value per column). A null line counts as an empty one."""
    quotes, parses = quote_parses(_TOKENS.findall(line or ""), len(columns))
    best = None
    for fields, edits in parses:
        aligned = align([value_of(f) for f in fields], columns)
        if best is None or aligned[0] < best[1][0]:
            best = edits, aligned
    said, (cost, values, moves) = best
    bad = [f"invalid {c.name}" for c, v in zip(columns, values, strict=True) if not c.accepts(v)]
    reason = "quoting" if quotes else "column_count" if moves else "invalid_value" if bad else None
    return reason, 1000 * quotes + cost, said + moves + bad, values


_PARSED = pa.schema([("line_id", pa.int64()), ("reason", pa.string()), ("cost", pa.float64()), ("edits", pa.list_(pa.string())), ("fields", pa.list_(pa.string()))])
PARSED_SCHEMA = "line_id bigint, reason string, cost double, edits array<string>, fields array<string>"


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, lines = batch.column(0), batch.column(1).to_pylist()
        parsed = [parse_line(x) for x in lines]
        columns = [pa.array([p[i] for p in parsed], t) for i, t in enumerate(_PARSED.types[1:])]
        yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *columns], schema=_PARSED)


def parse_lines(raw: DataFrame) -> DataFrame:
    """Each line's parse: line_id, reason (null: it loads), cost, edits and the aligned fields.

    A null or empty line is one empty field, so its reason is column_count. Map-only: no shuffle.
    """
    return raw.select(F.col("line_id").cast("bigint").alias("line_id"), F.col("raw_line").cast("string").alias("raw_line")).mapInArrow(_parse_batches, PARSED_SCHEMA)


def broken_lines(raw: DataFrame) -> DataFrame:
    return parse_lines(raw).filter("reason is not null").select("line_id", "reason")


def loaded_peaks(raw: DataFrame) -> DataFrame:
    """The good lines as typed peaks; empty sample and base area are null."""
    parsed = parse_lines(raw).filter("reason is null")
    out = [F.col("line_id")]
    for i, c in enumerate(PEAK_COLUMNS):
        text = F.col("fields")[i]
        text = F.when(text != "", text)
        out.append((text.try_cast("double") if c.number else text).alias(c.name))
    return parsed.select(*out)


def rejected_lines(raw: DataFrame) -> DataFrame:
    """The broken lines with reason, cost and the edits that the cheapest parse needs."""
    return parse_lines(raw).filter("reason is not null").select("line_id", "reason", F.col("cost"), F.array_join("edits", "; ").alias("edits"))
