"""Texts that were read with the wrong character encoding: find them and restore what can be had.

Multibyte damage (UTF-8 bytes read as a one-byte encoding): characters are mapped back to the bytes
of each legacy encoding, the UTF-8 byte-structure automaton, compiled once per encoding into a
character-class pattern, finds the maximal well-formed multibyte spans, and only those spans are
decoded. This repeats while it changes the text, which undoes damage done several times.

One-byte damage (bytes of one legacy encoding read as another) has no multibyte structure, so the
automaton can't see it. Sentences whose tokens fit no alphabet are mapped back to bytes and decoded
by the documented pairs of encodings; a pair is taken only if it leaves (almost) no misfit.

U+FFFD stands for bytes that are lost, and C1 controls that no encoding explains stay as they are: such
texts are found, and marked as not fully restored. So is a text in which tokens fit no alphabet after
all. ``by`` says which of these found a text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encodings that UTF-8 bytes may have been read as, in the order tried. "western" is cp1252 with latin-1 for its gaps and C1 controls.
MULTIBYTE_READ_AS = ("western", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "koi8-r", "cp866")
#: (written in, read as) for one-byte damage, in the order tried.
SINGLE_BYTE_PAIRS = (
    ("cp1251", "western"), ("koi8-r", "western"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp866", "cp1251"), ("cp866", "western"), ("iso8859-5", "western"),
    ("cp1250", "western"), ("iso8859-2", "western"), ("mac_roman", "western"), ("cp850", "western"), ("cp437", "western"),
    ("western", "mac_roman"), ("western", "cp850"), ("western", "cp437"), ("western", "cp1250"), ("western", "cp1251"), ("western", "koi8-r"), ("cp1250", "cp1251"), ("iso8859-2", "cp1250"),
    ("cp1252", "latin-1"), ("cp1251", "latin-1"), ("cp1250", "latin-1"),
)
#: The letters beyond a-z of the languages that texts are expected in.
ALPHABETS = {
    "de": "äöüß",
    "fr": "àâæçéèêëîïôœùûüÿ",
    "es": "áéíóúüñ",
    "pl": "ąćęłńóśźż",
    "pt": "áâãàçéêíóôõúü",
    "it": "àèéìíòóùú",
}
RUSSIAN = "абвгдежзийклмнопрстуфхцчшщъыьэюяё"
#: Single letters that are words, units or names of their own.
LONE_LETTERS = set("àÀèòóÓéÉÅåµμ") | set("αβγδεζηθκλμνξπρστφχψωΓΔΘΛΞΠΣΦΨΩ") | set(RUSSIAN) | set(RUSSIAN.upper())
_SYMBOLS = set("°±×÷€£¥¢§™©®†‡²³¹½¼¾−–—…•·“”‘’‚„«»‹›¿¡№≤≥≈≠∞√‰ªº‐‑  ​ ′″→←")
_WORD_SYMBOLS = set("-'’‐‑–/.,:;()[]·") | {"​", "­"}
_EDGES = "“”‘’‚„«»‹›…–—¿¡()[]{}<>*\"'.,;:!?|#~_=+/\\-%&$@^`0123456789°±×−‐‑"
LOST = "�"


def _byte_table(name: str) -> dict[str, int]:
    """Character to byte, for the bytes from 0x80."""
    if name == "western":
        table = {chr(b): b for b in range(0x80, 0x100)}
        return table | _byte_table("cp1252")
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b  # decoders of the web leave undefined bytes as controls
    return out


def _decode_table(name: str) -> dict[int, str]:
    return {b: c for c, b in sorted(_byte_table(name).items(), key=lambda x: ord(x[0]) < 0xA0 and name != "western")} | ({b: c for c, b in _byte_table("cp1252").items()} if name == "western" else {})


@lru_cache(maxsize=None)
def automaton(name: str) -> tuple[re.Pattern[str], dict[str, int]]:
    """Pattern of maximal runs of well-formed UTF-8 multibyte sequences, over characters in place of bytes."""
    table = _byte_table(name)

    def those(low: int, high: int) -> str:
        return "[" + "".join(re.escape(c) for c, b in table.items() if low <= b <= high) + "]"

    tail = those(0x80, 0xBF)
    kinds = (
        (those(0xC2, 0xDF), tail),
        (those(0xE0, 0xE0), those(0xA0, 0xBF), tail),
        (those(0xE1, 0xEC), tail, tail),
        (those(0xED, 0xED), those(0x80, 0x9F), tail),
        (those(0xEE, 0xEF), tail, tail),
        (those(0xF0, 0xF0), those(0x90, 0xBF), tail, tail),
        (those(0xF1, 0xF3), tail, tail, tail),
        (those(0xF4, 0xF4), those(0x80, 0x8F), tail, tail),
    )
    return re.compile("(?:" + "|".join("".join(k) for k in kinds if "[]" not in k) + ")+"), table


def _expected(c: str) -> bool:
    """Whether a decoded character is one that texts are expected to hold."""
    o = ord(c)
    return (
        0xA0 <= o <= 0x17F
        or 0x391 <= o <= 0x3C9
        or 0x400 <= o <= 0x45F
        or 0x2010 <= o <= 0x2044
        or o in (0x192, 0x2C6, 0x2DC, 0x20AC, 0x2116, 0x2122, 0xFEFF)
        or 0x2150 <= o <= 0x218B
        or 0x2190 <= o <= 0x22FF
        or 0x2500 <= o <= 0x25FF
        or 0xFF00 <= o <= 0xFFEF
        or 0x80 <= o <= 0x9F  # what a second layer of the same damage leaves
        or (o >= 0x1F300 and o <= 0x1FAFF)
    )


def _script(c: str) -> str:
    """The script of a letter, by the first word of its name; marks have the script of what they stand on."""
    return unicodedata.name(c, "?").split(" ")[0]


def _one_script(decoded: str) -> bool:
    """Two letters or more of one script, its marks included: letters that a span gives by chance hardly ever stand together."""
    own = [c for c in decoded if c.isalpha() or unicodedata.category(c) in ("Mn", "Mc")]
    if len(own) < 2 or not own[0].isalpha() or not all(c in own or unicodedata.category(c) == "Nd" or _expected(c) for c in decoded):
        return False
    return len({_script(c) for c in own} - {"COMBINING"}) == 1 and _script(own[0]) != "?"


def _fits(text: str, begin: int, end: int, decoded: str, name: str) -> bool:
    """Whether a span may be decoded: expected characters, and letters that stand beside letters.

    Letters of other scripts count only where the text was read as a western encoding, in which the
    characters of such spans never make up words; in the Cyrillic ones they do.
    """
    if not all(map(_expected, decoded)):
        return name == "western" and (_one_script(decoded) or _beside_letters(text, begin, end, decoded))
    before, after = text[begin - 1 : begin], text[end : end + 1]
    if len(decoded) > 1 or not decoded.isalpha() or decoded in LONE_LETTERS and not _is_cyrillic(decoded):
        return True
    if _is_cyrillic(decoded):  # one alone may be a capital before a closing quote: not enough, see restore_multibyte
        return False
    return before.isalpha() or after.isalpha()


def _beside_letters(text: str, begin: int, end: int, decoded: str) -> bool:
    """A single small Latin letter of another alphabet, or a mark, beside a small letter: it would have been read as a capital or an accented letter and a sign there."""
    before, after = text[begin - 1 : begin], text[end : end + 1]
    latin = len(decoded) == 1 and (decoded.islower() and _script(decoded) == "LATIN" or unicodedata.category(decoded) == "Mn")
    return latin and (before.islower() or after.islower())


def _is_cyrillic(c: str) -> bool:
    return "Ѐ" <= c <= "џ"


_HIGH_RUN = re.compile(r"[^\x00-\x7f]{2,}")


def _spans(text: str, name: str) -> tuple[int, list[tuple[int, int, str]]]:
    """(characters covered by spans that fit, the spans to decode) of a text for one encoding."""
    pattern, table = automaton(name)
    found = []
    for m in pattern.finditer(text):
        decoded = bytes(table[c] for c in m.group()).decode("utf-8")
        found.append((m.start(), m.end(), decoded, _fits(text, m.start(), m.end(), decoded, name)))
    covered = sum(end - begin for begin, end, _, ok in found if ok)
    cyrillic = any(ok and any(map(_is_cyrillic, d)) for *_, d, ok in found)
    return covered, [(b, e, d) for b, e, d, ok in found if ok or cyrillic and len(d) == 1 and _is_cyrillic(d)]


def restore_multibyte(text: str) -> tuple[str, list[str]]:
    """Decode the maximal well-formed multibyte spans; the encodings that the text had been read as.

    In each round the encoding whose spans cover the most characters is undone, in all places. Every
    round makes the text shorter, so it ends, whatever the number of layers.
    """
    used: list[str] = []
    while True:
        runs = "\n".join(_HIGH_RUN.findall(text))
        if not runs:
            break
        options = [(_spans(text, name), name) for name in MULTIBYTE_READ_AS if automaton(name)[0].search(runs)]
        options = [x for x in options if x[0][0]]
        if not options:
            break
        (_, spans), name = max(options, key=lambda x: x[0][0])  # the first of those that cover as much
        parts, at = [], 0
        for begin, end, decoded in spans:
            parts += [text[at:begin], decoded]
            at = end
        text = "".join([*parts, text[at:]])
        if name not in used:
            used.append(name)
    return text, used


_TOKEN = re.compile(r"[^\s   ]+")
_CYR_SWAP = re.compile("[а-яё][А-ЯЁ]")
_SENTENCE = re.compile(r"(?<=[.!?:;])[ \t]+|\n+")


@lru_cache(maxsize=100_000)
def misfit(token: str) -> bool:
    """Whether a token fits no alphabet: foreign letters, symbols inside words, capitals after small letters."""
    core = token.strip(_EDGES)
    if not core:
        return False
    odd = [c for c in core if c > "\x7f"]
    if not odd:
        return False
    if any("\x80" <= c <= "\x9f" for c in odd):
        return True
    if any(_is_cyrillic(c) for c in odd):
        letters = [c for c in core if c.isalpha()]
        if any(any(map(_is_cyrillic, w)) and any("a" <= c.lower() <= "z" for c in w) for w in re.split("[-‐‑–/]", core)):
            return True
        if any(c.lower() not in RUSSIAN for c in letters if c > "\x7f"):
            return True
        if any(not c.isalpha() and c not in _WORD_SYMBOLS and c > "\x7f" for c in core):
            return True
        return bool(_CYR_SWAP.search(core))
    if len(core) == 1:
        return core.isalpha() and core not in LONE_LETTERS or not core.isalpha() and core not in _SYMBOLS
    for i, c in enumerate(core):
        if c <= "\x7f":
            continue
        if not c.isalpha():
            if c not in _SYMBOLS and c not in _WORD_SYMBOLS:
                return True
            inside = 0 < i < len(core) - 1 and core[i - 1].isalpha() and core[i + 1].isalpha()
            if inside and c not in _WORD_SYMBOLS:
                return True
        elif i and core[i - 1].islower() and c.isupper():
            return True
        elif c.isupper() and i + 1 < len(core) and core[i + 1].islower() and i and core[i - 1].isupper() and core[i - 1] > "\x7f":
            return True
    strange = {c.lower() for c in odd if c.isalpha() and c.lower() not in "µμå" and not "Α" <= c <= "ω"}
    strange = {s for s in strange if unicodedata.category(s[0])[0] == "L"}
    return bool(strange) and not any(strange <= set(a) for a in ALPHABETS.values())


@lru_cache(maxsize=None)
def _translation(written: str, read: str) -> dict[int, str]:
    decode = _decode_table(written)
    return {ord(c): decode[b] for c, b in _byte_table(read).items() if b in decode}


def _misfits(text: str) -> int:
    return sum(map(misfit, _TOKEN.findall(text)))


#: Letters beyond a-z by how common they are in the expected languages; ties between pairs go to the more common letters.
_COMMON = "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъёéäüóáíöçãèàßñłęąêśćżźúńâôõîûïùœ"
_RARITY = {c: i for i, c in enumerate(_COMMON)} | {c.upper(): i + 20 for i, c in enumerate(_COMMON)}


def _rarity(text: str) -> int:
    return sum(_RARITY.get(c, 0 if c in _SYMBOLS else 90) for c in text if c > "\x7f")


def restore_single_byte(text: str) -> tuple[str, list[str]]:
    """Sentences with misfits, decoded by a pair of encodings that leaves (almost) none; the pairs used.

    The pair that mends the most sentences of the text goes first; sentences that it does not mend
    take the first pair that does.
    """
    if not _misfits(text):
        return text, []
    pieces, at = [], 0
    for stop, resume in [(m.start(), m.end()) for m in _SENTENCE.finditer(text)] + [(len(text), len(text))]:
        pieces.append([text[at:stop], text[stop:resume]])
        at = resume
    damaged = [(i, p[0], old) for i, p in enumerate(pieces) if (old := _misfits(p[0]))]
    mended: dict[tuple[str, str], dict[int, str]] = {}
    score: dict[tuple[str, str], tuple[int, int, int]] = {}
    for pair in SINGLE_BYTE_PAIRS:
        table, got, left = _translation(*pair), {}, 0
        for i, part, old in damaged:
            new_part = part.translate(table)
            new = _misfits(new_part)
            if new == 0 or old >= 4 and new * 4 <= old:
                got[i] = new_part
                left += new
        if got:
            mended[pair], score[pair] = got, (-len(got), left, _rarity("".join(got.values())))
    used = []
    for pair in sorted(mended, key=lambda p: score[p]):
        fresh = [i for i in mended[pair] if pieces[i][0] is not None and not any(i in mended[u] for u in used)]
        if fresh:
            for i in fresh:
                pieces[i][0] = mended[pair][i]
            used.append(pair)
    return "".join(a + b for a, b in pieces), [f"{w} read as {r}" for w, r in used]


_C1 = re.compile("[\x80-\x84\x86-\x9f]")  # U+0085 is a line break of its own


@dataclass(frozen=True)
class Restored:
    """What became of a damaged text."""

    text: str
    damage: tuple[str, ...]
    by: tuple[str, ...]
    fully_restored: bool


def restore(text: str | None) -> Restored | None:
    """The restored text, what had happened, what found it and whether nothing of the damage is left; None where nothing is damaged."""
    if not text or text.isascii():
        return None
    fixed, utf8 = restore_multibyte(text)
    fixed, single = restore_single_byte(fixed)
    said = [f"utf-8 read as {x}" for x in utf8] + single
    by = ["multibyte"] * bool(utf8) + ["single byte"] * bool(single)
    if LOST in text:
        said.append("bytes lost")
        by.append("lost bytes")
    if _C1.search(text):
        said += ["control characters"] * bool(_C1.search(fixed))
        by.append("controls")
    if not by:
        return None
    return Restored(fixed, tuple(said), tuple(by), LOST not in fixed and not _C1.search(fixed) and not _misfits(fixed))


RESTORED_SCHEMA = "doc_id bigint, restored_text string, damage string, found_by string, fully_restored boolean"
_RESTORED = pa.schema([("doc_id", pa.int64()), ("restored_text", pa.string()), ("damage", pa.string()), ("found_by", pa.string()), ("fully_restored", pa.bool_())])


def _restore_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            got = restore(text)
            if got:
                rows.append((doc_id, got.text, "; ".join(got.damage), "; ".join(got.by), got.fully_restored))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_RESTORED.types)], schema=_RESTORED)


def damaged_texts(documents: DataFrame) -> DataFrame:
    """Damaged documents with the restored text, what had happened, what found it, and whether nothing of the damage is left.

    Null, empty and pure-ASCII texts are never damaged. Map-only: no shuffle, whole texts.
    """
    some = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter(F.col("text").rlike(r"[^\x00-\x7f]"))
    return some.mapInArrow(_restore_batches, RESTORED_SCHEMA)
