"""Text that was read in a wrong encoding, found and restored (problem 10).

A hidden Markov model with one clean state and one state per encoding pair labels the characters
beyond ASCII of a text.  What a pair's state emits follows from the pair itself: the characters are
turned back into bytes by the encoding that was wrongly used for reading and parsed by the one the
text was written in.  A character in a unit that parses to what sound text is made of is likely
there, any other is not.  The best path (Viterbi) gives the labelled spans, and each span gets its
state's inverse transform.

A unit that stands alone between sound quotation marks, brackets or backticks is what sound text
about garbling shows: a further state of the model, the specimen, takes it.  A replacement character
that stands alone between spaces tells little by itself: it may be a lost dash, and how likely that
is follows from the next word, by counts of what follows dashes in all texts.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache
from types import MappingProxyType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.functions.batches import by_batch
from vellumine.session import cut_lineage

# Encodings that UTF-8 is wrongly read in, as chains applied from the last reading back.
UTF8_READ_AS = [
    ("latin-1",),
    ("cp1252",),
    ("cp1252", "cp1252"),
    ("latin-1", "latin-1"),
    ("cp1252", "latin-1"),
    ("latin-1", "cp1252"),
    ("cp1252", "cp1252", "cp1252"),
    ("mac_roman",),
    ("cp437",),
    ("cp850",),
    ("cp1250",),
    ("cp1251",),
    ("koi8_r",),
    ("cp932",),
    ("gbk",),
]
# Fixed values: (written in, wrongly read as) for two-byte encodings.
PAIRS_READ_AS = [("cp932", "latin-1"), ("cp932", "cp1252"), ("euc_jp", "latin-1"), ("euc_jp", "cp1252")]
# Fixed values: (written in, wrongly read as) for single-byte encodings.
BYTES_READ_AS = [
    ("cp1252", "mac_roman"),
    ("cp1252", "cp437"),
    ("cp1252", "cp850"),
    ("cp1252", "cp1250"),
    ("cp1252", "cp1251"),
    ("cp1252", "koi8_r"),
    ("mac_roman", "cp1252"),
    ("cp437", "cp1252"),
    ("cp850", "cp1252"),
]
LOSSY = "single-byte as utf-8"
# Letters beyond ASCII in the alphabets of the archive's languages that use Latin.
_LETTERS = frozenset("àâäáãçéèêëíìîïñóòôöõœúùûüßæÀÂÄÁÃÇÉÈÊËÍÌÎÏÑÓÒÔÖÕŒÚÙÛÜ")
_MARKS = frozenset("“”‘’–—…„«»¿¡€°·")
_QUOTES = "\"'`“”‘’„‚«»‹›「」『』()[]"

# Log-likelihoods relative to the clean state, per character.
_FIT, _DEEP, _MISFIT = 4.0, 0.5, -7.0
_ENTER, _LEAVE = -5.5, -1.0
#: What one sure sign is worth: a little more than entering and leaving a state costs.
_SURE = 7.0
#: A replacement character between spaces, and how far the next word may shift that; two of them reach _SURE.
_LONE, _SHIFT = 4.2, 4.0
_NEXT = re.compile(r"\s+([^\W\d_]+)")
#: Words, words after a dash between spaces, and words after a replacement character between spaces.
_WORD, _DASHED, _ASKED = re.compile(r"[^\W\d_]+"), re.compile(r"(?<=\s)[–—]\s+([^\W\d_]+)"), re.compile(r"(?<!\S)�\s+([^\W\d_]+)")
#: Words that are counted at once before their counts are passed on.
_COUNTED = 1 << 18
#: Letters beyond ASCII that are words in one of the archive's languages.
_LETTER_WORDS = frozenset("àéèóòôÀÉÈÓÒÔ")
_WIDE = ("cp932", "gbk")


@lru_cache(maxsize=None)
def _bytes_of(codec: str) -> dict[str, bytes]:
    """Characters beyond ASCII to the bytes that ``codec`` reads as them; undefined bytes of a
    single-byte codec are read as control characters."""
    if codec in ("cp932", "gbk"):
        return {}
    out = {}
    for b in range(0x80, 0x100):
        raw = bytes([b])
        try:
            c = raw.decode(codec)
        except UnicodeDecodeError:
            c = chr(b)
        out[c] = raw
    return out


def _back(c: str, codec: str) -> bytes | None:
    table = _bytes_of(codec)
    if table:
        return table.get(c)
    try:
        return c.encode(codec)
    except UnicodeEncodeError:
        return None


def plausible(c: str) -> float:
    """How well a decoded character fits sound text: 1 as usual, 0 not at all."""
    o = ord(c)
    if 0xC0 <= o <= 0xFF and o not in (0xD7, 0xF7):
        return 1.0
    if o in (0xA0, 0xA1, 0xA9, 0xAB, 0xAE, 0xB0, 0xB1, 0xB2, 0xB3, 0xB5, 0xB7, 0xBA, 0xAA, 0xBB, 0xBC, 0xBD, 0xBE, 0xBF, 0xA3, 0xA7, 0xD7, 0xF7, 0x152, 0x153, 0x160, 0x161, 0x178, 0x17D, 0x17E, 0xA2, 0xA5, 0xB4, 0xA8, 0xAD):
        return 1.0
    if 0x2010 <= o <= 0x203A or o in (0x20AC, 0x2122, 0x2116, 0x200B, 0x200D, 0x2190, 0x2191, 0x2192, 0x2193, 0xFE0F, 0x2212, 0x221A, 0x2248, 0x2260, 0x2264, 0x2265):
        return 1.0
    if 0x3000 <= o <= 0x30FF or 0x4E00 <= o <= 0x9FFF or 0xFF01 <= o <= 0xFF9F:
        return 1.0
    if 0x2500 <= o <= 0x27BF or 0x1F300 <= o <= 0x1FAFF:
        return 1.0
    if 0x391 <= o <= 0x3C9 or 0x410 <= o <= 0x451:
        return 0.45
    if 0x100 <= o <= 0x17F:
        return 0.4
    return 0.0


def _units(chars: list[tuple[str, int, int]], codec: str) -> tuple[list[tuple[str, int, int]], list[tuple[int, int, str]]]:
    """One step back: UTF-8 units in the bytes that ``codec`` read as ``chars``.

    Takes (character, start, end) with offsets in the text; gives the characters of the units in
    the same form, and the units as (start, end, decoded).  Characters outside of units are gone.
    """
    out, found, i, n = [], [], 0, len(chars)
    raw = [None if c < "\x80" else _back(c, codec) for c, _, _ in chars]
    while i < n:
        first, unit = raw[i], None
        if first and 0xC2 <= first[0] <= 0xF4:
            need = 2 if first[0] < 0xE0 else 3 if first[0] < 0xF0 else 4
            # characters of two bytes may end within the next unit: take whole characters
            j, held = i, b""
            while j < n and raw[j] and len(held) < need + 3 and (j == i or chars[j][1] == chars[j - 1][2]):
                held += raw[j]
                j += 1
                if len(held) >= need:
                    try:
                        unit = held.decode("utf-8")
                        break
                    except UnicodeDecodeError:
                        if len(held) % need == 0:
                            break
        if unit:
            start, end = chars[i][1], chars[j - 1][2]
            found.append((start, end, unit))
            out += [(c, start if k == 0 else end, end) for k, c in enumerate(unit)]
            i = j
        else:
            i += 1
    return out, found


def _pair_units(text: str, at: list[int], written: str, read: str) -> Iterator[tuple[int, int, str]]:
    """Units of two bytes of ``written`` whose bytes ``read`` shows as characters of ``text``; ``at``
    has the offsets of those beyond ASCII."""
    table, last = _bytes_of(read), 0
    for i in at:
        a = table.get(text[i])
        if not a or i < last or i == len(text) - 1:
            continue
        b = table.get(text[i + 1]) or (text[i + 1].encode() if "\x40" <= text[i + 1] <= "\x7e" and written == "cp932" else None)
        if b:
            try:
                c = (a + b).decode(written)
            except UnicodeDecodeError:
                continue
            if len(c) == 1 and c > "\x7f":
                yield i, i + 2, c
                last = i + 2


def _strange(text: str, i: int, c: str, bare: bool) -> float:
    """How much the character at ``i`` is out of place in sound text, by its neighbours, where ``c``
    is what it stands for; ``bare`` tells that no letter beyond ASCII in the text must be one."""
    seen, before, after, later = text[i], text[i - 1 : i] if i else "", text[i + 1 : i + 2], text[i + 2 : i + 3]
    left, right = before.isalpha() and before < "\u0250", after.isalpha() and after < "\u0250"
    spaced = (not before or before.isspace()) and (not after or after.isspace())
    if seen.isalpha() and seen < "\u0250" and c in _MARKS:
        if spaced:
            return _SURE if c in "–—" and (bare or seen not in _LETTER_WORDS) or c in "«»" and seen not in _LETTER_WORDS else -0.5
        if c == "’" and bare and seen in _LETTERS and left and right and not later.isalpha():
            # "don't", "I'm"; an "s" may end a name
            return _SURE if before + after in ("nt", "Im", "Id") else 2.5 if after == "s" else -0.5
        if not left and right and after.isupper() and (seen.islower() or later.islower()) and c in "“‘„«¿¡":
            return _SURE
        if not right and (left and before.islower() and seen.isupper() or before and before in ",.!?;:" and (not after or after.isspace())):
            return _SURE if c in "”“’»…" else -0.5
    if seen in _LETTERS:
        return 3.5 if seen.isupper() and before.islower() and left else -0.5
    if seen in "’'‘" or seen > "\u2fff":
        return -0.5
    if seen in "“”«»–—…„¿¡":
        return 3.5 if left and right else -0.5
    if left and right:
        return 7.5
    if "\u2500" <= seen <= "\u259f" and (left or right):
        return _SURE
    if seen.isalpha() and (left or right):
        return 6.0
    if left and not seen.isdigit() and seen not in "€°·™®©²³":
        return 5.0
    if right and not left and c in "«“„‘" and after.isupper():
        return 4.0
    return 0.5 if not seen.isalnum() and (seen in "‡·ª´") else -0.5


def _fits(text: str, i: int, c: str) -> bool:
    """Whether ``c`` in place of the character at ``i`` makes sound text."""
    before, after = text[i - 1 : i], text[i + 1 : i + 2]
    if c in _LETTERS:
        if c.isupper():
            return not before.islower() and (not after.islower() or not before.isalpha())
        return not (before.isupper() and after.isupper())
    return c in _MARKS and not (c not in "’–—…" and before.isalpha() and after.isalpha())


@lru_cache(maxsize=None)
def _stands_for(written: str, read: str) -> dict[str, str]:
    """What the letters and marks of ``written`` look like when read as ``read``, turned round."""
    out = {}
    for seen, raw in _bytes_of(read).items():
        try:
            c = raw.decode(written)
        except UnicodeDecodeError:
            continue
        if c != seen and (c in _LETTERS or c in _MARKS) and unicodedata.category(seen)[0] not in "ZC":
            out[seen] = c
    return out


def _single(text: str, at: list[int], written: str, read: str) -> tuple[np.ndarray, dict[int, tuple[int, str]]]:
    """Scores of the characters and units of a single-byte pair."""
    table, score, kept = _stands_for(written, read), np.full(len(at), _MISFIT), {}
    bare = all(c == "’" or c in _MARKS and not (text[i - 1 : i].isalpha() and text[i + 1 : i + 2].isalpha()) for i in at if text[i].isalpha() for c in [table.get(text[i], "")])
    for k, i in enumerate(at):
        c = table.get(text[i])
        if c and _fits(text, i, c):
            kept[i] = (i + 1, c)
            score[k] = _strange(text, i, c, bare)
    return score, kept


def _latin(c: str) -> bool:
    return c.isalpha() and c < "\u0250"


def _latin_units(found: list[tuple[int, int, str]]) -> set[int]:
    """Offsets in units that stand for letters and marks of Latin text."""
    return {o for s, e, decoded in found if all(c <= "\x7f" or c in _LETTERS or c in _MARKS for c in decoded) for o in range(s, e)}


def _unit_score(text: str, start: int, end: int, decoded: str, chain: tuple[str, ...], latin: set[int]) -> float:
    """Evidence of each character beyond ASCII of a unit of UTF-8; ``latin`` has the offsets that other
    units turn into Latin text."""
    before, after = text[start - 1 : start] if start else "", text[end : end + 1]
    if chain[0] not in _WIDE:
        fit = min(plausible(c) for c in decoded)
        if _latin(before) and any("\u3000" <= c <= "\u9fff" for c in decoded):
            fit *= 0.1  # "é", a fixed space and a quotation mark are the bytes of an ideograph
        return _FIT * fit + _DEEP * (len(chain) - 1) if fit > 0 else _MISFIT
    if any(_kana(c) for c in decoded):
        return _FIT * 0.6 * min(plausible(c) for c in decoded)
    # ideographs and narrow kana within Latin words that stand for what such words need
    held = [c for c in decoded if c > "\x7f"]
    if all(c in _LETTERS or c in _MARKS for c in held):
        near = [(c, o) for c, o in ((before, start - 1), (after, end)) if c]
        words = any(_latin(c) for c, _ in near) and not any("\u3040" <= c <= "\u9fff" and o not in latin for c, o in near)
        words = words and not (decoded[-1].islower() and after.isupper())
        short = len(decoded.encode()) == 2 and held[0] in _MARKS
        return (3.0 if short else _SURE) / (end - start) if words else 1.0 if all(c.isspace() for c, _ in near) else 0.4
    fit = 0.1 * min(plausible(c) for c in decoded)
    return _FIT * fit if fit > 0 else _MISFIT


@lru_cache(maxsize=1 << 16)
def _bare(c: str) -> bool:
    """Whether ``c`` can't start a unit of UTF-8 that a two-byte encoding shows."""
    return not any(0xC2 <= (_back(c, codec) or b"\0")[0] <= 0xF4 for codec in _WIDE)


def _pair_score(text: str, s: int, c: str, written: str) -> float | None:
    """Evidence of each character beyond ASCII of a unit of two bytes; None if it is part of a word."""
    if not _kana(c) and _in_word(text, s):
        return None
    lead = text[s]
    strong = lead < "\xa0" or lead in "‚ƒ„…†‡ˆ‰Š‹Œ" or (written == "euc_jp" and lead in "¤¥¡")
    if _kana(c) and strong:
        return 2.5
    if plausible(c) and (strong or written == "euc_jp"):
        return 1.0
    return 0.3 if plausible(c) and text[s + 1] > "\x7f" else -1.5


def _in_word(text: str, i: int) -> bool:
    """Whether the two characters from ``i`` are letters that end or go on a word, as in "ação"."""
    before, pair, after = text[i - 1 : i], text[i : i + 2], text[i + 2 : i + 3]
    alike = before.islower() and pair.islower() or before.isupper() and pair.isupper()
    return alike and "A" <= before <= "z" and after <= "\x7f" and all(c in _LETTERS for c in pair)


def _kana(c: str) -> bool:
    return "぀" <= c <= "ヿ" or c in "、。ー・「」"


@dataclass
class Span:
    start: int
    end: int
    pair: str
    restored: str | None


def _lost(text: str, o: int, follows: Mapping[str, float]) -> float:
    """Evidence of the replacement character at ``o``."""
    before, after = text[o - 1 : o] if o else "", text[o + 1 : o + 2]
    if before > "\u2fff" and after > "\u2fff":
        return 1.0
    if before and not before.isspace() or after and not after.isspace():
        return 8.0
    word = _NEXT.match(text, o + 1)
    return _LONE + (follows.get(word[1].lower(), -_SHIFT) if word and follows else 0.0)


def _evidence(text: str, follows: Mapping[str, float]) -> tuple[list[str], np.ndarray, list[int], list[dict[int, tuple[int, str]]]]:
    """(pairs, log-likelihoods, offsets of the characters beyond ASCII, units by pair and start)."""
    at = [i for i, c in enumerate(text) if c > "\x7f"]
    row = {o: k for k, o in enumerate(at)}
    names, scores, units = ["clean"], [np.zeros(len(at))], [{}]
    chars = [(text[i], i, i + 1) for i in at]  # no unit holds a character of ASCII
    first: dict[str, tuple] = {}
    for chain in UTF8_READ_AS:
        if chain[0] not in first:
            first[chain[0]] = _units(chars, chain[0])
        now, found = first[chain[0]]
        for codec in chain[1:]:
            now, found = _units(now, codec)
        if not found:
            continue
        score = np.full(len(at), _MISFIT)
        kept: dict[int, tuple[int, str]] = {}
        wide = chain[0] in _WIDE
        latin = _latin_units(found) if wide else set()
        for s, e, decoded in found:
            kept[s] = (e, decoded)
            gain = _unit_score(text, s, e, decoded, chain, latin)
            for o in range(s, e):
                if o in row:
                    score[row[o]] = gain
        if wide:
            # bytes that the wrong encoding has no character for
            gaps = [k for k, o in enumerate(at) if text[o] == "�" and any(0 <= k + d < len(at) and abs(at[k + d] - o) <= 2 and score[k + d] > 0 for d in (-2, -1, 1, 2))]
            score[score == _MISFIT] = -2.0
            score[gaps] = _FIT
        names.append("utf-8 as " + " as ".join(reversed(chain)))
        scores.append(score)
        units.append(kept)
    for written, read in PAIRS_READ_AS:
        score, kept = np.full(len(at), _MISFIT), {}
        for s, e, c in _pair_units(text, at, written, read):
            gain = _pair_score(text, s, c, written)
            if gain is None:
                continue
            kept[s] = (e, c)
            for o in (s, s + 1):
                if o in row:
                    score[row[o]] = gain
        if kept:
            names.append(f"{written} as {read}")
            scores.append(score)
            units.append(kept)
    for written, read in BYTES_READ_AS:
        score, kept = _single(text, at, written, read)
        if kept and score.max() >= 2.5:
            names.append(f"{written} as {read}")
            scores.append(score)
            units.append(kept)
    if "�" in text:
        score = np.full(len(at), _MISFIT)
        for k, o in enumerate(at):
            if text[o] == "�":
                score[k] = _lost(text, o, follows)
        names.append(LOSSY)
        scores.append(score)
        units.append({})
    return names, np.array(scores).T if len(at) else np.zeros((0, len(names))), at, units


def _specimens(text: str, at: list[int], scores: np.ndarray, units: list[dict]) -> np.ndarray:
    """Evidence of the specimen state; what is evidence for it is none for a pair."""
    row = {o: k for k, o in enumerate(at)}
    spans = {(s, e) for k, kept in enumerate(units) for s, (e, _) in kept.items() if scores[row[s], k] > 1}
    covered = {o for s, e in spans for o in range(s, e) if e - s > 1} | {o for o in at if text[o] == "�"}
    out, last = np.full(len(at), _MISFIT), -1
    for s, e in sorted(spans | {(o, o + 1) for o in at if text[o] == "�"}, key=lambda x: (x[0], -x[1])):
        if e <= last:  # within a longer unit
            continue
        last = e
        before, after = text[s - 1 : s] if s else "", text[e : e + 1]
        if before and after and before in _QUOTES and after in _QUOTES and s - 1 not in covered and e not in covered:
            inside = [row[o] for o in range(s, e) if o in row]
            out[inside] = scores[inside, 1:].max(axis=1)
            scores[inside, 1:] = np.minimum(scores[inside, 1:], 0.0)
    return out


def label(text: str, follows: Mapping[str, float] = MappingProxyType({})) -> list[Span]:
    """The garbled spans of ``text``, in order, each with its pair and, where it can be had, the
    sound text.  ``follows`` tells how much more often a word follows a dash than another word, as a
    logarithm; without it nothing is known of that."""
    names, scores, at, units = _evidence(text, follows)
    n, states = scores.shape
    if not n or states == 1 or scores[:, 1:].max() <= 0:
        return []
    scores = np.column_stack([scores, _specimens(text, at, scores, units)])
    specimen, states = states, states + 1
    if scores[:, 1:specimen].max() <= 0:
        return []
    move = np.full((states, states), _ENTER + _LEAVE)
    move[0, :], move[:, 0] = _ENTER, _LEAVE
    np.fill_diagonal(move, 0.0)
    best, came = scores[0] + np.where(np.arange(states) == 0, 0, _ENTER), np.zeros((n, states), dtype=np.int64)
    for i in range(1, n):
        options = best[:, None] + move
        came[i] = options.argmax(axis=0)
        best = options[came[i], np.arange(states)] + scores[i]
    best = best + np.where(np.arange(states) == 0, 0, _LEAVE)
    path = np.zeros(n, dtype=np.int64)
    path[-1] = best.argmax()
    for i in range(n - 1, 0, -1):
        path[i - 1] = came[i, path[i]]
    out, i = [], 0
    while i < n:
        j = i
        while j + 1 < n and path[j + 1] == path[i]:
            j += 1
        if path[i] and path[i] != specimen:
            start, end = at[i], at[j] + 1
            inside = units[path[i]]
            end = max([end, *(e for s, (e, _) in inside.items() if start <= s < end)])
            out.append(Span(start, end, names[path[i]], _restore(text, start, end, inside)))
        i = j + 1
    return out


def _restore(text: str, start: int, end: int, units: dict[int, tuple[int, str]]) -> str | None:
    """The inverse transform of a span, or None if a character of it doesn't come back."""
    out, i = [], start
    while i < end:
        if i in units:
            i, c = units[i][0], units[i][1]
            out.append(c)
        elif text[i] <= "\x7f":
            out.append(text[i])
            i += 1
        else:
            return None
    return "".join(out)


def restored_text(text: str, spans: list[Span]) -> str:
    """``text`` with every span that could be restored put right."""
    out, at = [], 0
    for s in spans:
        out += [text[at : s.start], text[s.start : s.end] if s.restored is None else s.restored]
        at = s.end
    return "".join([*out, text[at:]])


#: What a path has to gain in a state to be better than the clean one.
_LEAST = -_ENTER - _LEAVE


@lru_cache(maxsize=1)
def _telling() -> re.Pattern:
    """The characters that can have evidence or start a unit that has: all that a single-byte encoding
    reads, those whose bytes in a two-byte one start UTF-8, and the replacement character."""
    out = {"�"}
    for codec in {c for chain in UTF8_READ_AS for c in chain[:1]} | {read for _, read in PAIRS_READ_AS + BYTES_READ_AS}:
        out |= {c for c in _bytes_of(codec) if c > "\x7f"}
    out |= {c for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x10000)]) if not _bare(c)}
    return re.compile(f"[{_class(list(out))}]")


@lru_cache(maxsize=1 << 18)
def _bound(near: str, i: int) -> float:
    """What the character at ``i`` of its surroundings can gain at most, in any state.  A unit's gain
    in a two-byte encoding is counted at its first character.  Rests on the same functions as the
    evidence itself, with every doubt in favour of a state."""
    c, gain = near[i], 0.0
    if c == "�":
        return 8.0  # and _FIT as a gap
    for chain in UTF8_READ_AS:
        codec = chain[0]
        if codec in _WIDE:
            if not 0xC2 <= (_back(c, codec) or b"\0")[0] <= 0xF4:
                continue
            chars = [(x, k, k + 1) for k, x in enumerate(near) if k >= i and x > "\x7f"]
            for s, e, decoded in _units(chars, codec)[1][:1]:
                if s == i:
                    # a neighbour may belong to another unit
                    gain = max(gain, (e - s) * _unit_score(near, s, e, decoded, chain, set()), _SURE if all(x in _LETTERS or x in _MARKS for x in decoded if x > "\x7f") and any(_latin(x) for x in near) else 0.0)
        elif len(chain) == 1:
            table = _bytes_of(codec)
            byte = lambda k: (table.get(near[k]) or b"\0")[0] if 0 <= k < len(near) else 0
            if byte(i) >= 0xC2 and 0x80 <= byte(i + 1) <= 0xBF or 0x80 <= byte(i) <= 0xBF and byte(i - 1) >= 0x80:
                gain = max(gain, _FIT + 2 * _DEEP)
    for written, read in PAIRS_READ_AS:
        for s in (i - 1, i):
            if s >= 0:
                for at, _, decoded in _pair_units(near, [s], written, read):
                    gain = max(gain, _pair_score(near, at, decoded, written) or 0.0)
    for written, read in BYTES_READ_AS:
        stands = _stands_for(written, read).get(c)
        if stands and _fits(near, i, stands):
            gain = max(gain, _strange(near, i, stands, True), _strange(near, i, stands, False))
    return gain


def _suspect(text: str) -> bool:
    """Whether label() can find anything in ``text``: False only where no path can gain _LEAST."""
    total = 0.0
    for m in _telling().finditer(text):
        i = m.start()
        total += _bound(text[max(0, i - 2) : i + 4], min(i, 2))
        if total >= _LEAST:
            return True
    return False


def _class(chars: list[str]) -> str:
    """A character class as ranges."""
    out: list[list[int]] = []
    for o in sorted({ord(c) for c in chars}):
        if out and out[-1][1] == o - 1:
            out[-1][1] = o
        else:
            out.append([o, o])
    return "".join(re.escape(chr(a)) + (f"-{re.escape(chr(b))}" if b > a else "") for a, b in out)


def words_after_dashes(documents: DataFrame, text_column: str = "text") -> dict[str, float]:
    """The logarithm of how much likelier a word is after a dash than elsewhere, within _SHIFT, counted
    over all texts, for the words that follow a replacement character between spaces somewhere; no
    others are asked for.  Empty if no word follows a dash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, dashed, asked = Counter(), Counter(), Counter()

        def counted() -> pa.RecordBatch:
            seen = list(words)
            out = pa.RecordBatch.from_arrays([pa.array(seen, pa.string()), *(pa.array([c[w] for w in seen], pa.int64()) for c in (words, dashed, asked))], names=["w", "n", "d", "q"])
            for c in (words, dashed, asked):
                c.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                lower = text.lower()
                words.update(_WORD.findall(lower))
                if "–" in lower or "—" in lower:
                    dashed.update(_DASHED.findall(lower))
                if "�" in text:
                    # as _lost() reads them
                    found = [w.lower() for w in _ASKED.findall(text)]
                    asked.update(found)
                    words.update(dict.fromkeys(found, 0))
                if len(words) > _COUNTED:
                    yield counted()
        yield counted()

    texts = documents.select(F.col(text_column).alias("t")).filter("t <> ''")
    told = by_batch(texts, count, "w string, n long, d long, q long").groupBy("w").agg(*(F.sum(c).alias(c) for c in "ndq"))
    told = cut_lineage(told)
    n, d = told.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("d"), F.lit(0))).first()
    if not d:
        return {}
    told = told.filter("q > 0").select("w", (F.log(F.col("d") / F.lit(float(d))) - F.log(F.col("n") / F.lit(float(n)))).alias("r")).toArrow()
    return {w: -_SHIFT if r is None else max(-_SHIFT, min(_SHIFT, r)) for w, r in zip(*(c.to_pylist() for c in told.columns))}


def garbled_texts(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, spans, restored, whole`` for each text with a garbled passage.

    ``spans`` lists (start, end, pair, restored) in code points, ``restored`` is the text with
    every span put right that can be, ``whole`` tells whether all were.  Null, empty and sound
    texts give no row; repeated rows give repeated rows; texts are read whole; other columns are
    not read.  Texts in ASCII don't leave the JVM.
    """
    kind = documents.schema[id_column].dataType.simpleString()
    follows = words_after_dashes(documents, text_column)
    fields = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("pair", pa.string()), ("restored", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, spans, fixed, whole = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = label(text, follows) if _suspect(text) else []
                if found:
                    rows.append(i)
                    spans.append([{"start": s.start, "end": s.end, "pair": s.pair, "restored": s.restored} for s in found])
                    fixed.append(restored_text(text, found))
                    whole.append(all(s.restored is not None for s in found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(spans, pa.list_(fields)), pa.array(fixed, pa.string()), pa.array(whole, pa.bool_())],
                names=["doc_id", "spans", "restored", "whole"],
            )

    given = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("t")).filter(F.col("t").rlike(r"[^\x{0}-\x{7f}]"))
    return by_batch(given, run, f"doc_id {kind}, spans array<struct<start int, end int, pair string, restored string>>, restored string, whole boolean")
