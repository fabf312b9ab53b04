"""A structural index of JSON texts, built for many texts at once with numpy.

The bytes of a chunk of texts lie in one array.  Bitmaps of quotes, escapes and delimiters come
from comparisons, string interiors from the parity of a prefix sum over quotes, nesting depth from
a prefix sum over brackets, and the enclosing container of every token from a stable sort by depth.
Validity is decided on pairs of neighbouring tokens, so no text is parsed twice.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

#: Bytes indexed at once; the working arrays take about forty times as much memory.
CHUNK_BYTES = 2 << 20

_NONE, _OBJ, _OBJ_END, _ARR, _ARR_END, _COLON, _COMMA, _STR, _SCALAR = range(9)
_KIND = np.zeros(256, dtype=np.int8)
for _byte, _kind in (("{", _OBJ), ("}", _OBJ_END), ("[", _ARR), ("]", _ARR_END), (":", _COLON), (",", _COMMA)):
    _KIND[ord(_byte)] = _kind
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0D]] = True
_HEX = np.zeros(256, dtype=bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True
_ESCAPE = np.zeros(256, dtype=bool)
_ESCAPE[list(b'"\\/bfnrtu')] = True
_LITERAL = re.compile(rb"(?:true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)\Z")


@dataclass
class Index:
    """Tokens of the valid texts of one chunk, in order."""

    data: bytes
    text: np.ndarray  # number of the text of each token
    kind: np.ndarray
    start: np.ndarray  # offset in data
    end: np.ndarray  # offset after a string or scalar
    parent: np.ndarray  # token that opens the enclosing container, or -1
    place: np.ndarray  # position among the members of that container
    is_key: np.ndarray
    valid: np.ndarray  # by text


def build(texts: Sequence[bytes]) -> Index:
    """Index ``texts``; the tokens of texts that aren't valid JSON (RFC 8259) are left out."""
    data = b"\n".join(texts) + b"\n"
    a = np.frombuffer(data, dtype=np.uint8)
    sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    first = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    idx = np.arange(len(a), dtype=np.int64)
    valid = np.ones(len(texts), dtype=bool)

    slash = a == 0x5C
    if slash.any():
        run = idx - np.maximum.accumulate(np.where(slash, -1, idx))
        escaper = slash & (run % 2 == 1)
        escaped = np.zeros(len(a), dtype=bool)
        escaped[1:] = escaper[:-1]
    else:
        escaper = escaped = slash
    quote = (a == 0x22) & ~escaped
    count = np.cumsum(quote)
    base = np.where(first > 0, count[first - 1], 0)
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    inside = ((count - base[owner]) & 1).astype(bool)  # opening quotes and string interiors
    last = first + sizes
    valid &= ~inside[last]
    valid[owner[inside & (a < 0x20)]] = False
    at = idx[escaper & inside]
    if len(at):
        after = a[at + 1]
        valid[owner[at[~_ESCAPE[after]]]] = False
        uni = at[after == 0x75]
        if len(uni):
            fine = np.ones(len(uni), dtype=bool)
            for k in range(2, 6):
                fine &= _HEX[a[np.minimum(uni + k, len(a) - 1)]]
            valid[owner[uni[~fine]]] = False

    kind = np.where(inside, 0, _KIND[a]).astype(np.int8)
    opening = quote & inside
    kind[opening] = _STR
    loose = ~inside & ~quote & (kind == 0) & ~_BLANK[a]
    begins = loose.copy()
    begins[1:] &= ~loose[:-1]
    kind[begins] = _SCALAR
    keep = (kind > 0) & valid[owner]
    pos = idx[keep]
    kind, text = kind[pos], owner[pos]

    up = (kind == _OBJ) | (kind == _ARR)
    down = (kind == _OBJ_END) | (kind == _ARR_END)
    step = up.astype(np.int64) - down
    after = np.cumsum(step)
    counts = np.bincount(text, minlength=len(texts))
    head = np.cumsum(counts) - counts
    valid &= counts > 0
    some = np.flatnonzero(counts > 0)
    before = after - step
    offset = np.zeros(len(texts), dtype=np.int64)
    offset[some] = before[head[some]]
    after, before = after - offset[text], before - offset[text]
    valid[text[after < 0]] = False
    tail = head[some] + counts[some] - 1
    valid[some[after[tail] != 0]] = False
    keep = valid[text]
    pos, kind, text, up, down, after, before = (x[keep] for x in (pos, kind, text, up, down, after, before))

    n = len(pos)
    # a container stands at the depth it opens, everything else at the depth it lies in
    level = np.concatenate((before, after[up]))
    who = np.concatenate((np.arange(n), np.flatnonzero(up)))
    opens = np.concatenate((np.zeros(n, dtype=bool), np.ones(int(up.sum()), dtype=bool)))
    order = np.lexsort((opens, who, level))
    who, opens = who[order], opens[order]
    seat = np.maximum.accumulate(np.where(opens, np.arange(len(who)), -1))
    comma = np.cumsum((kind[who] == _COMMA) & ~opens)
    parent, place = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64)
    child = ~opens
    seats = seat[child]
    held = np.where(seats >= 0, who[np.maximum(seats, 0)], -1)
    held[level[order][child] == 0] = -1
    parent[who[child]] = held
    place[who[child]] = comma[child] - np.where(seats >= 0, comma[np.maximum(seats, 0)], 0)

    box = np.where(parent >= 0, kind[np.maximum(parent, 0)], _NONE)
    new = np.ones(n, dtype=bool)
    new[1:] = text[1:] != text[:-1]
    prev = np.concatenate(([_NONE], kind[:-1])) if n else kind
    prev = np.where(new, _NONE, prev)
    prev_box = np.concatenate(([_NONE], box[:-1])) if n else box
    is_key = (kind == _STR) & ((prev == _OBJ) | ((prev == _COMMA) & (box == _OBJ)))
    after_key = np.concatenate(([False], is_key[:-1])) & ~new if n else is_key
    value = (kind == _OBJ) | (kind == _ARR) | (kind == _STR) | (kind == _SCALAR)
    closes = ((kind == _OBJ_END) & (box == _OBJ)) | ((kind == _ARR_END) & (box == _ARR))
    good = np.select(
        [prev == _NONE, prev == _OBJ, prev == _ARR, prev == _COLON, prev == _COMMA, after_key],
        [
            value,
            is_key | (kind == _OBJ_END),
            value | (kind == _ARR_END),
            value,
            np.where(prev_box == _OBJ, is_key, value & (prev_box == _ARR)),
            kind == _COLON,
        ],
        default=((kind == _COMMA) & (box != _NONE)) | closes,
    )
    valid[text[~good]] = False
    ends = np.flatnonzero(np.concatenate((new[1:], [True]))) if n else np.zeros(0, dtype=np.int64)
    valid[text[ends[~(value[ends] | down[ends]) | is_key[ends]]]] = False

    end = pos + 1
    strings = np.flatnonzero(kind == _STR)
    closing = idx[quote & ~inside]
    end[strings] = closing[np.searchsorted(closing, pos[strings])] + 1
    edge = idx[~loose]
    scalars = np.flatnonzero(kind == _SCALAR)
    end[scalars] = edge[np.searchsorted(edge, pos[scalars])]
    known: dict[bytes, bool] = {}
    for t, s, e in zip(text[scalars].tolist(), pos[scalars].tolist(), end[scalars].tolist()):
        raw = data[s:e]
        fine = known.get(raw)
        if fine is None:
            fine = known[raw] = _LITERAL.match(raw) is not None
        if not fine:
            valid[t] = False
    return Index(data, text, kind, pos, end, parent, place, is_key, valid)


def _string(raw: bytes) -> str:
    if b"\\" not in raw:
        return raw[1:-1].decode("utf-8", "replace")
    return json.loads(raw.decode("utf-8", "replace"))


def _may_hold(raw: bytes) -> bool:
    """Whether a string token could hold an object or array: by its first character."""
    return len(raw) > 3 and raw[1] in b"{[ \\"


Node = tuple[int, str, str | None, int | None, list[tuple[str, str | None]] | None]


def nodes(texts: Sequence[bytes], fields: bool = False) -> Iterator[Node]:
    """Objects of ``texts`` as (number of the text, path, path of the nearest enclosing object or
    None for the root itself, place if a list member, scalar fields if asked for).

    A string that holds a valid object or array counts as that value, at any depth of such nesting.
    """
    # (text number, path, path of the nearest object, whether it is the body itself, place)
    queue: list[tuple[int, str, str, bool, int | None]] = [(i, "", "", True, None) for i in range(len(texts))]
    pending = list(texts)
    while pending:
        later: list[bytes] = []
        later_queue: list[tuple[int, str, str, bool, int | None]] = []
        at = 0
        while at < len(pending):
            upto, size = at, 0
            while upto < len(pending) and (upto == at or size + len(pending[upto]) <= CHUNK_BYTES):
                size += len(pending[upto])
                upto += 1
            yield from _emit(build(pending[at:upto]), queue[at:upto], fields, later, later_queue)
            at = upto
        pending, queue = later, later_queue


def _emit(ix: Index, origin: list, fields: bool, later: list, later_queue: list) -> Iterator[Node]:
    kind, data = ix.kind, ix.data
    live = ix.valid[ix.text]
    containers = live & ((kind == _OBJ) | (kind == _ARR))
    values = live & (kind == _STR) & ~ix.is_key
    leaves = values | (live & (kind == _SCALAR)) if fields else values
    path: dict[int, str] = {}
    near: dict[int, str] = {}
    inner: dict[int, list[tuple[str, str | None]]] = {}
    out: list[tuple[int, str, str | None, int | None, int]] = []
    pick = np.flatnonzero(containers | leaves)
    for i, t, k, s, e, p, place in zip(pick.tolist(), ix.text[pick].tolist(), kind[pick].tolist(), ix.start[pick].tolist(), ix.end[pick].tolist(), ix.parent[pick].tolist(), ix.place[pick].tolist()):
        number, top, top_near, is_body, top_place = origin[t]
        held = None
        if k == _STR:
            raw = data[s:e]
            if _may_hold(raw) or (p < 0 and is_body):
                held = _string(raw)
                if held.strip(" \t\r\n")[:1] not in ("{", "["):
                    held = None
            if held is None and not fields:
                continue
        elif k == _SCALAR and p < 0:
            continue
        if p < 0:
            own, outer, where = top, top_near, top_place
        elif kind[p] == _OBJ:
            key = _string(data[ix.start[i - 2] : ix.end[i - 2]])
            own, outer, where = (f"{path[p]}.{key}" if path[p] else key), path[p], None
        else:
            own, outer, where = f"{path[p]}[{place}]", near[p], place
        if k == _OBJ:
            path[i], near[i] = own, own
            inner[i] = []
            out.append((number, own, None if is_body and p < 0 else outer, where, i))
        elif k == _ARR:
            path[i], near[i] = own, outer
        else:
            if held is not None:
                sub = held.encode("utf-8", "surrogatepass").decode("utf-8", "replace").encode()
                if bool(build([sub]).valid[0]) if fields else True:
                    later.append(sub)
                    later_queue.append((number, own, outer, is_body and p < 0, where))
                    continue
            if p < 0:
                continue
            home = p
            while home >= 0 and kind[home] != _OBJ:
                home = int(ix.parent[home])
            if home >= 0:
                start = len(path[home]) + 1 if path[home] else 0
                value = _string(data[s:e]) if k == _STR else data[s:e].decode()
                inner[home].append((own[start:], None if value == "null" and k == _SCALAR else value))
    for number, own, outer, where, i in out:
        yield number, own, outer, where, inner[i] if fields else None


Leaf = tuple[str, list[str], bool, bool, str]


def strings(texts: Sequence[bytes]) -> list[list[Leaf] | None]:
    """The strings of each text in order as (path, keys, whether the last key is the string's own,
    whether it lies in a blob, value); None for texts that aren't JSON.

    Unlike :func:`nodes`, a string that holds JSON stays a string.
    """
    out: list[list[Leaf] | None] = []
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto]) <= CHUNK_BYTES):
            size += len(texts[upto])
            upto += 1
        out += _leaves(build(texts[at:upto]))
        at = upto
    return out


def _leaves(ix: Index) -> list[list[Leaf] | None]:
    kind, data, parent = ix.kind, ix.data, ix.parent
    out: list[list[Leaf] | None] = [[] if ok else None for ok in ix.valid.tolist()]
    live = ix.valid[ix.text]
    value = live & (kind == _STR) & ~ix.is_key
    pick = np.flatnonzero(value | live & ((kind == _OBJ) | (kind == _ARR)))
    # of each container: its path and keys; objects that a member names a blob
    path: dict[int, tuple[str, list[str]]] = {}
    under = np.flatnonzero(value & (parent >= 0))
    under = under[kind[parent[under]] == _OBJ]
    blobs = {int(parent[i]) for i in under.tolist() if data[ix.start[i] : ix.end[i]] == b'"blob"' and data[ix.start[i - 2] : ix.end[i - 2]] == b'"$type"'}
    held: set[int] = set()
    for i, t, k, s, e, p in zip(pick.tolist(), ix.text[pick].tolist(), kind[pick].tolist(), ix.start[pick].tolist(), ix.end[pick].tolist(), parent[pick].tolist()):
        own = False
        if p < 0:
            here: tuple[str, list[str]] = ("", [])
        elif kind[p] == _OBJ:
            key, own = _sound(data[ix.start[i - 2] : ix.end[i - 2]]), True
            above, keys = path[p]
            here = (f"{above}.{key}" if above else key, [*keys, key])
        else:
            here = (f"{path[p][0]}[]", path[p][1])
        if k == _STR:
            out[t].append((*here, own, p in held, _sound(data[s:e])))
        else:
            path[i] = here
            if p in held or i in blobs:
                held.add(i)
    return out


def _sound(raw: bytes) -> str:
    """The value of a string token; halves of surrogate pairs become replacement characters."""
    text = _string(raw)
    return text.encode("utf-8", "surrogatepass").decode("utf-8", "replace") if b"\\u" in raw else text
