import json
import random

from vellumine.operators import structural


def walk(value, path="", near=None, body=True, out=None):
    out = [] if out is None else out
    if isinstance(value, str):
        try:
            inner = json.loads(value)
        except ValueError:
            return out
        if isinstance(inner, (dict, list)):
            walk(inner, path, near, body, out)
        return out
    if isinstance(value, dict):
        out.append((path, None if body else (near or "")))
        for k, v in value.items():
            walk(v, f"{path}.{k}" if path else k, path, False, out)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            walk(v, f"{path}[{i}]", near, False, out)
    return out


def make(r, depth=0):
    k = r.random()
    if depth > 4 or k < 0.3:
        return r.choice([None, True, 1, -2.5e3, "", "x", 'q"\\', "é\n", "{", "[1", "{}", "[[]]", '{"a": {"b": []}}', ' [{"c": 1}] ', "日本"])
    if k < 0.6:
        return {r.choice(["a", "b.c", 'k"', "", "ü", "z"]) + str(i): make(r, depth + 1) for i in range(r.randrange(4))}
    if k < 0.7:
        return json.dumps(make(r, depth + 1))
    return [make(r, depth + 1) for _ in range(r.randrange(4))]


def spoil(r, text):
    i = r.randrange(len(text) + 1)
    return r.choice([text[:i], text[:i] + r.choice('{}[],:"\\ 0x') + text[i:], text[:i] + text[i + 1 :]])


def readable(text):
    try:
        return json.loads(text, parse_constant=lambda x: 1 / 0)
    except (ValueError, ZeroDivisionError):
        return None


def test_nodes_equal_a_recursive_walk():
    r = random.Random(7)
    texts = []
    for _ in range(3000):
        t = json.dumps(make(r), ensure_ascii=r.random() < 0.5, separators=r.choice([(",", ":"), (", ", ": ")]))
        texts.append(spoil(r, t) if r.random() < 0.5 else t)
    got = {}
    for n, path, near, _, _ in structural.nodes([t.encode() for t in texts]):
        got.setdefault(n, []).append((path, near))
    for i, t in enumerate(texts):
        value = readable(t)
        want = [] if value is None else walk(value)
        assert sorted(got.get(i, []), key=str) == sorted(want, key=str), t


def test_validity_equals_the_standard_parser():
    r = random.Random(8)
    texts = [spoil(r, spoil(r, json.dumps(make(r)))) for _ in range(4000)] + ["", " ", "1 2", "{}{}", "[1,]", '{"a":}', '{"a" 1}', "[,1]", '{1:2}', "}", "]{", "nul", '"\\u12g4"', '"\t"', "[1}", '{"a":1]', ":", ",", '"a":1']
    ix = structural.build([t.encode() for t in texts])
    for t, v in zip(texts, ix.valid.tolist()):
        try:
            json.loads(t, parse_constant=lambda x: 1 / 0)
            want = True
        except (ValueError, ZeroDivisionError):
            want = False
        assert v == want, t


def test_fields_and_very_deep_text():
    text = b'{"a": 1, "tags": ["x", null], "o": {"s": "t\\u00e9"}, "e": "{\\"k\\": true}", "n": null}'
    got = {path: dict(members) for _, path, _, _, members in structural.nodes([text], fields=True)}
    assert got == {"": {"a": "1", "tags[0]": "x", "tags[1]": None, "n": None}, "o": {"s": "té"}, "e": {"k": "true"}}
    deep = b'{"a":' * 5000 + b"1" + b"}" * 5000
    assert sum(1 for _ in structural.nodes([deep])) == 5000
