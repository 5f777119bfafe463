"""Secret spans and links against plain loops with Python patterns."""

import random
import re

from trustloom.llm import secrets

PATTERNS = {
    0: re.compile("(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
    1: re.compile("AKIA[A-Z0-9]+"), 2: re.compile("[0-9a-f]+"),
    3: re.compile("(?i:username|user|login|account|client_?id)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._@-]{3,}"), 4: re.compile("[A-Za-z0-9+/_=-]{20,}"),
    5: re.compile("[A-Za-z][A-Za-z0-9+]{1,9}://[A-Za-z0-9._-]+")}
COLUMNS = "doc_id bigint, text string, id string, rid int, base string, weak string, start int, scope int"


def brute_secrets(text):
    """Base spans and linked spans of a text."""
    spans = {k: [(m.start(), k, m.end()) for m in p.finditer(text)] for k, p in PATTERNS.items()}
    spans[0] = [(m.start(), 0, m.end()) for m in PATTERNS[0].finditer(text) if len(m[1]) >= 6]
    spans[1] = [s for s in spans[1] if s[2] - s[0] >= 20]
    spans[2] = [s for s in spans[2] if s[2] - s[0] >= 24]
    spans[4] = [s for s in spans[4] if all(re.search(p, text[s[0]:s[2]]) for p in ("[0-9]", "[A-Z]", "[a-z]"))]
    base = sorted(s for k in range(3) for s in spans[k])
    cuts = [m.start() for m in re.finditer("\n[\x20\t\r]*\n", text)]
    scopes = {}
    for s in {x for own in spans.values() for x in own}:
        scopes.setdefault(sum(c <= s[0] for c in cuts), []).append(s)
    linked = []
    for own in scopes.values():
        own.sort()
        sure = [b for b in own if b[1] <= 2]
        weak = [s for s in own if s[1] > 2 and not any(b[0] < s[2] and b[2] > s[0] for b in sure)]
        held = {}
        for o in sure + weak:
            role = "identifier" if o[1] in (1, 3) else "endpoint" if o[1] == 5 else "secret"
            held[role] = held.get(role, 0) + 1
        for s in weak:
            role = {3: "identifier", 4: "secret", 5: "endpoint"}[s[1]]
            others = {r for r, n in held.items() if n > (r == role)}
            if s[1] == 3 and "secret" in others or s[1] == 4 and others & {"identifier", "endpoint"} or s[1] == 5 and {"identifier", "secret"} <= others:
                linked.append(s)
    return base, sorted(linked)


def test_secrets_equal_brute_force(spark):
    draw = random.Random(9)
    bits = ["password=hunter22", "Token : 'abc'", "api_key=abcdefgh", "AKIA" + "Q7" * 9, "AKIAQQ", "deadbeef" * 3, "c0ffee", "user: someone1", "client_id=ab12", "Abc" + "k9" * 12,
            "https://db.example.org/x", "ftp://h", "é漢 words", "\n", "\n\n", "\n \t\n", "...", "secret=token=aaaaaa", "x" * 30, "0123456789abcdefABCDEF99"]
    texts = ["".join(draw.choice(bits) + draw.choice([" ", " ", "\n", ",", ""]) for _ in range(draw.choice([0, 1, 4, 12, 40]))) for _ in range(150)] + [None, ""]
    texts += [" ".join(draw.choice(bits) for _ in range(4_000)), "word " * 200_000 + "user: someone1 " + "Abc" + "k9" * 12, texts[3], texts[3]]
    rows = [(None if i % 40 == 7 else i % 140, t, "x", 1, "y", "z", 2, 3) for i, t in enumerate(texts)]
    found = secrets.secret_spans(spark.createDataFrame(rows, COLUMNS).repartition(5), reach=None).collect()

    def shown(key, base, linked):
        return str((key, sorted(base), sorted(linked)))
    got = sorted(shown(r.id, [(s.start, s.rank, s.stop) for s in r.base], [(s.start, s.rank, s.stop) for s in r.linked]) for r in found)
    want = sorted(shown(r[0], *brute_secrets(r[1] or "")) for r in rows)
    assert [x for x in got if x not in want][:2] == [x for x in want if x not in got][:2] == [] and len(got) == len(want)
    assert any(r.linked for r in found)
