"""Secret scans: base spans and their digest against a matcher without regular expressions; long texts; names."""

import hashlib
import random

from annotara.llm import secret_scan

VALUE = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def assign_at(t, low, i):
    """(end of the match, length of its value) or None."""
    for w in WORDS:
        if not low.startswith(w, i):
            continue
        k = i + len(w)
        k += t[k : k + 1] in ("'", '"') and k < len(t)
        while t[k : k + 1] == " ":
            k += 1
        if t[k : k + 1] not in (":", "=") or k >= len(t):
            continue
        k += 1
        while t[k : k + 1] == " ":
            k += 1
        k += t[k : k + 1] in ("'", '"') and k < len(t)
        e = k
        while e < len(t) and t[e] in VALUE:
            e += 1
        if e > k:
            return e, e - k
    return None


def brute(t):
    out, low, i = [], ascii_lower(t), 0
    while i < len(t):
        if m := assign_at(t, low, i):
            if m[1] >= 6:
                out.append((i, 0, m[0], "assign"))
            i = m[0]
        else:
            i += 1
    i = 0
    while (i := t.find("AKIA", i)) >= 0:
        e = i + 4
        while e < len(t) and (t[e].isascii() and (t[e].isdigit() or t[e].isupper())):
            e += 1
        if e > i + 4 and e - i >= 20:
            out.append((i, 1, e, "access"))
        i = e if e > i + 4 else i + 1
    i = 0
    while i < len(t):
        e = i
        while e < len(t) and t[e] in "0123456789abcdef":
            e += 1
        if e - i >= 24:
            out.append((i, 2, e, "hex"))
        i = max(e, i + 1)
    return [(a, b, k) for a, _, b, k in sorted(out)]


def texts(n):
    rng = random.Random(12)
    parts = [*WORDS, "PASSWORD", "ApiKey", "API_KEY", "ſecret", "toKen", "Token", ":", "=", " = ", ":  ", "'", '"', " ", "\n", "AKIA", "AKIAAKIA", "ABCDEF0123456789", "deadbeef", "é", "日本", "x/y+z", "==", "...", "zz-9_", "²", "١٢٣", "0"]
    return ["".join(rng.choice(parts) * rng.choice((1, 1, 1, 3)) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_base_spans_equal_brute_force():
    found = 0
    for t in texts(20_000):
        want = brute(t)
        got = [s for s in secret_scan.scan(t) if s[2] != "entropy"]
        assert got == want, t
        found += len(want)
    assert found > 4_000


def test_query_writes_the_base_spans(spark):
    own = [*texts(400), None, "", "token=" + "a1b2" * 300_000 + " AKIA" + "Z" * 500_000 + " " + "0f" * 100_000]
    rows = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate([*own, own[3], own[3]])], "doc_id long, text string, n_hex int, base_sha256 string")
    got = {(r.doc_id): r for r in secret_scan.query(rows).collect()}
    for i, t in enumerate([*own, own[3], own[3]]):
        want, r = brute(t or ""), got[i]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for *_, k in want) for x in ("assign", "access", "hex")]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in want).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("entropy")] == [f"{k}:{a}:{b}" for a, b, k in want]
