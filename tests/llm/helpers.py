"""A small table of awkward documents, and plain versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, value string, __doc long, token string"


def rows() -> list[tuple]:
    """Nulls, empty, tiny, long, repeated and nearly repeated texts; columns whose names operators use themselves."""
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice(["th", "er", "on", "an", "é", "st", "ing", "ß"]) for _ in range(rnd.randint(1, 4)))
    prose = lambda n: "".join(word() + rnd.choice([" "] * 9 + [".\n"]) for _ in range(n))
    passage, base, long = prose(60), prose(150), prose(4000)
    texts = [None, "", " \n ", "one", "one", "One  two\tthree", "a b c d", "A B C d", prose(80), passage, prose(90) + passage + prose(70), passage + prose(200), base, base, base]
    for k in range(8):
        words = base.split(" ")
        for _ in range(k):
            words[rnd.randrange(len(words))] = word()
        texts.append(" ".join(words))
    texts += [long, long[: len(long) // 2] + prose(300), "x" * 700, "ab" * 400, "  double  spaces  ", "mail me.27@mail5.example.com or +1 (136) 555-7479, 4785380592391139 at 70.23.22.57 " + prose(60), "日本語 " * 60, "boiler plate line here\n" + prose(60), "boiler plate line here\nboiler plate line here\n" + prose(70), "### $$$ %%% " * 60, prose(60) + "<|endoftext|>" + prose(10)]
    out = [(k, t, "en", f"src{k % 6}" if k % 7 else None, len(t or ""), k, "v", -k, "t") for k, t in enumerate(texts)]
    return [*out, out[12], out[3]]


def table(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(5)


def docs() -> list[tuple[int, str]]:
    """(doc_id, text with null as empty), repeated rows included."""
    return [(r[0], r[1] or "") for r in rows()]


def plain_components(pairs: list[tuple[int, str]], n: int = 5, percent: int = 75) -> tuple[dict[int, int], dict[int, int]]:
    sets: dict[int, set] = {}
    for k, text in pairs:
        w = text.encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()
        sets[k] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    up = {k: k for k in sets}

    def of(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = of(a), of(b)
                up[max(x, y)] = min(x, y)
    return {k: len(s) for k, s in sets.items()}, {k: of(k) for k in sets}


def plain_repeats(pairs: list[tuple[int, str]], length: int = 100) -> dict[int, tuple]:
    seen, out = set(), {}
    for k, text in sorted(dict(pairs).items()):
        raw = text.encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            part = raw[s : s + length]
            if part in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(part)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out[k] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def plain_quality(text: str) -> tuple:
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams: dict = {}
    for j in range(len(w) - 2):
        grams.setdefault(tuple(w[j : j + 3]), []).append(j)
    repeated = {i for at in grams.values() if len(at) > 1 for j in at for i in (j, j + 1, j + 2)}
    failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(repeated), failed
