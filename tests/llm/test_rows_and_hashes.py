"""Rows that share an id, null ids, and texts that defeat weak hashes."""

import hashlib
import random
from fractions import Fraction

import numpy as np
import pytest
from helpers import SCHEMA, plain_components, plain_quality, rows, table

from xdoc.llm import common, jaccard, linededup, matroska, quality, suffixdedup


def thue_morse(order: int, a: str = "a", b: str = "b") -> tuple[str, str]:
    """Two strings that collide under any polynomial modulo 2 ** 64 from an order of about ten."""
    x, y = a, b
    for _ in range(order):
        x, y = x + y, y + x
    return x, y


def docs(data):
    """(id, text, site) as a table of documents."""
    return [(k, t, "en", site, len(t or ""), 0, "v", 0, "t") for k, t, site in data]


def test_span_hashes_tell_thue_morse_strings_apart():
    for order in (9, 10, 11, 13):
        x, y = thue_morse(order)
        data = np.frombuffer((x + y + x).encode(), np.uint8)
        n = len(x)
        h = common.Spans(data).hash(np.array([0, n, 2 * n]), np.array([n, 2 * n, 3 * n]))
        assert h[0] == h[2] != h[1]
    rnd = np.random.default_rng(1).integers(0, 4, 3000, dtype=np.uint8)
    spans, seen = common.Spans(rnd), {}
    at = np.random.default_rng(2).integers(0, 2900, 4000)
    for a, h in zip(at.tolist(), spans.hash(at, at + at % 9).tolist(), strict=True):
        assert seen.setdefault(bytes(rnd[a : a + a % 9]), h) == h
    assert len(set(seen.values())) == len(seen)


def test_span_hashes_of_a_long_text():
    data = np.frombuffer(b"abcdefghij" * 900_000, np.uint8)  # past the bound from which terms are reduced
    starts = np.array([0, 10, 4_000_000, 8_999_000, 5])
    h = common.Spans(data).hash(starts, starts + 1000)
    assert h[0] == h[1] == h[2] == h[3] != h[4]


def test_quality_and_shingles_of_thue_morse_texts(spark):
    x, y = thue_morse(11)
    texts = [f"{x}\n{y}\nword", f"{x}\n{x}\nword", " ".join([x, y] * 40), "w1 w2 w3 w4 " + x, "w1 w2 w3 w4 " + y]
    data = table(spark, docs([(k, t, "s") for k, t in enumerate(texts)]))
    for r in quality.quality_features(data).collect():
        assert tuple(r)[1:7] == plain_quality(texts[r.doc_id])
    sizes, labels = plain_components(list(enumerate(texts)))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(data).collect()} == {k: (sizes[k], labels[k]) for k in sizes}


def test_filter_looks_no_further_than_it_must():
    asked = []

    class Watched(quality.Texts):
        def feature(self, name):
            if name not in self.found:
                asked.append((name, self.n))
            return super().feature(name)

        def subset(self, keep):
            got = super().subset(keep)
            return Watched(got.data, got.offsets, got.found)

    raw = [b"too short", b"# " * 60, b"plain words and more of them " * 3 + bytes(range(97, 123)) * 3]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    kept = quality.cascade(Watched(data, offsets), ["few_words", "symbols", "few_distinct"])
    assert not kept.any() and asked == [("n_words", 3), ("n_symbols", 1)]


@pytest.mark.parametrize("sites", [2, 3])
def test_lines_of_rows_that_share_an_id(spark, sites):
    shared = [(k, "shared boiler plate line", f"s{k}") for k in range(4)]
    data = shared + [(5, "shared boiler plate line\nown words of doc five", "x"), (5, "keep me please now\nshared boiler plate line", "x"), (None, "shared boiler plate line\nown of none", "y"), (None, "only here with none", "z"), (6, None, "q"), (6, "", None), (5, "shared boiler plate line\nown words of doc five", "x")]
    got = linededup.remove_boilerplate(table(spark, docs(data)), min_sites=sites)
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == sorted(
        [("0", "shared boiler plate line"), ("1", ""), ("2", ""), ("3", ""), ("5", "own words of doc five"), ("5", "own words of doc five"), ("5", "keep me please now"), ("None", "own of none"), ("None", "only here with none"), ("6", "None"), ("6", "")]
    )
    report = linededup.line_report(table(spark, docs(data)), min_sites=sites).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.n_removed) for r in report if r.doc_id in (5, None)) == [("5", 2, 1)] * 3 + [("None", 1, 0), ("None", 2, 1)]
    none = [(None, "a line without any id", f"s{k}") for k in range(5)]
    assert {r.text for r in linededup.remove_boilerplate(table(spark, docs(none)), min_sites=sites).collect()} == {"a line without any id"}


def plain_removed(data, length=100):
    """Kept bytes of each distinct (id, text), in the order of ids and of hashes where an id has several texts."""
    keys = sorted({(k is not None, k or 0, h, t) for k, t, h in data})
    seen, out = set(), {}
    for some, k, _, t in keys:
        raw = t.encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            part = raw[s : s + length]
            if part in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(part)
        out[(k if some else None, t)] = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
    return out


def test_repeats_of_rows_that_share_an_id(spark):
    rnd = random.Random(8)
    prose = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    p, u, v = prose(300), prose(300), prose(260)
    data = [(1, p), (2, p), (2, u), (2, v + p[:150] + u[20:180]), (None, v), (None, u[:140] + p), (None, u[:140] + p), (3, v), (3, v), (4, ""), (4, u)]
    df = table(spark, docs([(k, t, "s") for k, t in data]))
    hashes = {r.text: r.h for r in df.selectExpr("text", "xxhash64(text) AS h").distinct().collect()}
    want = plain_removed([(k, t, hashes[t]) for k, t in data])
    got = sorted((str(r.doc_id), r.n_bytes, r.kept_sha256, bytes(r.kept)) for r in suffixdedup.remove_repeats(df, keep_bytes=True).collect())
    assert got == sorted((str(k), len(t.encode()), hashlib.sha256(want[k, t]).hexdigest(), want[k, t]) for k, t in data)
    assert any(k == "2" and kept == b"" for k, _, _, kept in got) and len(want[2, u]) > 0


def test_timestamps_are_exact():
    payload = bytes(range(256)) * 9 * 70
    file = matroska.mux(payload)
    media = matroska.parse(file)
    assert [t for _, t, *_ in media.packets] == [int(Fraction(1_000_000_000 * 576 * k, 48_000)) for k in range(len(media.packets))]
    assert media.packets[-1][1] == 12_000_000 * (len(media.packets) - 1) and media.tracks[1]["default_duration"] == media.scale == 12_000_000
    per = matroska.FRAMES_PER_BLOCK * matroska.BLOCKS_PER_CLUSTER
    assert [c[0] for c in media.cues] == [12_000_000 * per * k for k in range(len(media.cues))]


def test_awkward_rows_have_the_tables_schema():
    assert len(rows()[0]) == len(SCHEMA.split(","))
