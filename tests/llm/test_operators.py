import hashlib
import random
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from helpers import SCHEMA, docs, plain_components, plain_quality, plain_repeats, rows, table
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from xdoc.llm import bytebpe, jaccard, linededup, matroska, packing, pii, quality, suffixdedup, tokencount, toolcalls
from xdoc.llm.columnbwt import ColumnBwt
from xdoc.llm.components import components
from xdoc.llm.queries import REPLY
from xdoc.llm.setjoin import SetJoin

P = public_tokenizers.path
KEY = "a key for tests"
JSON, RANKS, PATTERN = P("byte_bpe_50k.json"), P("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


# ---------------------------------------------------------------- 1 media


def test_media_round_trip(spark):
    got = matroska.store_texts(table(spark), keep_file=True).collect()
    assert sorted(r.doc_id for r in got) == sorted(k for k, _ in docs())
    texts = dict(docs())
    for r in got:
        raw = texts[r.doc_id].encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        media = matroska.parse(bytes(r.media))
        assert media.error is None and matroska.read_payload(bytes(r.media), media) == payload
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest())


@pytest.mark.parametrize("kind", range(4))
def test_lacing(kind):
    rnd = random.Random(kind)
    for _ in range(50):
        sizes = [5] * 4 if kind == matroska.FIXED else [rnd.choice([0, 3, 254, 255, 256, 600, 70_000]) for _ in range(1 if kind == 0 else rnd.randint(1, 7))]
        frames = [bytes([rnd.randrange(256)]) * n for n in sizes]
        body = matroska.lace(frames, kind)
        assert [body[a:b] for a, b in matroska.laced(body, 0, len(body), kind)] == frames


def test_mux_lacings_unknown_sizes_cues_and_breaks(spark):
    payload = bytes(range(256)) * 9 * 70
    for kind in range(4):
        file = matroska.mux(payload, 576, kind)
        media = matroska.parse(file)
        assert matroska.read_payload(file, media) == payload and len(media.packets) == len(payload) // 576
        assert [c[2] for c in media.cues] == media.clusters and [p[1] for p in media.packets] == sorted(p[1] for p in media.packets)
    at = file.index(b"\x1f\x43\xb6\x75")
    live = file[: at + 4] + b"\x01" + b"\xff" * 7 + file[at + 12 :]  # a cluster of unknown size
    assert matroska.read_payload(live, matroska.parse(live)) == payload
    cut = matroska.parse(file[: len(file) // 2])
    assert cut.error and matroska.parse(b"").error and matroska.parse(b"\0\0").error
    files = spark.createDataFrame([(1, bytearray(file)), (2, None), (3, bytearray(b"junk"))], "k int, f binary")
    got = matroska.packet_table(files, "k", "f")
    assert got.where("key = 1").count() == len(payload) // 576 and got.where("key = 3").first().error and not got.where("key = 2").count()


# ---------------------------------------------------------------- 2 near duplicates


@pytest.mark.parametrize("block", [128, 3])
def test_components_of_shingle_sets(spark, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "KIN", min(jaccard.KIN, block))
    sizes, labels = plain_components(docs())
    got = jaccard.near_duplicates(table(spark)).collect()
    assert sorted(r.doc_id for r in got) == sorted(k for k, _ in docs())
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {k: (sizes[k], labels[k]) for k in sizes}


def test_borderline_group(spark):
    rnd = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    data = []
    for k in range(90):
        words = list(base)
        for _ in range(rnd.randint(0, 9)):
            words[rnd.randrange(120)] = f"x{rnd.random()}"
        data.append((k, " ".join(words), None, None, None, 0, "", 0, ""))
    sizes, labels = plain_components([(r[0], r[1]) for r in data])
    got = jaccard.near_duplicates(table(spark, data)).collect()
    assert {r.doc_id: r.component_id for r in got} == labels


def test_set_join_against_all_pairs():
    rnd = random.Random(2)
    for trial in range(40):
        sets = []
        for _ in range(rnd.randint(1, 45)):
            if sets and rnd.random() < 0.7:
                own = set(rnd.choice(sets).tolist())
                for _ in range(rnd.randint(0, 8)):
                    own ^= {rnd.randrange(90)}
            else:
                own = {rnd.randrange(90) for _ in range(rnd.randint(1, 40))}
            sets.append(np.array(sorted(own), np.uint64))
        join = SetJoin(sets)
        join.run()
        labels = join.labels()
        up = list(range(len(sets)))

        def of(x):
            while up[x] != x:
                x = up[x]
            return x

        for a in range(len(sets)):
            for b in range(a):
                o = len(np.intersect1d(sets[a], sets[b]))
                if o and 100 * o >= 75 * (len(sets[a]) + len(sets[b]) - o):
                    x, y = of(a), of(b)
                    up[max(x, y)] = min(x, y)
        assert labels.tolist() == [of(k) for k in range(len(sets))]


def test_connected_components(spark):
    edges = [(k, k + 1) for k in range(0, 30)] + [(100, 101), (102, 101), (7, 7)]
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.v: r.label for r in got.collect()} == {**{k: 0 for k in range(31)}, 100: 100, 101: 100, 102: 100}


# ---------------------------------------------------------------- 3, 5, 6 tokens


def _fuzz() -> list[str]:
    rnd = random.Random(1)
    parts = ["a", "b", "e", "th", "the", " ", "  ", "\n", "▁", "é", "日", "\U0001f600", "<s>", "0", "12", "'s", "'ll", "\t", "\xa0", "#", "..", "ing", "\x00", "ß", "<|endoftext|>"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for _ in range(1500)] + ["a" * 3000, "ab" * 900, "日本" * 300, " " * 500, "thing" * 200, "\n" * 300]


def test_piece_counts_are_the_librarys():
    library = sentencepiece.SentencePieceProcessor(model_file=P("piece_bpe_32k.model"))
    counter = tokencount.PieceCounter.load(P("piece_bpe_32k.model"))
    texts = _fuzz() + [t for _, t in docs()]
    assert counter.count(texts) == [len(x) for x in library.encode(texts, num_threads=1)]


@pytest.mark.parametrize("size", (7, 1 << 18))
def test_piece_counts_of_long_pre_tokens(size, monkeypatch):
    monkeypatch.setattr(tokencount, "SLICE", size)
    library = sentencepiece.SentencePieceProcessor(model_file=P("piece_bpe_32k.model"))
    counter = tokencount.PieceCounter.load(P("piece_bpe_32k.model"))
    rnd = random.Random(2)
    pieces = [library.id_to_piece(k).strip("▁") for k in range(300, 20000)]
    texts = ["".join(rnd.choices(letters, k=n)) for letters in ("ab", "acgt", "-=_", "0123456789abcdef", "王李张é\U0001f9ea", pieces) for n in (1, 2, 3, 40, 5000)]
    assert counter.count(texts) == [len(x) for x in library.encode(texts, num_threads=1)]
    assert all(len(s) <= tokencount.LONG for s in counter.seen)


def test_piece_models_of_another_kind_are_refused(monkeypatch):
    monkeypatch.setattr(tokencount.PieceCounter, "count", lambda self, texts: [0])
    with pytest.raises(ValueError):
        tokencount.PieceCounter.load(P("piece_bpe_32k.model"))


def test_token_counts(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=P("piece_bpe_32k.model"))
    texts = dict(docs())
    for r in tokencount.token_counts(table(spark), P("piece_bpe_32k.model"), limit=100).collect():
        n = len(library.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 100)


def test_byte_bpe_is_tiktokens(spark):
    own = bytebpe.Encoder(bytebpe.Vocabulary.load(RANKS), PATTERN)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own.vocabulary.ranks, special_tokens={})
    for t in _fuzz():
        assert np.frombuffer(own.encode(t), "<u4").tolist() == library.encode_ordinary(t) and own.decode(own.encode(t)) == t.encode()
    texts = dict(docs())
    for r in bytebpe.encode_texts(table(spark), RANKS, PATTERN, keep_ids=True).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        raw = np.array(ids, "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256, bytes(r.ids)) == (len(ids), hashlib.sha256(raw).hexdigest(), raw)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def _mixed_spaces() -> list[str]:
    """Runs of spaces, no-break spaces and other white space."""
    rnd = random.Random(11)
    fixed = ["x \u00a0 \u00a0 y", "x \u00a0 \u00a0\ny", "a\n \nb", " \u00a0 ", "\u00a0 \u00a0x", "a \x1c \x1c b", "a\u2003 \u3000 b"]
    return fixed + ["".join(rnd.choice(["a", "the", "1", ".", " ", " ", "\u00a0", "\u00a0 ", " \u00a0", "\n", "\t", "\x1c", "\x85", "\u2003", "\u200b"]) for _ in range(rnd.randint(1, 14))) for _ in range(3000)]


def test_byte_bpe_between_white_space():
    own = bytebpe.Encoder(bytebpe.Vocabulary.load(RANKS), PATTERN)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own.vocabulary.ranks, special_tokens={})
    for t in _mixed_spaces():
        assert np.frombuffer(own.encode(t), "<u4").tolist() == library.encode_ordinary(t), t


def test_prefix_table_appends_and_edits():
    vocabulary, rnd = bytebpe.Vocabulary.load(RANKS), random.Random(4)
    for t in _fuzz()[:150]:
        raw = t.encode()[:150]
        at = bytebpe.PrefixTable(vocabulary, raw[:40])
        at.append(raw[40:])
        assert at.ids() == vocabulary.merge(raw) and at.ids(len(raw) // 2) == vocabulary.merge(raw[: len(raw) // 2])
        a = rnd.randint(0, len(raw))
        b, by = min(len(raw), a + rnd.randint(0, 5)), bytes(rnd.choice(b"abethng 01") for _ in range(rnd.randint(0, 6)))
        at.replace(a, b, by)
        assert at.last == bytebpe.PrefixTable(vocabulary, raw[:a] + by + raw[b:]).last
    text = b"the quick brown fox " * 200
    at = bytebpe.PrefixTable(vocabulary, text)
    assert at.replace(500, 503, b"abc") < 500  # falls back into step long before the end


def test_packing(spark):
    library = Tokenizer.from_file(JSON)
    texts = docs()
    want = sorted(tuple(library.encode(t, add_special_tokens=False).ids) + (1,) for _, t in texts)
    got = packing.pack(table(spark), JSON, PATTERN, length=256, group=8).toPandas()
    ids = {k: np.array(library.encode(t, add_special_tokens=False).ids + [1], np.uint32) for k, t in texts}
    for r in got.itertuples():
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    assert got.length.sum() == sum(map(len, want))
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
        n = g.length.sum()
        assert n <= 256 and n == g.sequence_tokens.iloc[0] and g.padding.iloc[0] == (0 if not n & (n - 1) else 256 - n)
    for k, g in got.sort_values("start").groupby("doc_id"):
        copies = sum(x == k for x, _ in texts)
        assert g.length.sum() == copies * len(ids[k])


def test_packing_tokenizer_on_both_sides_of_long():
    own, library = packing.Tokenizer(JSON, PATTERN), Tokenizer.from_file(JSON)
    for unit in ("x \u00a0 \u00a0 y", "the \u00a0 \u00a0\nquick\u2003 \n", ".".join(t for t in _mixed_spaces()[:400] if "  " not in t)):
        short = (unit * (packing.LONG // len(unit) + 1))[: packing.LONG - 1]
        for t in (short, short + short[:5000] + "z"):
            assert "  " not in t and own.ids(t).tolist() == library.encode(t, add_special_tokens=False).ids
    assert own.slow is not None


def test_packing_tokenizer_and_balance():
    own, library = packing.Tokenizer(JSON, PATTERN), Tokenizer.from_file(JSON)
    for t in _fuzz():
        assert own.ids(t).tolist() == library.encode(t, add_special_tokens=False).ids
    t = "the <|endoftext|> quick" * 6000
    assert len(t) > packing.LONG and own.ids(t).tolist() == library.encode(t, add_special_tokens=False).ids
    lengths = np.array(sorted((random.Random(3).randint(1, 2047) for _ in range(400)), reverse=True), np.int64)
    pieces, room = packing.place(lengths)
    assert sum(p[2] for p in pieces) == lengths.sum() == sum(room) and len(pieces) < 1.6 * len(lengths)
    assert packing.place(np.zeros(0, np.int64)) == ([], [])


# ---------------------------------------------------------------- 4 repeated strings


def test_repeated_strings(spark, monkeypatch):
    want = plain_repeats(docs())
    monkeypatch.setattr(suffixdedup, "COLLECTION_BYTES", 2000)
    got = suffixdedup.remove_repeats(table(spark)).collect()
    assert sorted(r.doc_id for r in got) == sorted(k for k, _ in docs())
    assert {r.doc_id: tuple(r)[1:] for r in got} == want


def test_column_transform():
    rnd = random.Random(3)
    for trial in range(60):
        strings = [bytes(rnd.choice(b"ab" if trial % 2 else b"abcd\xc3\x00") for _ in range(rnd.randint(0, 40))) for _ in range(rnd.randint(1, 12))]
        suffixes = sorted((s[len(s) - n :], i, n) for i, s in enumerate(strings) for n in range(len(s) + 1))
        symbols = [0 if n == len(strings[i]) else strings[i][len(strings[i]) - n - 1] + 1 for _, i, n in suffixes]
        common = [0] + [min(100, next((k for k, (x, y) in enumerate(zip(a[0], b[0], strict=False)) if x != y), min(len(a[0]), len(b[0])))) for a, b in zip(suffixes, suffixes[1:], strict=False)]
        with ColumnBwt(strings, 100, block=rnd.choice([7, 64, 1 << 20])) as t:
            got = t.read(t.total)
            assert got[0].tolist() == symbols and got[1].tolist() == common
            where = [(i, n) for _, i, n in suffixes]
            assert all(where[p] == (i, n) for n, (own, at) in enumerate(t.places()) for i, p in zip(own.tolist(), at.tolist(), strict=True))


# ---------------------------------------------------------------- 7 personal data


def test_surrogates(spark):
    data = [
        (1, "mail Ann.Lee.27@mail6.Example.com and ann.lee.27@mail6.example.com, call +1 (136) 555-7479 or 136-555-7479."),
        (2, "ip 70.23.22.57 éo card 4785380592391139 and 4111 1111 1111 1111; 4465758382889437 4465758382889437"),
        (3, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b9907f" api_key: AbC-123456789 24be64439e3e49cf46b2d7c90f3602a3d0b9907f'),
        (4, "Mr. John Smith met Mrs. Smith, Frau Müller and господин Иван Петров; Dr. Smith"), (5, None), (6, ""),
        (7, "no entity 1.2.3 12 3.14 v1.2.3.4.5 2024-01-02 Mister x"), (8, "IBAN DE89 3704 0044 0532 0130 00 ssn 123-45-6789 8.8.8.8."), (1, "again 70.23.22.57"), (None, "ann.lee.27@mail6.example.com"),
    ]
    got = [tuple(r) for r in pii.replace_entities(spark.createDataFrame(data, "doc_id int, text string"), KEY, count="n").collect()]
    of = {k: t for k, t, _ in got if k != 1}
    one = sorted(t for k, t, _ in got if k == 1)
    assert len(got) == len(data) and of[5] is None and of[6] == "" and of[7] == data[6][1]
    for secret in ("ann.lee", "Ann.Lee", "555-7479", "70.23.22.57", "4785380592391139", "4111", "24be64439e", "AbC-123456789", "Smith", "John", "Müller", "Петров", "3704", "123-45-6789", "8.8.8.8"):
        assert not any(secret in (t or "") for _, t, _ in got), secret
    mails = [w.strip(",") for w in one[1].split() if "@" in w]
    assert mails[0] == mails[1] == of[None] and mails[0].endswith(".com")
    assert one[0].split()[1] == of[2].split()[1]  # one address, one surrogate
    cards = [w for w in of[2].split() if w.isdigit() and len(w) == 16]
    assert cards[1] == cards[2] != cards[0]
    grouped = "".join(of[2].split(" and ")[1].split(";")[0].split())
    double = [2 * int(d) - (9 if int(d) > 4 else 0) if k % 2 == 0 else int(d) for k, d in enumerate(grouped)]
    assert len(grouped) == 16 and sum(double) % 10 == 0  # the Luhn property of the original
    tokens = of[3].replace('"', "").split()
    assert tokens[2] == tokens[-1] and len(tokens[2]) == 40 and set(tokens[2]) <= set("0123456789abcdef")
    names = of[4].replace(",", "").replace(";", "").split()
    assert names[0] == "Mr." and names[1] in pii.GIVEN["m"] and names[2] == names[5] == names[-1]
    assert names[names.index("господин") + 1] in pii.GIVEN["cm"]
    assert {k: n for k, _, n in got}[7] == 0 and {k: n for k, _, n in got}[8] == 3


def test_surrogates_stay_distinct_when_they_collide(spark):
    keys = spark.range(400).select(F.concat(F.lit("given_m:N"), F.col("id")).alias("__entity"))
    got = pii.surrogates(keys, KEY).collect()
    assert len({r["__surrogate"] for r in got}) == len(got) == 400


def test_surrogates_of_full_kinds(spark):
    of = lambda kind, n, start=0: spark.range(start, start + n).select(F.concat(F.lit(kind + ":"), F.format_string("N%d" if "_" in kind or kind == "family" else "%d", "id")).alias("__entity"))
    keys = of("given_m", 3000).union(of("given_f", 3000)).union(of("given_cm", 400)).union(of("family", 3000)).union(of("phone", 9000, 1000)).union(of("secret", 10).select(F.concat(F.lit("secret:_______"), F.substring("__entity", -1, 1))))
    got = pii.surrogates(keys, KEY).collect()
    assert len(got) == keys.count() == len({(r[0].split(":")[0], r[1]) for r in got})
    assert not {r[0] for r in got} & {r[0].split(":")[0] + ":" + r[1] for r in got}
    assert all(r[1].isalpha() for r in got if r[0].startswith("given"))


def test_surrogates_of_many_names_and_short_numbers(spark):
    word = lambda k: "".join("bcdfghklmn"[int(d)] for d in f"{k:04}")
    data = [(k, f"Mr. G{word(k)} F{word(k)} met Mrs. H{word(k)} F{word(k)}, +{10000 + k % 2000}.") for k in range(4000)]
    got = dict(map(tuple, pii.replace_entities(spark.createDataFrame(data, "doc_id int, text string"), KEY).collect()))
    assert len(got) == 4000
    words = [got[k].replace(",", "").rstrip(".").split() for k in range(4000)]
    for at, n in ((1, 4000), (2, 4000), (5, 4000), (7, 2000)):
        assert len({w[at] for w in words}) == n
    assert all(w[2] == w[6] and w[7].startswith("+1") for w in words)


def test_surrogates_of_lines_to_fill_in_and_other_scripts(spark):
    blank = "Password: ________ token = ---------- ---@---.com"
    scripts = {"홍길동@예시.한국": "HANGUL", "たろう@れい.みんな": "HIRAGANA", "タロウ@レイ.コム": "KATAKANA", "محمد@مثال.موقع": "ARABIC", "דוד@דוגמה.קום": "HEBREW", "ђорђе@пример.срб": "CYRILLIC", "արամ@օրինակ.հայ": "ARMENIAN", "สมชาย@ตวอยาง.ไทย": "THAI", "𐐨𐐩𐐪𐐫@𐐬𐐭𐐮𐐯.com": "DESERET"}
    data = [(0, blank), *enumerate(scripts, 1), (90, "Mr. Արամ Պետրոսյան"), (91, "٠١٢٣٤٥٦@٧٨٩.com"), (92, "password: ________7"), (93, "ª²º@ªª.com")]
    got = dict(map(tuple, pii.replace_entities(spark.createDataFrame(data, "doc_id int, text string"), key="k").collect()))
    assert len(got) == len(data) and got[0] == blank
    for k, (mail, script) in enumerate(scripts.items(), 1):
        assert got[k] != mail and len(got[k]) == len(mail) and got[k].rsplit(".")[-1] == mail.rsplit(".")[-1]
        assert all(a == b == "." or a == b == "@" or unicodedata.name(b).startswith(script) for a, b in zip(mail.rsplit(".", 1)[0], got[k], strict=False)), got[k]
        assert sum(a == b for a, b in zip(mail.split("@")[0], got[k], strict=False)) < len(mail.split("@")[0])
    assert all(unicodedata.name(c).startswith("ARMENIAN") for c in got[90].split()[2]) and got[90] != data[-4][1]
    assert got[91] != data[-3][1] and all(unicodedata.name(c).startswith("ARABIC-INDIC") for c in got[91].split("@")[0])
    assert got[92] != data[-2][1] and got[93] != data[-1][1]


def test_native_plans(spark):
    for df in (pii.replace_entities(table(spark), KEY), toolcalls.link(*toolcalls.turns_as_calls(spark.createDataFrame([(1, 0, "user", "x")], "conv_id int, turn int, role string, text string")), REPLY)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


# ---------------------------------------------------------------- 8 tool calls


def test_tool_calls(spark):
    call = '{"tool_calls":[{"id":"a","name":"add","arguments":{"y":2,"x":1}},{"id":"b","name":"add","arguments":{"x":"1"},"after":["a"]},{"id":"c","name":"nope","arguments":[1],"after":["b","gone"]}]}'
    data = [
        (1, 0, "user", "hi"), (1, 1, "assistant", call), (1, 2, "tool", '{"tool_call_id":"a","content":"3"}'), (1, 3, "tool", '{"tool_call_id":"a","content":"again"}'), (1, 4, "tool", '{"tool_call_id":"zzz","content":{"k":1}}'),
        (2, 0, "assistant", '{"tool_calls":[{"id":"p","name":"add","arguments":{"x":1,"y":2,"z":3},"after":["q"]},{"id":"q","name":"add","arguments":null,"after":["p"]}]}'), (2, 1, None, None), (2, 2, "user", ""), (3, None, "user", '{"broken'),
    ]
    df = spark.createDataFrame(data, "conv_id int, turn int, role string, text string")
    schema = {"add": {"x": ("integer", True), "y": ("integer", True)}}
    got = toolcalls.link(*toolcalls.parse_messages(df), schema).collect()
    by = {r.call_id: r for r in got if r.kind == "call"}
    assert by["a"].canonical == '{"arguments":{"x":1,"y":2},"id":"a","name":"add","result":"3"}' and (by["a"].status, by["a"].n_results, by["a"].level) == ("linked", 2, 0)
    assert (by["b"].status, by["b"].level, by["b"].errors) == ("invalid", 1, "missing y; type of x")
    assert (by["c"].level, by["c"].errors) == (2, "arguments are not an object") or by["c"].errors == "arguments are not an object"
    assert by["p"].level is None and by["p"].errors == "unknown z" and by["q"].level is None
    assert [r.canonical for r in got if r.kind == "orphan"] == ['{"id":"zzz","result":"{\\"k\\":1}"}']
    assert sorted(r.canonical for r in got if r.kind == "message") == ['{"content":"","role":"user"}', '{"content":"hi","role":"user"}', '{"content":"{\\"broken","role":"user"}', '{"content":null,"role":null}']
    assert toolcalls.link(*toolcalls.parse_messages(df.limit(0)), schema).count() == 0


# ---------------------------------------------------------------- 9 quality, 10 lines


def test_quality_counts_and_order(spark):
    texts = dict(docs())
    got = {}
    for order in (list(quality.RULES), list(quality.RULES)[::-1], None):
        rows_ = quality.quality_features(table(spark), order=order).collect()
        assert len(rows_) == len(docs())
        for r in rows_:
            assert tuple(r)[1:7] == plain_quality(texts[r.doc_id]) and not (r.kept and r.base_failed)
            assert got.setdefault(r.doc_id, r.kept) == r.kept
    kept = quality.quality_filter(table(spark))
    assert kept.columns == table(spark).columns and {r.doc_id for r in kept.collect()} == {k for k, v in got.items() if v}
    assert not got[32] and got[21]


def _plain_lines(pairs, min_sites, min_words=3):
    sites, first = {}, {}
    for k, text, site in pairs:
        for line in (text or "").split("\n") if text is not None else []:
            key = line.strip(" \t\n\x0b\x0c\r")
            if len(plain_words(key)) >= min_words:
                sites.setdefault(key, set()).update({site} - {None})
                first[key] = min(k, first.get(key, k))
    out = {}
    for k, text, _ in pairs:
        lines = text.split("\n") if text is not None else []
        kept = [x for x in lines if not (len(sites.get(key := x.strip(" \t\n\x0b\x0c\r"), ())) >= min_sites and first[key] != k)]
        out[k] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def plain_words(text):
    from helpers import WORD

    return WORD.findall(text)


@pytest.mark.parametrize("sites", [1, 2, 3, 6])
def test_line_dedup(spark, sites):
    want = _plain_lines([(r[0], r[1], r[3]) for r in rows()], sites)
    got = linededup.line_report(table(spark), min_sites=sites).collect()
    assert len(got) == len(rows())
    assert {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in got} == {k: (n, m, hashlib.sha256(t.encode()).hexdigest()) for k, (n, m, t) in want.items()}
    edited = linededup.remove_boilerplate(table(spark), min_sites=sites)
    assert edited.columns == table(spark).columns
    assert {r.doc_id: r.text for r in edited.collect()} == {r[0]: None if r[1] is None else want[r[0]][2] for r in rows()}


# ---------------------------------------------------------------- all


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for f in (matroska.store_texts, jaccard.near_duplicates, suffixdedup.remove_repeats, lambda d: pii.replace_entities(d, KEY), quality.quality_features, quality.quality_filter, linededup.line_report, linededup.remove_boilerplate):
        assert f(empty).count() == 0, f
    assert tokencount.token_counts(empty, P("piece_bpe_32k.model")).count() == bytebpe.encode_texts(empty, RANKS, PATTERN).count() == packing.pack(empty, JSON, PATTERN).count() == 0
