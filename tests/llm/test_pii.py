"""Coreference, keys, counts and awkward rows of surrogate generation against a plain version."""

import hashlib
import hmac
import re

from helpers import SCHEMA, rows, table
from pyspark.sql import functions as F

from xdoc.llm import pii

KEY = "a key for tests"


def replaced(spark, texts, **options):
    data = [(k, t) for k, t in enumerate(texts)]
    return {r[0]: r[1] for r in pii.replace_entities(spark.createDataFrame(data, "doc_id int, text string"), KEY, **options).collect()}


def test_names_without_their_title(spark):
    got = replaced(spark, ["Mr. John Smith came. Later John Smith left and Smith wrote. Smithson's and blacksmith stay, so does Johnny.", "John Smith is untitled here.", "Frau Müller-Lüdenscheidt, MÜLLER and Müller-Lüdenscheidt’s bag; Müller-Lüdenscheidt."])
    assert "Smith " not in got[0].replace("Smithson", "") and "John " not in got[0] and "Smithson's and blacksmith stay, so does Johnny." in got[0]
    words = re.findall(r"[\w'-]+", got[0])
    given, family = words[1], words[2]
    assert [given, family] == words[5:7] and words[9] == family and given in pii.GIVEN["m"]
    assert got[1] == "John Smith is untitled here."
    assert "MÜLLER" in got[2] and got[2].count("Lüdenscheidt") == 1  # ’s makes another word


def test_given_and_family_name_of_one_word(spark):
    got = replaced(spark, ["Mrs. Martin Dale met Mr. James Martin and Mr. Martin Ash. Martin left."])
    words = re.findall(r"\w+", got[0])
    assert words[-2] == words[6] and len({words[1], words[6], words[9]}) == 3  # without a title: the family name


def test_digests_are_hmacs(spark):
    df = spark.createDataFrame([("x",), ("a longer message é",)], "m string")
    for key in ("k", "k" * 300):
        for r in df.select("m", pii._hmac(key, F.col("m")).alias("d")).collect():
            assert r.d == hmac.new(key.encode(), r.m.encode(), hashlib.sha512).hexdigest()


def test_keys_change_surrogates(spark):
    data = spark.createDataFrame([(1, "call +1 (136) 555-7479 or 70.23.22.57")], "doc_id int, text string")
    one, again, other = (pii.replace_entities(data, k).first().text for k in ("a", "a", "b"))
    assert one == again != other


def test_awkward_table_against_a_plain_version(spark):
    long = ("plain words " * 9000 + "mail me@long.example.com now ") * 3
    data = [*rows(), (None, "call +1 (136) 555-7479", "en", "s", 1, 0, "v", 0, "t"), (None, "mail x.y@none.example.com", "en", "s", 1, 0, "v", 0, "t"), (7, "other text of id 7 at 70.23.22.57", "en", "s", 1, 0, "v", 0, "t"), (800, long, "en", "s", 1, 0, "v", 0, "t")]
    df = table(spark, data).withColumn("n_entities", F.lit("old")).withColumn("__matches", F.lit(1))
    got = pii.replace_entities(df, KEY, count="n_entities")
    assert got.columns == [*[c for c in df.columns if c != "n_entities"], "n_entities"]
    result = got.collect()
    assert len(result) == len(data) and len(SCHEMA.split(",")) == len(data[0])
    import regex

    pattern = regex.compile(pii.PATTERN)
    found = {m for r in data for m in pattern.findall(r[1] or "")}
    # each entity alone in a text of its own, in one table with all others: what it is replaced by there is what it is replaced by anywhere
    singles = sorted(found)
    alone = {r.doc_id: r.text for r in pii.replace_entities(table(spark, [*data, *((10_000 + k, e, "en", "s", 1, 0, "v", 0, "t") for k, e in enumerate(singles))]), KEY).collect() if r.doc_id is not None and r.doc_id >= 10_000}
    of = {e: alone[10_000 + k] for k, e in enumerate(singles)}
    assert all(of[e] != e for e in singles) and len(set(of.values())) == len(of)
    want = sorted((str(r[0]), str(None if r[1] is None else pattern.sub(lambda m: of[m.group()], r[1])), len(pattern.findall(r[1] or ""))) for r in data)
    assert sorted((str(r.doc_id), str(r.text), r.n_entities) for r in result) == want


def test_many_distinct_names_end(spark):
    names = spark.range(100_000).select(F.concat(F.lit("given_m:N"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("__entity"))
    got = pii.surrogates(names, KEY)
    assert got.count() == got.select("__surrogate").distinct().count() == 100_000
