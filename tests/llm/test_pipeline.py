import zlib

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from helpers import docs, plain_components, table
from tokenizers import Tokenizer

import __spark_entry__
from xdoc.llm import linededup, quality
from xdoc.llm.oracles import ORACLES

SF = "/root/testdata/sf0.001"


def test_stages_on_awkward_documents(spark):
    import public_tokenizers

    at, seen = table(spark), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, at, SF)
        assert new.columns == at.columns, name
        at = spark.createDataFrame(new.collect(), new.schema)
        seen.append({r.doc_id: r.text for r in at.collect()})
    kept = {r.doc_id for r in quality.quality_features(table(spark)).collect() if r.kept}
    assert set(seen[0]) == set(seen[1]) == kept
    _, label = plain_components([(k, t or "") for k, t in seen[1].items()])
    assert set(seen[2]) == {k for k in seen[1] if label[k] == k} == set(seen[3])
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = corpus_pipeline.STAGES[-1][1](spark, at, SF).toPandas()
    for k, t in seen[3].items():
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], np.uint32)
        own = pieces[pieces.doc_id == k].sort_values("start")
        assert own.length.sum() % len(ids) == 0
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own.itertuples())
    assert dict(docs())[0] == "" and linededup.MIN_SITES > 1


def test_run_keeps_clean_documents(spark):
    pieces = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(pieces.columns) and pieces.count() > 50


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = __spark_entry__.queries()[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()
    names = sorted(got.columns)
    rows = lambda x: sorted(tuple(str(v) for v in r) for r in x[names].convert_dtypes().astype(object).where(x[names].notna(), None).values.tolist())
    assert names == sorted(want.columns) and rows(got) == rows(want)


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
