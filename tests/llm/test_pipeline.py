"""The pipeline's stages, each on its own input, against plain loops over all documents."""

import os
import re
import shutil
import subprocess
import sys
import zlib
from pathlib import Path

import public_tokenizers
from pyspark.sql import functions as F
from tests_helpers import brute_groups

import corpus_pipeline as cp
from tidemark.llm.common import stored
from tidemark.llm.decontaminate import words_of
from tidemark.llm.simhash import fingerprint
from tidemark.llm.tokens import UnitEncoder

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.limit(3).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs.limit(1).withColumns({"text": F.lit(None).cast("string"), "doc_id": F.lit(10**6)}))
    docs = stored(docs.unionByName(extra).withColumns({"row": F.lit("r"), "ROW_": F.lit(1), "kept": F.lit(True), "fp": F.lit(2)}), "docs")
    columns, schema = docs.columns, docs.schema
    shown = {}
    for name, stage in cp.STAGES[:-1]:
        before = docs.collect()
        out = stored(stage(spark, docs, SF), "stage")
        assert out.columns == columns and [f.dataType for f in out.schema] == [f.dataType for f in schema]
        shown[name] = (before, out.collect())
        docs = out
    before, after = shown["toxicity"]
    assert 0.5 * len(before) < len(after) <= len(before)
    before, after = shown["exact dedup"]
    bare = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    best = {}
    for r in before:
        k, rank = bare(r.text), (-len(r.text or ""), r.doc_id is None, r.doc_id or 0)
        best[k] = min(best.get(k, rank), rank)
    assert sorted((bare(r.text), (-len(r.text or ""), r.doc_id is None, r.doc_id or 0)) for r in after) == sorted(best.items())
    before, after = shown["SimHash near-dedup"]
    prints = [(fingerprint((r.text or "").encode()), r.doc_id is None, r.doc_id or 0) for r in before]
    want = sorted(min((n, i) for p, n, i in prints if p in set(g)) for g in brute_groups([p for p, *_ in prints]))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in after) == want
    before, after = shown["benchmark decontamination"]
    items = [" ".join(words_of(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(f" {i} " in f" {' '.join(words_of(r.text or ''))} " for r in after for i in items)
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    grams = {w for i in items for w in zip(*(i.split()[k:] for k in range(5)))}
    assert all(grams & set(zip(*(words_of(r.text or "")[k:] for k in range(5)))) for r in before if r.doc_id in gone)
    pieces = cp.pack(spark, docs, SF).collect()
    kept = docs.collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in kept}
    assert all(len(p.ids) == 4 * p.length and zlib.crc32(p.ids) == p.ids_crc32 for p in pieces)
    encode = UnitEncoder(Path(public_tokenizers.path("byte_bpe_50k.json")).read_bytes())
    whole = {r.doc_id: encode.whole(r.text or "") + bytes(4) for r in kept}
    joined = {}
    for p in sorted(pieces, key=lambda p: p.start):
        joined[p.doc_id] = joined.get(p.doc_id, b"") + bytes(p.ids)
    assert joined == whole


def test_without_the_operators(spark, tmp_path):
    """The other queries load where both folders of the operators are gone."""
    root = Path(cp.__file__).parent
    shutil.copytree(root / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(root / name, tmp_path / name)
    told = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", told], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) == int(out[2]) > 50 and out[1] == "False"


def test_empty(spark):
    docs = stored(spark.read.parquet(f"{SF}/documents.parquet").limit(0), "none")
    for _, stage in cp.STAGES:
        docs = stored(stage(spark, docs, SF), "none")
        assert docs.count() == 0
