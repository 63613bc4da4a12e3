import hashlib
import subprocess
import sys

import pyarrow.parquet as pq

import corpus_pipeline
from flumen.llm import bpe, pii, quality_classifier

from ..conftest import ROOT, SF
from .helpers import ODD, components, shingles


def test_stages_equal_brute_force(spark):
    """Every stage, redone over all texts in plain Python."""
    table = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    score = quality_classifier.scorer(quality_classifier.train(docs, labels))
    good = [r for r, s in zip(table, score([r["text"] for r in table]), strict=True) if s >= 0.7]
    groups = components([(r["doc_id"], r["text"]) for r in good])
    single = [r for i, r in enumerate(good) if groups[i][1] == r["doc_id"] or not groups[i][0]]
    items = [shingles(r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    clean = [r for r in single if not any(q and 5 * len(q & shingles(r["text"])) >= 4 * len(q) for q in items)]
    fitted, coder = pii.model(), bpe.Encoder(bpe.load())
    expected = {}
    for r in clean:
        spans, more = pii.all_spans([r["text"]], fitted)[0]
        cuts = sorted([(s, e, k) for k, xs in spans.items() for s, e in xs] + [(s, e, k) for k, s, e in more])
        text, at = "", 0
        for s, e, k in cuts:
            if s >= at:
                text += r["text"][at:s] + f"[{k.upper()}]"
            at = max(at, e)
        text += r["text"][at:]
        expected[r["doc_id"]] = (text, len(text), hashlib.sha256(str(coder.encode(text)).encode()).hexdigest())
    rows = corpus_pipeline.run(spark, SF).collect()
    got = {r["doc_id"]: (r["text"], r["n_chars"], hashlib.sha256(str(r["token_ids"]).encode()).hexdigest()) for r in rows}
    assert got == expected and len(rows) == len(got) < len(table)


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Null and repeated ids with different texts, odd texts, a clashing column; then no documents at all."""
    table = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    rows = [(r["doc_id"], r["text"]) for r in table] + ODD + [(table[0]["doc_id"], table[5]["text"]), (table[0]["doc_id"], "a text of its own that nothing else is like at all today"), (None, None)]
    shape = "doc_id long, text string, lang string, source string, n_chars long, token_ids string, row string"
    for name, some in (("odd", rows), ("none", [])):
        spark.createDataFrame([(i, t, "en", "s", len(t or ""), "mine", "mine") for i, t in some], shape).write.parquet(str(tmp_path / name / "documents.parquet"))
        for other in ("labels", "benchmark"):
            spark.read.parquet(f"{SF}/{other}.parquet").write.parquet(str(tmp_path / name / f"{other}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "odd"))
    got = out.collect()
    assert set(out.columns) == {"doc_id", "text", "lang", "source", "n_chars", "row", "n_tokens", "token_ids"} and {r["row"] for r in got} == {"mine"}
    score = quality_classifier.scorer(quality_classifier.train(*(spark.read.parquet(str(tmp_path / "odd" / f"{n}.parquet")) for n in ("documents", "labels"))))
    good = [r for r, s in zip(rows, score([t for _, t in rows]), strict=True) if s >= 0.7]
    groups = components([(k, t) for k, (_, t) in enumerate(good)])
    assert len(got) <= len(good) and len([r for r in got if shingles(r["text"])]) <= len({top for n, top in groups.values() if n})
    empty = corpus_pipeline.run(spark, str(tmp_path / "none"))
    assert empty.count() == 0 and set(empty.columns) == set(out.columns)


def test_stage_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_library_stands_without_the_operators():
    code = (
        "import sys; sys.modules['flumen.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not [k for k in q if k.startswith('op') or k == 'pipeline']"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
