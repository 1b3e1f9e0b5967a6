"""The pipeline, stage by stage, against brute force; and what is left when its files are gone."""

import collections
import os
import subprocess
import sys

import corpus_pipeline
from hearth.llm import quality_rules
from hearth.llm.common import DOCUMENT_COLUMNS, stored, table
from hearth.llm.mixing import mix
from hearth.llm.queries import MIX_KEEP, MIX_WEIGHTS, label_domains
from tests.llm.test_decontam import brute as brute_hits
from tests.llm.test_native_ops import brute_quality
from tests.llm.test_simhash import brute_components
from tests.llm.test_token_output import check
from tests.llm.util import DOCS, SF, docs, sample_docs, tables_dir


def test_stages_against_brute_force(spark, tmp_path):
    d = tables_dir(tmp_path, spark, documents=sample_docs(spark).unionByName(table(spark, SF, "documents").filter("doc_id > 180")))
    tables, now = [], table(spark, d, "documents")
    for _, stage in corpus_pipeline.STAGES:
        tables.append(now.collect())
        out = stage(spark, now, d)
        if len(tables) < 5:
            assert out.columns == DOCUMENT_COLUMNS and out.schema == now.schema
        now = stored(out, "test-pipeline")
    last = now.collect()
    start, kept, alone, clean, mixed = tables

    rows = {r.doc_id: r for r in start}
    by_rule = {r.doc_id for r in quality_rules.judge(docs(spark, [(r.doc_id, r.text) for r in start])).filter("kept").collect()}
    assert {r.doc_id for r in kept} == by_rule and all(not brute_quality(rows[i].text)[-1] for i in by_rule)
    assert all(set(r.text.split("\n")) <= set(rows[r.doc_id].text.split("\n")) and r.n_chars == len(r.text) for r in kept)

    groups = collections.defaultdict(list)
    for i, _, c in brute_components([(r.doc_id, r.text) for r in kept]):
        groups[c].append(i)
    assert sorted(r.doc_id for r in alone) == sorted(min(x) for x in groups.values()) and len(alone) < len(kept)

    items = [tuple(r) for r in table(spark, d, "benchmark").collect()]
    before = {h[0]: h for h in brute_hits([(r.doc_id, r.text) for r in alone], items)}
    texts = {r.doc_id: r.text for r in alone}
    assert any(h[-1] for h in before.values()) and len(clean) == len(alone)
    for r, h in zip(clean, brute_hits([(r.doc_id, r.text) for r in clean], items)):
        assert not h[-1] and (before[r.doc_id][-1] or r.text == texts[r.doc_id])

    copies = {r.doc_id: r.copies for r in mix(stored(spark.createDataFrame(clean, DOCS), "clean"), label_domains(table(spark, d, "labels")), MIX_WEIGHTS, MIX_KEEP).collect()}
    assert collections.Counter(r.doc_id for r in mixed) == collections.Counter({i: n for i, n in copies.items() if n})
    check(mixed, last)


def test_run_equals_its_stages(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    assert got and [f.name for f in corpus_pipeline.run(spark, SF).schema] == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_stages_take_empty_tables(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs(spark, []), SF).count() == 0


def test_entry_without_these_files(tmp_path):
    """A copy of the repository without hearth/llm and corpus_pipeline.py still lists its queries."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for top, names, files in os.walk(root):
        names[:] = [n for n in names if n not in (".git", "llm", "__pycache__", "tests")]
        for f in files:
            if f.endswith(".py") and f != "corpus_pipeline.py":
                to = tmp_path / os.path.relpath(os.path.join(top, f), root)
                to.parent.mkdir(parents=True, exist_ok=True)
                to.write_text(open(os.path.join(top, f)).read())
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)}, timeout=120)
