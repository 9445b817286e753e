"""Every llm query runs on the smallest tables and agrees with its SQL, and the core does without the subpackage."""

import json
import subprocess
import sys
import tomllib

import oracle
import pytest

from corvine.llm import credentials, plans, syntax


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sf, name):
    if name in plans.SQL:
        assert oracle.compare(spark, name, plans.QUERIES[name], plans.SQL[name], sf) is None
    else:
        df = plans.QUERIES[name](spark, sf)
        assert df.columns and df.count() > 0


def test_pieces_rebuild_their_items(spark, sf):
    limits = {(r.item_table, (r.item_kind or "").strip().lower()): r for r in spark.read.parquet(f"{sf}/size_limit.parquet").collect()}
    items = {("context_item", str(r.item_id)): (r.content, (r.source_type or "").strip().lower()) for r in spark.read.parquet(f"{sf}/context_item.parquet").collect()}
    found: dict = {}
    for r in plans.QUERIES["p1_pieces"](spark, sf).where("item_table = 'context_item'").orderBy("item_key", "piece_no").collect():
        found.setdefault((r.item_table, r.item_key), []).append(r)
    natural = cuts = 0
    for key, pieces in found.items():
        content, kind = items[key]
        limit, end, out = limits[key[0], kind], 0, ""
        for p in pieces:
            assert len(p.piece) <= limit.max_size and p.start <= end < p.end and end - p.start <= limit.overlap_size and content[p.start : p.end] == p.piece
            cuts, natural = cuts + (p.end < len(content)), natural + (p.end < len(content) and (content[p.end - 1].isspace() or content[p.end - 1] in "。！？"))
            out, end = out + content[end : p.end], p.end
        assert out == content
    assert found and natural > 0.6 * cuts  # contents without any blank are cut hard


def test_redacted_files_stay_well_formed(spark, sf):
    before = {r.file_id: r for r in spark.read.parquet(f"{sf}/source_file.parquet").collect()}
    changed = 0
    for r in plans.QUERIES["p2_redacted"](spark, sf).collect():
        old = before[r.file_id]
        ext = (old.file_path or "").rsplit(".", 1)[-1].lower()
        if not r.n_redacted:
            assert r.code == old.code
            continue
        changed += 1
        assert credentials.find(ext, r.code) == [] and "REDACTED" in r.code
        if ext in syntax.LANGUAGES:
            assert syntax.parses(ext, r.code) == syntax.parses(ext, old.code)
        elif ext == "json":
            json.loads(r.code)
        elif ext == "toml":
            tomllib.loads(r.code)
    assert changed > 10


def test_spans_rates_containers_and_passages(spark, sf):
    lines = {(r.file_id, r.line_no) for r in plans.QUERIES["p2_found"](spark, sf).collect()}
    spans = plans.QUERIES["p2_spans"](spark, sf).collect()
    assert {(r.file_id, r.line_no) for r in spans} == lines and all(r.byte_start < r.byte_end for r in spans)
    rates = plans.QUERIES["p7_rates"](spark, sf).collect()
    assert sum(r.invalid_files for r in rates) == plans.QUERIES["p7_found"](spark, sf).count()
    packed = plans.QUERIES["p9_containers"](spark, sf).collect()
    used: dict = {}
    for r in packed:
        used[r.container] = used.get(r.container, 0) + r.n
    ids = plans.QUERIES["p8_ids"](spark, sf).collect()
    assert max(used.values()) <= 2048 and sum(used.values()) == sum(len(r.ids) for r in ids) and {r.doc_id for r in packed} == {r.doc_id for r in ids}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    passages = plans.QUERIES["p10_passages"](spark, sf).collect()
    assert passages and all(0 <= r.start < r.end <= len(texts[r.doc_id]) and 0 < r.confidence <= 1 for r in passages)


def test_core_without_llm():
    code = "import sys; sys.modules['corvine.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p5_found' in q and 'p2_found' not in q"
    subprocess.run([sys.executable, "-c", code], check=True)
