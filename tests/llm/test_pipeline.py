import re
import struct
import zlib

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as p
from cinderview.llm import quality_classifier, secret_scan
from test_near_dedup import brute as linked
from test_packing import check_places

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def expected(spark):
    """The five stages one after the other on plain lists; the classifier's scores are taken as they are."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    learned = quality_classifier.learn(p.prepared(spark), docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in quality_classifier.scores(spark, docs, learned).collect() if r.score >= p.LEAST_SCORE}
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    stages = [[r for r in rows if r[0] in good]]
    first = {}
    for i, text in stages[-1]:
        first.setdefault(text or "", i)
    stages.append([r for r in stages[-1] if first[r[1] or ""] == r[0]])
    kept = {i for i, _, _, stays in linked(stages[-1], 5, 80) if stays}
    stages.append([r for r in stages[-1] if r[0] in kept])
    stages.append([(i, t if t is None else secret_scan.without_spans(t, secret_scan.secret_spans(t)[1], "[SECRET]")) for i, t in stages[-1]])
    return rows, stages


def test_every_stage_against_brute_force(spark, expected):
    rows, stages = expected
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for (name, stage), want in zip(p.STAGES[:-1], stages):
        docs = p.written(spark, stage(spark, docs, SF), "stage")
        assert docs.columns == columns, name
        assert sorted((r.doc_id, r.text) for r in docs.collect()) == want, name
        assert len(want) > 0.5 * len(rows)
    assert not any(re.search(r'token = "[0-9a-f]{30,}', t or "") for _, t in stages[-1])


def test_run_packs_what_is_left(spark, expected):
    got = p.run(spark, SF).collect()
    tokenizer, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), []
    for i, text in expected[1][-1]:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        want += [(i, k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    assert check_places(got, 2048) <= -(-sum(r.length for r in got) // 2048) * 1.05 + 2


def test_stages_take_awkward_rows(spark, docs, odd_rows):
    rows = odd_rows + odd_rows[:4] + [(None, "no id"), (None, "no id"), (None, None)]
    df = docs(rows)
    for name, stage in p.STAGES[:-1]:
        df = p.written(spark, stage(spark, df, SF), "odd")
        assert set(df.columns) == set(docs([]).columns), name
    assert p.STAGES[-1][1](spark, df, SF).count() >= df.count() > 0


def test_stages_take_an_empty_table(spark, docs):
    for name, stage in p.STAGES:
        assert stage(spark, docs([]), SF).count() == 0, name
