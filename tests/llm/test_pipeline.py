"""The pipeline's rows against a plain version of its stages."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweave.llm import common, jaccard_join, mixing, quality

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _table(rng):
    words = [f"w{i}" for i in range(3000)]
    text = lambda n: " ".join(rng.choice(words, n))
    texts = [text(int(n)) for n in rng.integers(55, 160, 60)]
    base = text(120).split()
    texts += [" ".join("zz%d" % k if i == 11 * k else w for i, w in enumerate(base)) for k in range(6)]  # near copies
    texts += [texts[3], texts[3], texts[70 % len(texts)], "too short", None, "", "again and again " * 40, text(5200)]
    return [(i, t, "en" if i % 3 else None, None if i % 11 == 0 else f"s{i % 3}", None) for i, t in enumerate(texts)]


def _plain_ids(rows, judged):
    """Ids and texts that quality rules, exact dedup and the near-duplicate join leave."""
    left = {}
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        seen = {k + d for k, g in enumerate(grams) if grams.count(g) > 1 for d in range(3)}
        if len(w) >= 50 and 100 * len(seen) <= 50 * len(w) and judged[i]:
            left[i] = t
    last = {}
    for i, t in left.items():
        last[t] = max(i, last.get(t, i))
    left = {i: t for i, t in left.items() if last[t] == i}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in left.items() for w in [WORD.findall(t.lower())]}
    group = {i: i for i in left}
    for a in left:
        for b in left:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = {k: low if v == high else v for k, v in group.items()}
    return {i: t for i, t in left.items() if group[i] == i}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('corpus')}"
    spark.createDataFrame(_table(np.random.default_rng(8)), DOC).write.parquet(f"{path}/documents.parquet")
    return path


def test_run_is_as_plain(spark, folder):
    from tokenizers import Tokenizer

    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    judged = {r.doc_id: r.kept or r.base_failed for r in quality.quality_verdicts(docs).collect()}
    left = _plain_ids(rows, judged)
    assert 60 <= len(left) < len(rows) - 8
    # the mix of just these documents, each text encoded at once
    mixed = mixing.mix_documents(spark.createDataFrame([r for r in rows if r[0] in left], DOC)).collect()
    tokenizer, want = Tokenizer.from_file(common.tokenizer_path("word_bpe_49k.json")), []
    for r in mixed:
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], "<u4")
            want.append((r.doc_id, k, at, len(part), zlib.crc32(part.tobytes())))
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    filled = {}
    for r in got:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)] * 3, [(1, "x" * 300_000, "en", "s", 1), (None, "a b " * 30_000, None, None, None)]])
def test_stages_on_odd_tables(spark, rows):
    """Empty tables, null in every column, very long texts: each stage gives the columns of documents."""
    import corpus_pipeline

    docs = spark.createDataFrame(rows, DOC)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stage(stage(spark, docs, ""), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= 0


def test_near_copies_with_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f", None, None, None), (None, "a b c d e f", None, None, None), (5, "a b c d e f", "x", "y", 1)], DOC)
    kept = jaccard_join.drop_near_copies(docs)
    assert kept.filter(F.col("doc_id") == 5).count() == 1 and kept.columns == docs.columns
