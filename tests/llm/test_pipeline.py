import re
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tapewright.llm import common, langid, mixing, secrets
from tests.llm.test_packing import holds


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_language_stage_keeps_its_prediction_and_drops_what_has_no_language(spark, docs, documents):
    odd = spark.createDataFrame([(10_001, "123 456 ###", None, "x", 11), (10_002, None, None, "x", 0)], docs.schema)
    table = docs.union(odd)
    got = corpus_pipeline.language_id(spark, table, "")
    assert got.columns == docs.columns
    said = {r.doc_id: (r.lang_pred, r.score) for r in langid.annotate(table.select("doc_id", "text"), langid.fit(table)).collect()}
    assert {r.doc_id: r.lang for r in got.collect()} == {i: lang for i, (lang, share) in said.items() if lang != "und" and share >= 0.5}
    assert got.count() >= 0.995 * docs.count() and not got.where("doc_id > 10000").count()
    clash = documents.withColumns({c: F.lit(7) for c in ("score", "lang_pred", "share", "changes", "h", "rank", "n", "span")})
    rows = langid.keep_known(clash)
    assert rows.columns == clash.columns and {tuple(r[6:]) for r in rows.collect()} == {(7,) * 8}


def test_dedup_stage_keeps_one_of_each_group(spark, docs):
    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    texts = {r.doc_id: r for r in docs.collect()}
    sets = {i: shingles(r.text) for i, r in texts.items()}
    root, having = {i: i for i in sets}, defaultdict(list)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(sets):
        for j in {j for s in sets[i] for j in having[s]}:
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
        for s in sets[i]:
            having[s].append(i)
    clash = docs.withColumns({c: F.lit(3) for c in ("sign", "root", "component_id", "fp", "size")})
    twice = clash.union(clash.where("doc_id < 30"))
    got = corpus_pipeline.near_dedup(spark, twice, "").collect()
    assert Counter(r.doc_id for r in got) == Counter({top(i) for i in sets})
    assert all(tuple(r)[:5] == tuple(texts[r.doc_id]) for r in got)


def test_secret_stage_redacts_and_keeps_all_rows(spark, docs):
    got = {r.doc_id: r for r in corpus_pipeline.secret_scans(spark, docs, "").collect()}
    had = 0
    for r in docs.collect():
        if secrets.spans((r.text or "").encode()):
            had += 1
            assert not secrets.base_spans(got[r.doc_id].text) and got[r.doc_id].n_chars == len(got[r.doc_id].text)
        else:
            assert got[r.doc_id] == r
    assert had and len(got) == docs.count()


def test_mixing_stage_takes_what_the_operator_says(spark, docs, documents):
    for table in (docs, documents, documents.withColumn("doc_id", F.lit(None).cast("long"))):
        want = Counter()
        for r in mixing.mix(table).collect():
            want[r.doc_id, r.text_md5[:0]] += r.taken
        got = Counter()
        rows = corpus_pipeline.mix_sources(spark, table, "")
        assert rows.columns == table.columns
        for r in rows.collect():
            got[r.doc_id, ""] += len((r.text or "").encode().split())
        assert +got == +want


def test_stages_leave_clashing_columns_alone(spark, documents):
    names = ["_copy", "_id", "_md5", "_k", "_epochs", "_ranges", "k", "row", "copy", "epochs", "ranges", "taken", "size", "text_md5", "target", "_chars", "spans"]
    clash = documents.withColumns({c: F.lit("user's") for c in names})
    for stage in (corpus_pipeline.mix_sources, corpus_pipeline.secret_scans):
        got = stage(spark, clash, "")
        assert got.columns == clash.columns and got.count()
        assert {r[c] for r in got.collect() for c in names} == {"user's"}


def test_run(spark, docs):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.01").collect()
    table = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, "/root/testdata/sf0.01")
    per_doc = defaultdict(set)
    for r in rows:
        per_doc[r.doc_id].add(r.doc_tokens)
    assert set(per_doc) == {r.doc_id for r in table.select("doc_id").collect()}
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024


def test_last_stage_is_packing(spark, documents):
    texts = defaultdict(list)
    for r in documents.collect():
        texts[r.doc_id].append(r.text)
    holds(corpus_pipeline.pack_sequences(spark, documents, "").collect(), texts)


def test_every_stage_takes_an_empty_table(spark, no_documents):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_documents, "").collect() == []


def test_the_mixed_table_is_released_once_its_pieces_are_staged(spark, monkeypatch):
    made = []

    def staged(df, name):
        made.append((name, common.staged(df, name)))
        return made[-1][1]

    monkeypatch.setattr(corpus_pipeline, "staged", staged)
    packed = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert packed.count() and [name for name, _ in made] == [name for name, _ in corpus_pipeline.STAGES[:-1]]
    assert all(table.staged_at is None for _, table in made)
