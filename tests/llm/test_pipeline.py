"""The corpus pipeline, stage by stage, against plain versions."""

import brute as B
import sentencepiece

import corpus_pipeline
from orbitframe.llm import piece_tokens

SMALL = "/root/testdata/sf0.001"
METHODS = ["quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "secret_scans", "sentencepiece"]


def test_stages(spark, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == METHODS
    folder = str(tmp_path / "tables")
    given = spark.read.parquet(f"{SMALL}/documents.parquet")
    secrets = [(10**6 + i, f"password: abcd{i}EFGH " + " ".join(f"v{i}x{j}" for j in range(50)) + " AKIA" + "Q" * 16, "en", "planted", 999) for i in range(3)]
    given.unionByName(spark.createDataFrame(secrets, given.schema)).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    model = sentencepiece.SentencePieceProcessor(model_file=piece_tokens.default_model())
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    texts = {i: r.text for i, r in rows.items()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if name == "quality_rules":
            texts = {i: t for i, t in texts.items() if B.verdict(B.rule_counts(t))[1]}
        elif name == "ngram_jaccard_join":
            first = {i: c for i, _, c in B.jaccard_groups(list(texts.items()), 5, 80)}
            texts = {i: t for i, t in texts.items() if first[i] == i}
        elif name == "benchmark_decontamination":
            gone = {i for i, _, _ in B.leaks(list(texts.items()), items)}
            assert gone
            texts = {i: t for i, t in texts.items() if i not in gone}
        elif name == "secret_scans":
            assert any(B.secrets(t) for t in texts.values())
            texts = {i: B.redacted(t) for i, t in texts.items()}
        else:
            want = []
            for i, t in texts.items():
                ids = model.encode(t or "", add_eos=True)
                want.append((i, len(ids), B.sha(" ".join(map(str, ids))), B.sha(model.decode(ids))))
            assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in docs.collect()) == sorted(want)
            continue
        assert docs.columns == columns
        got = {r.doc_id: r for r in docs.collect()}
        assert {i: r.text for i, r in got.items()} == texts
        assert all((r.lang, r.source) == (rows[i].lang, rows[i].source) and r.n_chars == (len(r.text) if r.text is not None else rows[i].n_chars) for i, r in got.items() if r.text != rows[i].text)
        assert all(r == rows[i] for i, r in got.items() if r.text == rows[i].text and name != "secret_scans")
    assert sorted(corpus_pipeline.run(spark, folder).collect()) == sorted(docs.collect())


def test_odd_rows_and_extra_columns(spark):
    docs = spark.createDataFrame([(None, None, None, None, None, "a"), (1, "", "en", "s", 0, None), (2, "token=abcdefgh12 " + " ".join(f"w{i}" for i in range(40)), None, None, None, "b")], "doc_id long, text string, lang string, source string, n_chars long, chunk string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "chunk"]
    rows = docs.collect()
    assert [r.doc_id for r in rows] == [2] and rows[0].text.startswith("[secret] w0") and rows[0].n_chars == len(rows[0].text)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SMALL)
    assert empty.collect() == []


def test_repeated_and_null_ids(spark):
    """Whatever the ids, the near-duplicate stage loses no text's last copy, and equal rows leave one."""
    text = lambda k: " ".join(f"{k}{i}" for i in range(60))
    rows = [(1, text("a")), (2, text("a")), (2, text("b")), (7, text("b") + " more"), (9, text("c")), (9, text("c")), (None, text("d")), (None, text("d")), (None, None)]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, SMALL)
    assert sorted(((r.doc_id, r.text[0]) for r in docs.collect()), key=repr) == sorted([(1, "a"), (2, "b"), (9, "c"), (None, "d")], key=repr)
