"""Findings of replaced rule versions are not joined back."""

from orbitframe.llm import secret_scan


def test_only_current_versions_are_joined_back(spark):
    docs = spark.createDataFrame([(1, "a" * 32), (2, "b" * 40)], "doc_id long, text string")
    ledger = secret_scan.update_ledger(docs)
    newer = [r._replace(version=2, pattern="[0-9a-f]{40,}") if r.kind == "hex" else r for r in secret_scan.RULES]
    found = secret_scan.by_path(docs, secret_scan.update_ledger(docs, ledger, rules=newer), rules=newer)
    assert [(r.doc_id, [(s.key, s.start, s.end) for s in r.secret_spans]) for r in found.orderBy("doc_id").collect()] == [(1, []), (2, [("hex@2", 0, 40)])]


def test_clashing_names_and_very_many_matches(spark):
    text = "token=abcdefgh1 é " * 1000 + "token=short"
    docs = spark.createDataFrame([(1, text, "b", "x", "r"), (2, None, "b", "x", "r")], "doc_id long, text string, secret_blob string, secret_spans string, row string")
    got = {r.doc_id: r for r in secret_scan.by_path(docs, secret_scan.new_findings(docs)).collect()}
    assert [(s.start, s.end) for s in got[1].secret_spans] == [(18 * i, 18 * i + 15) for i in range(1000)]
    assert got[2].secret_spans == [] and (got[1].secret_blob, got[1].row) == ("b", "r")
