"""Filter audit against applying every order document by document."""

from itertools import permutations

import brute
import pytest

from vigil.llm import filter_audit as FA


def fails(text, doc_id, rows):
    w = brute.BLANK.findall(text)
    caps = sum("A" <= c <= "Z" for c in text)
    other = any(d is not None and doc_id is not None and d < doc_id and (t or "") == text for d, t, _ in rows)
    return {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * caps > 5 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": other}


def plain(rows, labels):
    marks = {x: {d for d, *v in labels if v[i] == 1 and d is not None} for i, x in enumerate(("good", "toxic"))}
    failed = [(s or "", d, fails(t or "", d, rows)) for d, t, s in rows]
    out = {}
    for part in {p for p, _, _ in failed}:
        mine = [(d, f) for p, d, f in failed if p == part]
        for order in permutations("ABCDE"):
            left = mine
            for k, x in enumerate(order):
                lost = [(d, f) for d, f in left if f[x]]
                left = [(d, f) for d, f in left if not f[x]]
                out[part, "".join(order), k + 1] = [
                    len(left), len(lost), sum(f[x] for _, f in mine) - len(lost), sum(f[x] and sum(f.values()) == 1 for _, f in mine),
                    sum(d in marks["good"] for d, _ in lost), sum(d in marks["toxic"] for d, _ in lost)]
    total = {}
    for (p, o, k), v in out.items():
        total[p, o[k - 1]] = total.get((p, o[k - 1]), 0) + v[1]
    return {(p, o, k): (*v, total[p, o[k - 1]]) for (p, o, k), v in out.items()}


def got(df):
    return {(r[0], r[1], r[2]): tuple(r[3:]) for r in df.collect()}


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0, 5), (1, 0, 1, 5), (3, 1, None, 5), (5, None, 1, 5), (None, 1, 1, 5), (8, 0, 0, 5), (21, 1, 1, 5)],
                                 "doc_id long, quality int, toxic int, mask int")


def hard_rows():
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(20, long, "a"), (21, long, "a"), (22, long, None), (22, long, ""), (23, "A" * 30 + " b", "b"), (24, "x " * 80, "b"), (25, long + " #", "b"),
            (26, long.upper(), "c"), (27, long.upper() + " $", "c"), (None, long, "a")]
    return rows + [(100 + i, "same text", "hot") for i in range(60)] + [(40, "same text", "a")]


def test_audit_matches_every_order(spark, edge, labels):
    docs = edge.select("doc_id", "text", "source", "kept").unionByName(
        spark.createDataFrame([(*r, True) for r in hard_rows()], "doc_id long, text string, source string, kept boolean")).repartition(5)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    want = plain(rows, [tuple(r)[:3] for r in labels.collect()])
    assert got(FA.filter_audit(docs, labels)) == want


def test_hot_groups_are_dealt_to_chunks(spark, monkeypatch):
    docs = spark.createDataFrame(hard_rows(), "doc_id long, text string, source string").repartition(5)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    want = {d for d, t, _ in rows if fails(t, d, rows)["E"]}
    for hot in (4, 40):
        monkeypatch.setattr(FA, "HOT", hot)
        assert {r["doc_id"] for r in FA.copies_of_smaller(docs).collect()} == want


def test_empty_tables(spark, edge, empty, labels):
    assert FA.filter_audit(empty, labels).count() == 0
    out = got(FA.filter_audit(edge, labels.limit(0)))
    assert len(out) == 600 * edge.select("source").na.fill("").distinct().count() and all(v[4] == v[5] == 0 for v in out.values())
