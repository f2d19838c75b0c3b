"""Packing against a piece-by-piece packer and the tokenizer itself."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.llm import packing
from vigil.llm.tokens import tokenizer_path

PATH = tokenizer_path(packing.TOKENIZER)


def plain_bins(lengths, cap):
    """Bins after matching and best fit, one piece at a time."""
    large, bins = sorted((x for x in lengths if 3 * x > cap), reverse=True), []
    while large:
        a = large.pop(0)
        b = next((x for x in large if x <= cap - a), 0)
        if b:
            large.remove(b)
        bins.append(a + b)
    for s in sorted((x for x in lengths if 3 * x <= cap), reverse=True):
        fits = [i for i, x in enumerate(bins) if x + s <= cap]
        if fits:
            i = max(fits, key=lambda i: bins[i])
            bins[i] += s
        else:
            bins.append(s)
    return bins


def placed(counts, cap):
    rows = sorted(packing.layout(counts, cap))
    out = []
    for k, (length, rank, first, per, offset) in enumerate(rows):
        last = rows[k + 1][1] if k + 1 < len(rows) and rows[k + 1][0] == length else counts[length]
        out += [(first + j // per, offset + j % per * length, length) for j in range(last - rank)]
    return out


def check_bins(out, cap):
    """Gapless sequences of at most ``cap``; their fills."""
    bins = defaultdict(list)
    for b, o, n in out:
        bins[b].append((o, n))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= cap
    return [sum(n for _, n in p) for p in bins.values()]


@pytest.mark.parametrize("seed", range(30))
def test_plan_equals_piece_by_piece_packing(seed):
    rng = random.Random(seed)
    cap = rng.choice([10, 64, 100, 4096])
    shapes = [lambda: rng.randint(1, cap), lambda: rng.choice([1, 2, cap, cap // 2, cap // 3 + 1]), lambda: min(cap, int(rng.expovariate(6 / cap)) + 1),
              lambda: rng.randint(cap // 3 + 1, cap // 2 + 1), lambda: max(1, cap // 7)]
    lengths = [rng.choice(shapes[:rng.randint(1, 5)])() for _ in range(rng.randint(1, 400))]
    out = placed(Counter(lengths), cap)
    assert Counter(n for _, _, n in out) == Counter(lengths)
    assert sorted(check_bins(out, cap)) == sorted(plain_bins(lengths, cap))


def test_matching_of_large_pieces_is_the_best():
    def least(items, cap):
        if not items:
            return 0
        a, *rest = items
        return 1 + min([least(rest, cap), *(least(rest[:i] + rest[i + 1:], cap) for i, b in enumerate(rest) if a + b <= cap)])
    rng = random.Random(5)
    for _ in range(60):
        items = [rng.randint(11, 30) for _ in range(rng.randint(1, 8))]
        assert len({b for b, _, _ in placed(Counter(items), 30)}) == least(items, 30)


def test_empty_plan():
    assert packing.layout({}, 4096) == []


def test_encoder_equals_the_library(documents):
    texts = [r[0] for r in documents.select("text").limit(300).collect()]
    texts += ["it's  we'll 'tis --'s\n\n x\t\ty  ", "''s 'S ²³ ½x a1b2 __ --- ...\r\n  end ", "¿Qué? ÑANDÚ— İstanbul ĲSSEL ſ ŉ Ⱥ Ɓ", "don't STOP I'M", "K Å é 漢字 12 345",
              "a<|endoftext|>b <|startoftext|>", "", "  ", " x y\x0bz\x0c", "ŒUVRE Straße ﬁ Σας ΣΑΣ"]
    enc = packing.Encoder(PATH)
    for t in texts:
        assert enc.encode(t).tolist() == enc.tk.encode(t, add_special_tokens=False).ids + [packing.END_ID]
    assert enc.split and len(enc.chunks) > 100


@pytest.mark.parametrize("cap", [50, 4096])
def test_packed_pieces(spark, edge, documents, cap):
    docs = edge.select("doc_id", "text").unionByName(documents.filter("doc_id < 150").select((F.col("doc_id") + 100).alias("doc_id"), "text")).repartition(6)
    out = packing.pack(docs, PATH, capacity=cap, with_ids=True)
    rows = out.collect()
    enc = packing.Encoder(PATH)
    want = Counter()
    for r in docs.collect():
        ids = np.array(enc.tk.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4")
        for k in range(0, len(ids), cap):
            p = ids[k:k + cap]
            want[r["doc_id"], k // cap, k, len(p), zlib.crc32(p.tobytes()), p.tobytes()] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in rows) == want
    fills = check_bins([(r["sequence_id"], r["offset"], r["length"]) for r in rows], cap)
    assert sorted(fills) == sorted(plain_bins([r["length"] for r in rows], cap))
    seqs = packing.sequences(out).collect()
    assert sorted(len(s["ids"]) // 4 for s in seqs) == sorted(fills) and sum(s["n_pieces"] for s in seqs) == len(rows)
    first = {(r["sequence_id"], r["offset"]): bytes(r["ids"]) for r in rows}
    assert all(bytes(s["ids"]).startswith(first[s["sequence_id"], 0]) for s in seqs)


def test_packing_of_an_empty_table(empty):
    out = packing.pack(empty, PATH)
    assert out.count() == 0 and out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
