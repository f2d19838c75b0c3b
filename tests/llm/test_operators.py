"""Operators against plain versions, on the small tables and on rows with nulls, blanks, repeats and clashing columns."""

import math
import random

import brute
import pytest
from pyspark.sql import functions as F

from vigil.llm import decontam, exact, langid, license as lic, mixing, simhash, tokens, warc


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


def ordered(want):
    return sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r))


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# -- 4: exact dedup

@pytest.mark.parametrize("digit", [2, 64])
def test_exact_groups_match_plain_grouping(edge, digit):
    out = exact.exact_groups(edge, first_digit=digit)
    assert rows(out, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == ordered(brute.exact(pairs(edge)))


def test_exact_groups_of_an_empty_table(empty):
    assert exact.exact_groups(empty).count() == 0


# -- 5: decontamination

ITEMS = [(1, "quick brown fox"), (2, None), (3, "!!"), (10, "the lazy dog and runs away from it today"), (4, " ".join(f"w{i}x{i}" for i in range(5, 30))),
         (11, "tail"), (5, "QUICK brown FOX")]


# a filter of 64 bits lets nearly every suffix pass; a lead of one word sends the long text to few shards
@pytest.mark.parametrize("how", [{}, {"most_bits": 64}, {"lead": 1, "spread": 3}, {"lead": 10, "spread": 1}])
def test_decontamination_matches_windows(spark, edge, how):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = decontam.scan(edge, bench, ["doc_id"], **how)
    got = rows(out, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == ordered(brute.decontam(pairs(edge), ITEMS))


def test_longest_match_has_its_place(spark, edge):
    bench = spark.createDataFrame([(4, ITEMS[4][1])], "item_id long, text string")
    m = decontam.scan(edge.filter("doc_id = 7"), bench, ["doc_id"]).first()["matches"]
    assert (4, 5, 0, 25) in [(int(x["item_id"]), x["doc_word"], x["item_word"], x["n_words"]) for x in m]


def test_longest_matches_equal_a_plain_search(spark):
    """Matches of a small alphabet, where diagonals overlap and items repeat windows, against all (item, document) shifts."""
    rng = random.Random(5)
    draw = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(str(i), draw(rng.choice([1, 2, 4, 6, 9, 14, 30]))) for i in range(12)]
    docs = [(d, draw(rng.randrange(0, 120))) for d in range(40)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    out = decontam.scan(spark.createDataFrame(docs, "doc_id long, text string"), bench, ["doc_id"], window=5, lead=3)
    got = {(r["doc_id"], *m) for r in out.collect() for m in r["matches"]}
    want = set()
    for d, t in docs:
        for i, s in items:
            a, b = t.split(), s.split()
            n = min(5, len(b))
            for shift in range(-len(b), len(a)):
                k = max(0, -shift)
                while k < len(b) and shift + k < len(a):
                    if a[shift + k] != b[k]:
                        k += 1
                        continue
                    e = k
                    while e < len(b) and shift + e < len(a) and a[shift + e] == b[e]:
                        e += 1
                    if e - k >= n:
                        want.add((d, i, shift + k, k, e - k))
                    k = e
    assert got == want and len(want) > 100


def test_decontaminate_keeps_columns_and_clean_rows(spark, edge, empty):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    clean = decontam.decontaminate(edge, bench)
    hit = [r[5] for r in brute.decontam(pairs(edge), ITEMS)]
    assert clean.columns == edge.columns and clean.count() == hit.count(False)
    assert decontam.decontaminate(edge, bench.limit(0)).count() == edge.count()
    assert decontam.decontaminate(empty, bench).count() == 0


# -- 6: licences

TEXTS = ["released Under the MIT license, under the mit license", "Apache License, Version 2.0", "cc-by-nc cc by", "by nc cc by nc",
         lic.TEMPLATES["mit"], "x " + " ".join(lic.TEMPLATES["gpl"].split()[:15]) + " zzz " + " ".join(lic.TEMPLATES["gpl"].split()[16:]),
         "the the the software is furnished to", None, ""]


def test_licence_phrases_match_plain_search(spark, edge):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").unionByName(edge.select("doc_id", "text"))
    out = lic.scan_licenses(docs, ["doc_id"])
    got = rows(out, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got == ordered(brute.licenses(pairs(docs), lic.PHRASES))


def test_templates_add_labels_with_spans(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    by = {r["doc_id"]: r for r in lic.scan_licenses(docs, ["doc_id"]).collect()}
    assert by[4]["labels"] == "mit" and by[4]["score"] == 1.0 and by[4]["spans"][0]["last_word"] == len(lic.TEMPLATES["mit"].split()) - 1
    assert by[5]["labels"] == "gpl" and 0.6 < by[5]["score"] < 1 and by[5]["base_labels"] == ""
    assert by[6]["labels"] == "" and by[6]["score"] < 0.6 and by[7]["score"] == 0


def test_automaton_knows_every_factor():
    rng = random.Random(1)
    seqs = [[rng.randrange(3) for _ in range(30)] for _ in range(3)]
    sam = lic.Automaton(seqs)
    for s in range(3):
        for a in range(30):
            v = 0
            for b in range(a, min(a + 6, 30)):
                v = sam.go[v][seqs[s][b]]
                factor = seqs[s][a:b + 1]
                want = sorted((t, e) for t in range(3) for e in range(len(factor) - 1, 30) if seqs[t][e - len(factor) + 1:e + 1] == factor)
                assert sam.ends[v] == want


# -- 7: token files

def test_token_files_round_trip(spark, edge):
    out = tokens.read_tokens(*tokens.write_tokens(edge.filter("doc_id <> 1 AND doc_id IS NOT NULL").repartition(5), tokens.tokenizer_path()))
    src = sorted(pairs(edge.filter("doc_id <> 1 AND doc_id IS NOT NULL")))
    assert rows(out, "doc_id", "start", "n_tokens", "ids_crc32") == ordered(brute.tokens(src, tokens.tokenizer_path()))


def test_token_files_of_repeated_rows_and_single_reads(spark, edge, empty):
    blocks, dic = tokens.write_tokens(edge, tokens.tokenizer_path())
    got = sorted((r["start"], r["n_tokens"]) for r in tokens.read_tokens(blocks, dic).collect())
    assert len(got) == edge.count() and all(a + n == b for (a, n), (b, _) in zip(got, got[1:]))
    assert len(tokens.fetch(spark, blocks, dic, 1)) == 3
    enc = tokens.Encoder(tokens.tokenizer_path())
    assert tokens.fetch(spark, blocks, dic, 9)[0].tobytes() == enc.encode(["one"])[0]
    assert tokens.read_tokens(*tokens.write_tokens(empty, tokens.tokenizer_path())).count() == 0


def test_word_cache_equals_whole_texts(documents):
    texts = [r[0] for r in documents.select("text").limit(300).collect()]
    texts += ["it's  we'll 'tis\n\n x\t\ty  ", "''s 'S ²³ ½x a1b2 __ --- ...\r\n  end ", "¿Qué? ñandú—", "don't stop",
              "a  b", "a   b", " a", "  a", "a ", "a  ", "\n x", "\n  x", "x \n y", "x \ny", "x\t y\t\n z", " ", "  ", "", "a. b, c'll 's\r\n d", " 's 'tis"]
    rng = random.Random(5)
    texts += ["".join(rng.choice(["a", "b.", "'s", " ", " ", "\n", "\t", "12", "é", "—", "!"]) for _ in range(rng.randrange(40))) for _ in range(400)]
    enc = tokens.Encoder(tokens.tokenizer_path())
    want = [enc.pack(e.ids) + enc.end for e in enc.tk.encode_batch(texts, add_special_tokens=False)]
    assert enc.encode(texts) == want


# -- 8: SimHash

def test_fingerprints_and_components(spark, edge, documents):
    docs = edge.select("doc_id", "text").unionByName(documents.filter("doc_id < 400").select((F.col("doc_id") + 100).alias("doc_id"), "text"))
    src = pairs(docs)
    fps = [brute.fingerprint(t) for _, t in src]
    comp = brute.linked(fps)
    least = {f: min((d for (d, _), g in zip(src, fps) if g in comp[f] and d is not None), default=None) for f in fps}
    want = ordered((d, f - (1 << 64) if f >> 63 else f, least[f]) for (d, _), f in zip(src, fps))
    assert rows(simhash.near_groups(docs, ["doc_id"]), "doc_id", "fp", "component_id") == want


def test_hot_keys_are_dealt_to_chunks(spark):
    rng = random.Random(7)
    base, vals = rng.getrandbits(63), set()
    while len(vals) < 300:
        x = base
        for _ in range(rng.randrange(1, 9)):
            x ^= 1 << rng.randrange(63)
        vals.add(x)
    fps = spark.createDataFrame([(v,) for v in vals], "fp long")
    from vigil.llm.components import components
    for chunk in (20, 2000):
        got = {}
        for r in components(simhash.near_pairs(fps, chunk=chunk)).collect():
            got.setdefault(r["root"], {r["root"]}).add(r["node"])
        want = {min(s): s for s in brute.linked(vals).values() if len(s) > 1}
        assert got == want


def test_one_row_of_each_component_stays(spark, edge, empty):
    left = simhash.drop_near_duplicates(edge)
    assert left.columns == edge.columns
    groups = simhash.near_groups(edge, ["doc_id"])
    assert left.count() == groups.select("root").distinct().count()
    assert simhash.drop_near_duplicates(empty).count() == 0


# -- 9: WARC

def test_archive_round_trip(spark):
    big, small = "<p>" + "é" * 60, "tiny"
    src = [(3, "u3", big), (1, "u\n1", big), (2, None, small), (5, "u5", small), (4, "u4", None), (None, "n", big), (1, "u1", big), (7, "u7", "x" * 100)]
    pages = spark.createDataFrame([(*r, 1, "z") for r in src], "page_id long, url string, html string, payload_digest int, header string")
    back = warc.read_archive(*warc.write_archive(pages))
    got = {(r["page_id"], bytes(r["payload"])): r for r in back.collect()}
    assert back.count() == len(src) and set(got) == {(p, (h or "").encode()) for p, _, h in src}
    first, later = got[1, big.encode()], got[3, big.encode()]
    assert bytes(first["record"]) == first["header"].encode() + big.encode() + b"\r\n\r\n"
    assert "WARC-Type: revisit" in later["header"] and "<urn:page:1>" in later["header"] and bytes(later["record"]).endswith(b"\r\n\r\n\r\n\r\n")
    assert all("WARC-Type: response" in got[p, small.encode()]["header"] for p in (2, 5))
    assert "revisit" in got[None, big.encode()]["header"]
    assert warc.read_archive(*warc.write_archive(pages.limit(0))).count() == 0


# -- 3: mixing

def test_poisson_counts_invert_the_distribution(spark, edge):
    import hashlib
    out = {(r["doc_id"], r["text"], r["source"]): r for r in mixing.replicate(edge, epochs=3.0).collect()}
    rates = {r["source"]: r["rate"] for r in mixing.mixing_rates(edge, epochs=3.0).collect()}
    for d, t, s in [(r["doc_id"], r["text"], r["source"]) for r in edge.collect()]:
        u = int(hashlib.md5(f"{mixing.SEED}:{'null' if d is None else d}:1".encode()).hexdigest()[:13], 16) / 2 ** 52
        p = c = math.exp(-rates[s])
        n = 0
        while c <= u:
            n += 1
            p *= rates[s] / n
            c += p
        assert (out[d, t, s]["n_copies"] if (d, t, s) in out else 0) == n


def test_mixing_meets_its_targets_and_keeps_columns(spark, documents, empty):
    out = mixing.replicate(documents, weights={"src0": 3.0, "src1": 1.0}, epochs=2.0)
    mass = {r["source"]: r["m"] for r in out.groupBy("source").agg(F.sum(F.length("text")).alias("m")).collect()}
    total = documents.agg(F.sum(F.length("text"))).first()[0]
    assert set(mass) == {"src0", "src1"} and 2.3 < mass["src0"] / mass["src1"] < 3.9 and 1.6 < sum(mass.values()) / total < 2.4
    assert mixing.mix(documents).columns == documents.columns
    assert mixing.mix(empty).count() == 0 and mixing.mix(empty).columns == empty.columns


def test_large_means_are_not_capped(spark):
    docs = spark.createDataFrame([(i, "x", "s") for i in range(40)], "doc_id long, text string, source string")
    n = [r["n"] for r in mixing.replicate(docs, epochs=1300.0).groupBy("doc_id").count().withColumnRenamed("count", "n").collect()]
    assert len(n) == 40 and abs(sum(n) / 40 - 1300) < 25 and len(set(n)) > 20


# -- 1: language ID

def _ppm_cost(train, order):
    """Plain PPM: cost(context bytes, symbol) in bits."""
    counts = {}
    for t in train:
        b = bytes([0xFF]) * order + t
        for i in range(order, len(b)):
            for k in range(order + 1):
                counts.setdefault(b[i - k:i], {}).setdefault(b[i], 0)
                counts[b[i - k:i]][b[i]] += 1

    def cost(ctx, s):
        if ctx in counts:
            c = counts[ctx]
            n, q = sum(c.values()), len(c)
            if s in c:
                return -math.log2(c[s] / (n + q))
            esc = -math.log2(q / (n + q))
        else:
            esc = 0.0
        return esc + (cost(ctx[1:], s) if ctx else 8.0)
    return cost


def test_code_lengths_are_those_of_ppm(spark):
    train = [(1, "the cat sat on the mat", "en"), (2, "le chat était là", "fr"), (3, "the the", "en")]
    df = spark.createDataFrame(train, "doc_id long, text string, lang string")
    model = langid.fit(df)
    import numpy as np
    texts = [b"the chat", "là où".encode(), b"", b"t", b"xyz", b"on", b"q"]
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = model.lengths(np.frombuffer(b"".join(texts), np.uint8), offs) / langid.UNIT
    for i, lang in enumerate(model.langs):
        cost = _ppm_cost([t.encode() for _, t, x in train if x == lang], langid.ORDER)
        for j, t in enumerate(texts):
            b = bytes([0xFF]) * langid.ORDER + t
            want = sum(cost(b[k - langid.ORDER:k], b[k]) for k in range(langid.ORDER, len(b)))
            assert abs(got[i, j] - want) < 0.01


def test_held_out_accuracy_and_edge_rows(spark, documents, edge, empty):
    model = langid.fit(documents.filter(~langid.held_out()))
    out = langid.identify(documents.withColumn("out", langid.held_out()), model, ["doc_id", "lang", "out"]).filter("out")
    assert out.filter("lang = lang_pred").count() >= 0.97 * out.count() and out.count() > 200
    got = langid.identify(edge, model, ["doc_id", "text"]).collect()
    assert len(got) == edge.count() and all((r["lang_pred"] == "und") == (r["doc_id"] in (2, 3, 4, 6)) for r in got)
    assert all(0 <= r["score_"] <= 1 if "score_" in r else 0 <= r["score"] <= 1 for r in (x.asDict() for x in got))
    assert {r["lang_pred"] for r in langid.identify(edge, langid.fit(empty), ["doc_id"]).collect()} == {"und"}
    kept = langid.keep_identified(edge, documents)
    assert kept.columns == edge.columns and langid.keep_identified(empty, documents).count() == 0


def test_predictions_ignore_lang_source_and_id(spark, documents):
    model = langid.fit(documents.filter(~langid.held_out()))
    other = documents.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string"), "doc_id": F.col("doc_id") + 10_000})
    a = rows(langid.identify(documents, model, ["doc_id"]), "doc_id", "lang_pred", "score")
    b = rows(langid.identify(other, model, ["doc_id"]).withColumn("doc_id", F.col("doc_id") - 10_000), "doc_id", "lang_pred", "score")
    assert a == b


# -- 10 and 2: repeated windows

def _tangle(seed, n=60):
    """Texts cut and pasted from few sources, with repeats inside and between them."""
    rng = random.Random(seed)
    pool = [" ".join(rng.choice(["ab", "c", "dé", "the", "x" * 9, "q\n"]) + str(rng.randrange(40)) for _ in range(120)) for _ in range(5)]
    out = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(pool)
            a = rng.randrange(len(p))
            parts.append(p[a:a + rng.randrange(1, 400)])
        out.append((i * 3, rng.choice([" ", "", " z "]).join(parts)))
    return out + [(1000, "a" * 450), (1001, "a" * 250), (1002, "ab" * 200), (40, "a" * 99), (41, None), (1003, pool[0] + pool[0]), (1003, pool[0] + pool[0]), (1003, pool[1] + pool[0])]


@pytest.mark.parametrize("seed", [1, 2])
def test_shared_word_windows(spark, edge, seed):
    from vigil.llm import spans
    docs = spark.createDataFrame(_tangle(seed), "doc_id long, text string").repartition(7).unionByName(edge.select("doc_id", "text"))
    out = spans.remove_shared_windows(docs, with_text=True)
    assert rows(out, "doc_id", "n_words", "n_removed", "kept_sha256") == ordered(brute.shared_windows(pairs(docs)))
    assert all(brute.sha(r["kept"]) == r["kept_sha256"] for r in out.collect())


@pytest.mark.parametrize("seed,reduced", [(1, False), (2, False), (3, True)])
def test_repeated_byte_strings(spark, edge, seed, reduced, monkeypatch):
    from vigil.llm import suffixes
    if reduced:
        monkeypatch.setattr(suffixes, "COLLECTION", 300)
    docs = spark.createDataFrame(_tangle(seed), "doc_id long, text string").repartition(7).unionByName(edge.select("doc_id", "text"))
    out = suffixes.remove_repeated_bytes(docs, with_bytes=True)
    assert rows(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == ordered(brute.repeated_bytes(pairs(docs)))
    assert all(brute.sha(bytes(r["kept"])) == r["kept_sha256"] for r in out.collect())


def test_repeats_in_empty_tables(empty):
    from vigil.llm import spans, suffixes
    assert spans.remove_shared_windows(empty).count() == 0 and suffixes.remove_repeated_bytes(empty).count() == 0


def test_column_wise_order_is_the_suffix_order():
    import numpy as np
    from vigil.llm.bwt import sorted_suffixes
    rng = random.Random(3)
    for alphabet in (b"abc", bytes([0, 7, 255])):
        for _ in range(60):
            ss = [bytes(rng.choice(alphabet) for _ in range(rng.randrange(0, 12))) for _ in range(rng.randrange(1, 12))]
            ends = np.r_[0, np.cumsum([len(s) for s in ss])].astype(np.int64)
            who, at = sorted_suffixes(np.frombuffer(b"".join(ss), np.uint8), ends, 2)
            assert [ss[w][a:] for w, a in zip(who, at)] == sorted(s[i:] for s in ss for i in range(len(s) - 1))


# -- every column name that a module makes up may be an input column too

@pytest.mark.parametrize("module", ["mixing", "simhash", "langid", "decontam"])
def test_input_columns_named_like_the_modules_own(spark, edge, module):
    import importlib
    import re
    m = importlib.import_module(f"vigil.llm.{module}")
    with open(m.__file__, encoding="utf-8") as f:
        names = {x.lower() for x in re.findall(r'"([A-Za-z_][A-Za-z_0-9]*)"', f.read())} - {c.lower() for c in edge.columns}
    names |= {"__cdf", "__parts", "kept_id", "kept_mark"}
    docs = edge.select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(7).alias(n) for n in sorted(names)])
    keep = {"mixing": mixing.mix, "simhash": simhash.drop_near_duplicates, "langid": lambda d: langid.keep_identified(d, d),
            "decontam": lambda d: decontam.decontaminate(d, spark.createDataFrame(ITEMS, "item_id long, text string"))}[module]
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    out = keep(docs)
    assert out.columns == docs.columns and rows(out, *plain.columns) == rows(keep(plain), *plain.columns)
    if out.count():
        assert {tuple(r) for r in out.select(*sorted(names)).distinct().collect()} == {(7,) * len(names)}
