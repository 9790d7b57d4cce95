"""Search, archives, URLs, packing, near duplicates, decontamination, pipeline."""

import random
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from slotwise.llm import decontaminate, neardup, packing, revisit, topk, urlfilter
from slotwise.llm.words import NOT_WORD, word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids or range(len(texts)), texts)], DOCS)


def prose(r, n, vocabulary=4000):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


# ---- top-k

@pytest.mark.parametrize("size", [1, 2**20, 2**30, 2**70])
def test_tiles_equal_brute_force(size):
    """Exact scores and ranks also where products leave 53 or 64 bits."""
    g = np.random.default_rng(1)
    x = np.floor(g.normal(0, 200, (2500, 16))) * size + np.floor(g.normal(0, 3, (2500, 16)))
    x[100:140] = x[7]  # ties
    ids = g.permutation(2500).astype(np.int64)
    q_ids, q = np.array([ids[7], ids[9], -1, ids[3]]), np.vstack([x[[7, 9]], np.zeros((1, 16)), -x[[3]]])
    best, products = topk.Best(4, 10, [-np.inf] * 4), 0
    for a in range(0, 2500, 500):
        products += topk.search_tile(q_ids, q, ids[a : a + 500], x[a : a + 500], best)
    whole = [[int(v) for v in r] for r in x.tolist()]
    for i in range(4):
        w = [int(v) for v in q[i].tolist()]
        every = sorted((-sum(a * b for a, b in zip(w, r, strict=True)), int(d)) for r, d in zip(whole, ids, strict=True) if d != q_ids[i])[:10]
        assert every == [(-int(s), int(d)) for s, d in zip(best.scores[i], best.ids[i], strict=True)]
    assert products < 4 * 2500 * 16


def test_topk_edges(spark):
    rows = [(0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (100, [0.5], 2), (1, [0.25, -1.0], 3), (1, [0.25, -1.0], 3), (2, None, 4), (3, [1.0, None], 5), (4, [float("nan"), 1.0], 6), (5, [float("inf"), 1.0], 7), (None, [1.0, 1.0], 8), (6, [0.25, -1.0], 9), (7, [], 9)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    found = [tuple(r) for r in topk.maxscore_topk(docs, 100, 10).orderBy("query_id", "rank").collect()]
    low = 1024 * 256 - 512 * 1024
    assert found == [(0, 1, 100, 1024 * 512), (0, 2, 7, 0), (0, 3, 1, low), (0, 4, 1, low), (0, 5, 6, low), (100, 1, 0, 512 * 1024), (100, 2, 0, 512 * 1024), (100, 3, 1, 512 * 256), (100, 4, 1, 512 * 256), (100, 5, 6, 512 * 256), (100, 6, 7, 0)]
    assert topk.maxscore_topk(docs.limit(0), 100, 10).count() == 0


def test_topk_in_blocks(spark, monkeypatch):
    """Several blocks of queries, floors from a sample, many tiles; scores that
    no double holds, and ones that 64 bits don't."""
    g = np.random.default_rng(2)
    for size in (1.0, 3e5, 1e12):
        x = g.normal(0, size, (900, 8))
        docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
        whole = [[int(v) for v in r] for r in np.floor(1024 * x).tolist()]
        for name, value in (("QUERY_BLOCK", 4), ("SEEDS", 60), ("TILE", 100)):
            monkeypatch.setattr(topk, name, value)
        found = [tuple(r) for r in topk.maxscore_topk(docs, 100, 5).orderBy("query_id", "rank").collect()]
        expected = []
        for q in range(0, 900, 100):
            every = sorted((-sum(a * b for a, b in zip(whole[q], r, strict=True)), i) for i, r in enumerate(whole) if i != q)[:5]
            expected += [(q, n + 1, i, min(-s, 2**63 - 1)) for n, (s, i) in enumerate(every)]
        assert found == expected


# ---- archives

RECORDS = "record_id long, url string, time long, type string, etag string, last_modified long, digest string, headers map<string,string>"


def test_revisits(spark, monkeypatch):
    monkeypatch.setattr(revisit, "SLICE_ROWS", 2)
    rows = [
        (1, "http://www.a.example/x/?b=2&a=1&utm_source=q#top", 10, "response", '"1"', None, "d1", {"ETag": '"1"', "Content-Type": "text/html", "Date": "10"}),
        (2, "https://A.example:443/x?a=1&b=2", 20, "revisit", 'W/"1"', None, None, {"Date": "20", "Set-Cookie": "no"}),
        (3, "http://a.example/x?a=1&b=2", 30, "response", '"2"', None, "d2", {}),
        (4, "http://a.example/x?a=1&b=2", 40, "revisit", '"1"', None, None, {}),
        (5, "http://b.example/", 50, "revisit", None, 7, None, None),
        (6, "http://b.example", 60, "response", None, 7, "d3", None),
        (7, "http://b.example", 60, "revisit", None, 7, None, {"Expires": "9"}),
        (8, "http://b.example", 70, "revisit", '"x"', None, None, {}),
        (9, None, 70, "revisit", None, None, None, {}),
        (10, "http://c.example", 70, None, None, None, None, {}),
    ]
    docs = spark.createDataFrame(rows, RECORDS).withColumns({"slice": F.lit("clash"), "full": F.lit(1)})
    found = {r["record_id"]: (r["url_key"], r["source_id"], r["outcome"], r["digest"], r["headers"]) for r in revisit.resolve(docs).collect()}
    assert found == {
        2: ("a.example/x?a=1&b=2", 1, "resolved", "d1", 'content-type: text/html\ndate: 20\netag: "1"'),
        4: ("a.example/x?a=1&b=2", 3, "validator mismatch", None, None),
        5: ("b.example", None, "no earlier response", None, None),
        7: ("b.example", 6, "resolved", "d3", "expires: 9"),
        8: ("b.example", 6, "no common validator", None, None),
    }
    assert revisit.resolve(docs.limit(0)).count() == 0


# ---- URLs

def test_url_rules(spark):
    urls = [None, "", "nothing", "http://A.Example.COM/en/8?x", "https://example.com/en/71", "http://example.com", "http://x.net/de/9", "http://example.net/de/80", "http://m.example.net/de/8", "ftp://org/es/", "http://norg/es/1", "http://com/en/7#f"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, label string")
    found = {r["page_id"]: tuple(r)[1:5] for r in urlfilter.judge(pages).collect()}
    assert [found[i][2] for i in range(len(urls))] == [None, None, None, "com/en/", "example.com/en/7", None, "net/de/", "example.net/de/8", "example.net/de/8", "org/es/", None, "com/en/"]
    assert [found[i][3] for i in (3, 4, 6, 7, 9)] == ["block", "allow", "allow", "block", "block"]
    assert found[3][:2] == ("a.example.com", "/en/8") and found[0][:2] == found[2][:2] == ("", "") and found[5][:2] == ("example.com", "")
    assert all(f[3] in ("allow", "block") for f in found.values())
    assert urlfilter.judge(pages.limit(0)).count() == 0
    assert {r["verdict"] for r in urlfilter.judge(pages.where("page_id < 3")).collect()} == {"allow"}


def test_rules_equal_sql(spark):
    """Host, path, rule and the rules' verdicts against SQL on whole pages."""
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in urlfilter.RULES)
    found = urlfilter.judge(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), rounds=2).toPandas()
    sql = duckdb.sql(f"""
        WITH r(v, h, p) AS (VALUES {rules}),
        u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM '/root/testdata/sf0.01/pages.parquet'),
        s AS (SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
        SELECT page_id, host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
        FROM s LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY 1, 2, 3""").df()
    both = found.merge(sql, on="page_id", suffixes=("", "_sql"))
    assert len(both) == len(found) == len(sql) and (both.host == both.host_sql).all() and (both.path == both.path_sql).all()
    assert (both.rule.fillna("") == both.rule_sql.fillna("")).all() and (both.verdict == both.verdict_sql)[both.rule.notna()].all()


def test_trees_beat_the_majority_on_held_out_urls(spark):
    row = urlfilter.held_out_accuracy(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")).first()
    assert row["n"] > 100 and row["accuracy"] > row["majority"] + 0.05


def test_own_label_is_in_no_feature(spark, monkeypatch):
    """A suffix share leaves out the row's own fold, joined by broadcast or in parts."""
    pages = spark.createDataFrame([(i, f"http://s{i % 3}.{'com/en' if i % 2 else 'net/de'}/{i}") for i in range(300)], "page_id long, url string")
    first = urlfilter.featured(pages).select("page_id", "f_suffix_block", "suffix", "label", "fold").toPandas()
    for r in first.itertuples():
        others = first[(first.suffix == r.suffix) & (first.fold > 0) & ((first.fold != r.fold) | (r.fold == 0))]
        assert r.f_suffix_block == pytest.approx(((others.label == "block").sum() + 1) / (len(others) + 2))
    monkeypatch.setattr(urlfilter, "BROADCAST", 0)
    again = urlfilter.featured(pages).select("page_id", "f_suffix_block").toPandas()
    assert sorted(map(tuple, again.values.tolist())) == sorted(map(tuple, first[["page_id", "f_suffix_block"]].values.tolist()))


# ---- packing

def test_tokens_equal_the_tokenizer():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, r = Tokenizer.from_file(path), random.Random(2)
    texts = ["", "it's  \n\n x", "<|endoftext|> a", "x <|endoftext|><|endoftext|>y", "<|endoftext", "<|startoftext|>", " " * 300, "a" * 300, "　x é́ 1234 ½"] + ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0x300), r.randrange(0x300, 0xD000), r.randrange(0x1F000, 0x1FAFF)])) for _ in range(50)) for _ in range(400)]
    assert all(t.encode(x, add_special_tokens=False).ids == packing.ids_of(x, path)[:-1].tolist() for x in texts)
    assert packing.ids_of("<|endoftext|>", path).tolist() == [50256, 0]
    long = "a" + " " * 1_000_000
    assert packing.ids_of(long, path).tolist() == [*t.encode(long, add_special_tokens=False).ids, 0]


def test_packing(spark):
    r = random.Random(3)
    docs = frame(spark, [prose(r, r.randrange(1, 1500)) for _ in range(150)] + [None, "", "x", "x"], [*range(150), 150, 151, None, None]).withColumn("part", F.lit("clash"))
    rows = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).toPandas().sort_values(["sequence_id", "offset"])
    for _, s in rows.groupby("sequence_id"):
        assert list(s.offset) == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 2048
    for _, d in rows[rows.doc_id < 150].groupby("doc_id"):
        d = d.sort_values("piece")
        assert list(d.start) == [0, *np.cumsum(d.length)[:-1]] and (d.length[1:] == 2048).all()
    assert (rows[rows.doc_id.isin([150, 151])].length == 1).all() and len(rows[rows.doc_id.isna()]) == 2
    assert rows.sequence_id.nunique() <= np.ceil(rows.length.sum() / 2048) * 1.05
    assert packing.pack(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_repeated_rows_are_spread(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 100)
    docs = spark.createDataFrame([(None, "the same words")] * 3000, "doc_id long, text string")
    rows = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumn("part", F.col("sequence_id") / 2**32)
    sizes = [r["count"] for r in rows.groupBy(F.floor("part")).count().collect()]
    assert sum(sizes) == 3000 and max(sizes) < 300


def test_sum_of_squares_choice():
    """Each piece goes where the squares of the open bins per gap, counted
    anew for every choice, are fewest; a new bin only if none has room."""
    r, capacity = random.Random(12), 12
    for _ in range(60):
        gaps: list[int] = []
        sizes = [r.randrange(1, capacity + 1) for _ in range(25)]
        number, offset = packing.sum_of_squares(np.array(sizes), capacity)
        for s, b, o in zip(sizes, number.tolist(), offset.tolist()):

            def squares(i):
                left = [g - s * (j == i) for j, g in enumerate(gaps)]
                return sum(left.count(g) ** 2 for g in set(left) - {0})

            room = [i for i, g in enumerate(gaps) if g >= s]
            if room:
                assert b < len(gaps) and squares(b) == min(map(squares, room)) and o == capacity - gaps[b]
            else:
                assert b == len(gaps) and o == 0
                gaps.append(capacity)
            gaps[b] -= s


# ---- near duplicates

def exact_classes(spark, docs, texts):
    """The smallest number of each text's class, by verifying every pair."""
    levels = neardup.rarity(neardup.frequencies(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))), len(texts))
    sets = [neardup.weighted(t or "", levels) for t in texts]
    # texts that share no shingle have a similarity of 0, so every other pair is every pair
    holders = {}
    for i, (shingle, _) in enumerate(sets):
        for x in shingle.tolist() or [texts[i] or ""]:
            holders.setdefault(x, []).append(i)
    root = list(range(len(texts)))
    for i, j in sorted({(i, j) for held in holders.values() for i in held for j in held if j < i}):
        if root[i] != root[j] and ((texts[i] or "") == (texts[j] or "") or neardup.jaccard(sets[i], sets[j]) >= neardup.THRESHOLD):
            low, high = sorted((root[i], root[j]))
            root = [low if x == high else x for x in root]
    return root


def family(r, base, n, edits):
    """The base text with some of its words replaced, n times."""
    for _ in range(n):
        w = list(base)
        for at in r.sample(range(len(w)), r.randint(*edits)):
            w[at] = f"x{r.randrange(10**6)}"
        yield " ".join(w)


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(5)
    texts = [prose(r, r.randrange(30, 200)) for _ in range(60)]
    for t in texts[:20]:
        for _ in range(r.randrange(1, 5)):
            w = t.split()
            w[r.randrange(len(w))] = "other"
            texts.append(" ".join(w))
    texts += [texts[0], texts[0], texts[3].upper(), "", "", None, "short text", "short text", prose(r, 60) + " " + " ".join(texts[5].split()[:10])]
    docs = frame(spark, texts).withColumns({"node": F.lit("clash"), "key": F.lit(1), "sk": F.lit(2)})
    found = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs).collect()}
    assert len(found) == len(texts)
    root = exact_classes(spark, docs, texts)
    find = lambda i: root[i]
    expected = {}
    for i in range(len(texts)):
        expected.setdefault(find(i), []).append(i)
    classes = {}
    for i, c in found.items():
        classes.setdefault(c, []).append(i)
    assert sorted(map(sorted, expected.values())) == sorted(map(sorted, classes.values()))
    assert all(min(c) == k for k, c in classes.items())
    kept = neardup.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == len(classes)


def test_large_group_and_edges(spark):
    r = random.Random(6)
    base = prose(r, 150).split()
    texts = []
    for _ in range(900):  # more than a part holds
        w = list(base)
        for _ in range(r.randrange(2)):
            w[r.randrange(150)] = f"z{r.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [prose(r, 80) for _ in range(50)]
    found = neardup.near_duplicates(frame(spark, texts)).groupBy("class_id").count().collect()
    assert sorted(r["count"] for r in found) == [1] * 50 + [900]
    assert neardup.near_duplicates(frame(spark, texts[:1]).limit(0)).count() == 0
    ids = neardup.near_duplicates(frame(spark, ["a b c d e f", "a b c d e f", "x"], [None, 7, None])).collect()
    assert sorted(str(r["class_id"]) for r in ids) == ["7", "7", "None"] and sum(r["first"] for r in ids) == 2


@pytest.mark.parametrize(("families", "size", "words", "edits", "part"), [(80, 6, 120, (1, 4), 256), (12, 14, 130, (1, 3), 256), (12, 14, 130, (1, 3), 4), (1, 60, 120, (3, 4), 8)])
def test_no_link_is_lost(spark, monkeypatch, families, size, words, edits, part):
    """Families of texts around the threshold, in one block and in several: the
    classes are those of comparing every pair."""
    r = random.Random(12)
    texts = [t for _ in range(families) for t in family(r, prose(r, words).split(), size, edits)]
    docs = frame(spark, texts)
    monkeypatch.setattr(neardup, "PART", part)
    found = {x["doc_id"]: x["class_id"] for x in neardup.near_duplicates(docs).collect()}
    assert [found[i] for i in range(len(texts))] == exact_classes(spark, docs, texts)


def test_recall_of_pairs_by_their_similarity():
    """At the threshold itself a pair shares a bucket and looks plausible."""
    r, levels, found, n = random.Random(14), np.full(neardup.BUCKETS, 7, np.uint8), 0, 0
    while n < 400:
        a, b = family(r, prose(r, 120, 10**6).split(), 2, (1, 2))
        if 0.8 <= neardup.jaccard(neardup.weighted(a, levels), neardup.weighted(b, levels)) < 0.84:
            n += 1
            s = np.stack([neardup.samples(x, t, levels[neardup.bucket_of(x)]) for x, t in (neardup.batch_counted([y])[1:] for y in (a, b))])
            keys = neardup.band_keys(s)
            found += bool((keys[0] == keys[1]).any() and (s[0] == s[1]).mean() >= neardup.PLAUSIBLE)
    assert found >= 0.99 * n


def test_samples_of_a_set_follow_the_definition():
    """The samples from tables equal those of the formula, term by term."""
    g = np.random.default_rng(3)
    r, log_c, beta = neardup._variates()[:3]
    shingle = np.unique(g.integers(0, 2**63, 3000, dtype=np.uint64))
    tf, level = np.where(g.random(len(shingle)) < 0.1, g.integers(2, 9, len(shingle)), 1), g.integers(0, 8, len(shingle)).astype(np.uint8)
    row = (shingle >> np.uint64(40)).astype(int) & (neardup.VARIATES - 1)
    w = np.log((1 + np.log(tf)) * neardup.LEVELS[level]).astype(np.float32)[:, None]
    t = np.floor(w / r[row] + beta[row])
    first = (log_c[row] - r[row] * (t - beta[row] + 1)).argmin(axis=0)
    ids = neardup.mix(shingle[first] + t[first, np.arange(neardup.SAMPLES)].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    assert (neardup.samples(shingle, tf, level) == ids).mean() > 0.98  # but for the rounding of ties


def test_consistent_samples_estimate_similarity():
    r, levels = random.Random(7), np.zeros(neardup.BUCKETS, np.uint8)
    differences = []
    for _ in range(40):
        w = [f"q{r.randrange(10**6)}" for _ in range(300)]
        v = [x if r.random() > 0.02 else "y" + x for x in w]
        sets = [neardup.batch_counted([" ".join(x)])[1:] for x in (w, v)]
        s = [neardup.samples(x, tf, levels[neardup.bucket_of(x)]) for x, tf in sets]
        differences.append((s[0] == s[1]).mean() - neardup.jaccard(*(neardup.weighted(" ".join(x), levels) for x in (w, v))))
    assert abs(np.mean(differences)) < 0.03


def test_counts_of_several_texts_are_those_of_each():
    r = random.Random(15)
    texts = ["", "one", "a b c d", prose(r, 40, 5), "", "A b  c\nd e", prose(r, 9)]
    number, shingle, tf = neardup.batch_counted(texts)
    for i, t in enumerate(texts):
        _, one, n = neardup.batch_counted([t])
        assert one.tolist() == shingle[number == i].tolist() and n.tolist() == tf[number == i].tolist()
    assert tf[number == 0].sum() == 0 and tf[number == 2].tolist() == [1]
    words = prose(r, 12, 3).split()
    assert neardup.batch_counted([" ".join(words)])[2].sum() == 8


def test_near_duplicates_of_odd_tables(spark):
    """Clashing names, very long texts, nulls and repeated rows."""
    r = random.Random(16)
    long = prose(r, 60_000).split()
    texts = [" ".join(long), " ".join([*long[:-50], "end"]), None, "", "x", "x"]
    docs = frame(spark, texts, [5, 3, None, None, 8, 8]).withColumns({"own_id": F.lit(1), "text_hash": F.lit("c"), "root": F.lit(2), "n": F.lit(3), "first": F.lit(4)})
    found = neardup.near_duplicates(docs).collect()
    assert sorted(str(x["class_id"]) for x in found) == ["3", "3", "8", "8", "None", "None"]
    kept = neardup.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(str(x["doc_id"]) for x in kept.collect()) == ["3", "8", "None"]
    assert neardup.deduplicated(docs.limit(0)).count() == 0


# ---- decontamination

def test_contamination(spark):
    r = random.Random(9)
    items = [prose(r, n, 10**6) for n in (3, 8, 15, 25, 40, 60)]
    rows, expected = [], set()
    for i, item in enumerate(items):
        for edits in range(int(0.2 * len(item.split())) + 1):
            w = item.split()
            for _ in range(edits):
                at, how = r.randrange(len(w)), r.randrange(3)
                w[at : at + 1] = [["new"], [], [w[at], "more"]][how]
            rows.append(prose(r, 30, 10**6) + " " + " ".join(w).upper().replace(" ", ", ") + ". " + prose(r, 30, 10**6))
            expected.add((len(rows) - 1, i))
    rows += [prose(r, 200, 10**6), None, "", " ".join(items[5].split()[:20])]
    docs = frame(spark, rows).withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame([*enumerate(items), (9, None), (10, ""), (11, "?!"), (0, items[0])], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()}
    true = {(d, i) for d, i in expected if decontaminate.distance(word_hashes(items[i], NOT_WORD)[0], word_hashes(rows[d], NOT_WORD)[0])[0] <= int(0.2 * len(items[i].split()))}
    assert found == true and len(true) >= 0.9 * len(expected)
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(len(rows))) - {d for d, _ in true}
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0 and decontaminate.contaminated(docs.limit(0), bench).count() == 0


def test_distance_equals_plain_dynamic_programming():
    r = random.Random(10)
    for _ in range(200):
        a, b = ([np.uint64(r.randrange(4)) for _ in range(n)] for n in (r.randrange(1, 7), r.randrange(1, 12)))
        table = [[0] * (len(b) + 1)] + [[i + 1] + [0] * len(b) for i in range(len(a))]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = min(table[i][j] + (x != y), table[i][j + 1] + 1, table[i + 1][j] + 1)
        assert decontaminate.distance(np.array(a), np.array(b))[0] == min(table[-1])


def test_recall_against_exhaustive_search(spark):
    """Items of many lengths with every edit allowed, at random places: the
    candidates of the hash tables against the edit distance to every document."""
    r = random.Random(21)
    items = [prose(r, n, 3000) for n in [*range(1, 30), 40, 50, 60] for _ in range(4)]
    prepared = decontaminate.prepared(list(enumerate(items)))
    assert 4 <= len(prepared.tables) <= decontaminate.MOST
    texts = []
    for item in items:
        w = item.split()
        for _ in range(int(0.2 * len(w))):
            at, how = r.randrange(len(w)), r.randrange(3)
            w[at : at + 1] = [["new"], [], [w[at], "more"]][how]
        texts.append(prose(r, 25, 3000) + " " + " ".join(w) + " " + prose(r, 25, 3000))
    found = {(d, i) for d, i, *_ in decontaminate.Matcher(prepared).matches(texts)}
    hashes = [word_hashes(t, NOT_WORD)[0] for t in texts]
    true = {(d, i) for d, h in enumerate(hashes) for i, w in enumerate(prepared.words) if decontaminate.distance(w, h)[0] <= prepared.edits[i]}
    assert found <= true and len(true) >= len(items) and len(found) >= 0.98 * len(true)
    long = [(i, w) for i, w in enumerate(prepared.words) if len(w) >= 10]
    wide = {(d, i) for d, i in true if len(prepared.words[i]) >= 10}
    assert long and len(found & wide) >= decontaminate.TARGET * len(wide)


def test_repetitions_reach_the_target():
    r = random.Random(22)
    items = decontaminate.prepared([(i, prose(r, r.randrange(15, 60))) for i in range(50)])
    assert (decontaminate.first_hits(items, seed=99) < decontaminate.MOST).mean() >= decontaminate.TARGET - 0.01


def test_samples_are_those_of_the_walk():
    """The sampled keys against the embedding, written step by step."""
    g = np.random.default_rng(4)
    words = g.integers(0, 2**63, 60, dtype=np.uint64)
    for repetition, size in ((0, 14), (3, 6), (7, 1)):
        got = decontaminate.samples(words, repetition, [size])[size]
        for p in range(60):
            at, embedding = p, []
            for step in range(size):
                embedding.append(words[at] if at < 60 else np.uint64(0))
                at += int(decontaminate.mix(words[min(at, 59) :][:1] ^ decontaminate.WALK[repetition])[0] >> np.uint64(step)) & 1
            key = np.array([size], np.uint64)
            for place in sorted(set((decontaminate.PLACES[repetition] * size).astype(int).tolist())):
                key = key * decontaminate.SPREAD + embedding[place]
            assert decontaminate.mix(key)[0] == got[p]


def test_long_texts_are_searched_whole(spark):
    r = random.Random(23)
    item = prose(r, 30, 10**6)
    docs = frame(spark, [prose(r, 200_000) + " " + item + " " + prose(r, 50)])
    found = decontaminate.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [(x["item_id"], x["edits"], x["first_word"], x["end_word"]) for x in found] == [(1, 0, 200_000, 200_030)]


# ---- pipeline

def write_tables(spark, folder, docs, labels, bench):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        yield name, docs


def test_pipeline_of_empty_tables(spark, tmp_path):
    write_tables(spark, str(tmp_path), frame(spark, ["x"]).limit(0), [], [])
    for name, docs in stages(spark, str(tmp_path)):
        assert docs.count() == 0 and (name == "packing" or docs.columns == list(corpus_pipeline.COLUMNS))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Nulls, empty, very long and repeated rows, further columns and absent
    ones; every stage's decision against a plain one."""
    r = random.Random(31)
    item, long = prose(r, 30, 10**6), prose(r, 30_000)
    texts = [long, None, "", "x", "x", item, prose(r, 80) + " card 4111.1111.1111.1111 or a@b.com"]
    ids = [1, 2, 3, 4, 4, None, 6]
    docs = spark.createDataFrame([(i, t, 7) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, node int").withColumns({"score": F.lit("c"), "first": F.lit(True), "own_id": F.lit(1.5)})
    write_tables(spark, str(tmp_path), docs, [], [(1, item), (2, None)])
    seen = {}
    for name, out in stages(spark, str(tmp_path)):
        assert name == "packing" or out.columns == docs.columns
        seen[name] = sorted(str(x["doc_id"]) for x in out.collect())
    assert seen["quality"] == ["1", "2", "3", "4", "4", "6", "None"]  # without labels nothing is rejected
    assert seen["near_duplicates"] == ["1", "2", "4", "6", "None"]
    assert seen["decontamination"] == seen["pii"] == ["1", "2", "4", "6"] and set(seen["packing"]) == {"1", "2", "4", "6"}
    text = {x["doc_id"]: x["text"] for x in spark.read.parquet(str(tmp_path / "pii")).collect()}
    assert "[EMAIL]" in text[6] and text[1] == long and text[2] is None
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert again.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and again.count() == len(seen["packing"])


def test_pipeline_stages(spark, tmp_path):
    r = random.Random(11)
    item = prose(r, 30)
    good = [prose(r, r.randrange(60, 200)) for _ in range(80)]
    texts = good + [good[0], good[1] + " extra", "intro " + item + " outro", good[2] + " mail me at joe@example.com now"] + [("LOUD!! " + x.upper().replace(" ", "!! ")) for x in good[40:70]] + [None, ""]
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, int(not 84 <= i < 114), 0) for i in range(114)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert name == "packing" or docs.columns == list(corpus_pipeline.COLUMNS)
    assert not seen["quality"] & set(range(84, 114)) and set(range(80)) <= seen["quality"]
    assert seen["quality"] - seen["near_duplicates"] >= {80, 81} and set(range(80)) <= seen["near_duplicates"]
    assert seen["near_duplicates"] - seen["decontamination"] == {82}
    assert all("@" not in (r["text"] or "") for r in spark.read.parquet(str(tmp_path / "pii")).collect())
    assert seen["packing"] == seen["pii"] == seen["decontamination"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "pii", "packing"]


def test_sql_oracles(spark):
    import duckdb

    from slotwise.llm import queries

    con = duckdb.connect()
    for name in ("embeddings", "pages"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    for name, sql in queries.ORACLES.items():
        found, expected = queries.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas(), con.sql(sql).df()
        names = sorted(found.columns)
        text = lambda d: sorted(re.sub(r"\.0\b", "", str([None if v != v else v for v in row])) for row in d[names].astype(object).where(d[names].notna(), None).values.tolist())
        assert names == sorted(expected.columns) and text(found) == text(expected)
