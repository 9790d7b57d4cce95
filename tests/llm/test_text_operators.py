"""Spans, words, toxicity and quality on small inputs."""

import base64
import bz2
import gzip
import lzma
import random
import re
import time
import urllib.parse
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from slotwise.llm import labelled, pii, quality, secrets, spans, toxicity, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EDGE_ROWS = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "one", "en", "s", 3), (3, "one", "en", "s", 3), (None, "a null id", "en", "s", 9), (4, "word " * 40_000, "en", "s", 200_000)]


@pytest.fixture(scope="module")
def edge_docs(spark):
    rows = spark.createDataFrame(EDGE_ROWS, DOCS)
    return rows.withColumns({"score": F.lit("clash"), "node": F.lit(1), "spans": F.lit(2), "y": F.lit("x"), "fold": F.lit(0)})


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


PII = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_pii(text):
    for kind, p in enumerate(PII):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == pii.IP and not all(int(x) <= 255 for x in m[0].split(".")) or kind == pii.CARD and not (12 <= len(digits) <= 19 and pii.luhn(digits)) or kind == pii.PHONE and not 9 <= len(digits) <= 15:
                continue
            yield kind, m.start(), m.end()


@pytest.mark.parametrize("alphabet", ["019.@-+ ab()", "0129.- ", "a@.b-", "+1 ()-2"])
def test_base_pii_equals_plain_patterns(alphabet):
    r = random.Random(alphabet)
    for _ in range(4000):
        text = "".join(r.choice(alphabet) for _ in range(r.randrange(50)))
        assert sorted(plain_pii(text)) == sorted(pii.base_spans(text)), text


@pytest.fixture(scope="module")
def finder():
    return pii.Finder(pii.train(pii.examples([])))


def test_field_adds_disguised_spans(finder):
    text = "ip 10[.]2[.]3[.]4 ok, mail bob@mail.example.com"
    base, every = finder.spans(text)
    assert every[: len(base)] == base == [(pii.EMAIL, 27, 47)]
    assert "10[.]2[.]3[.]4" in [text[a:b] for _, a, b in every]


def test_field_leaves_plain_numbers_alone(finder):
    for text in ("order 2024-01-05 12:30:22 id 99812", "version 1.2.3 build 20", "1,234,567.89 in total", "page 3 of 17", "no numbers at all"):
        assert finder.spans(text) == ([], [])


@pytest.mark.parametrize(("kind", "text"), [
    (pii.PHONE, "020 7946 0958"), (pii.PHONE, "06 12 34 56 78"), (pii.PHONE, "(555) 123-4567"), (pii.PHONE, "555-123-4567"), (pii.CARD, "3782.822463.10005"), (pii.EMAIL, "joe (at) mail dot example dot com"),
    (pii.EMAIL, "jane at example dot com"), (pii.EMAIL, "christopher.wellington (at) mathematics dot example dot com"), (pii.IP, "10 dot 1 dot 22 dot 4"), (pii.IP, "192 . 168 . 0 . 17"),
])
def test_disguised_forms(finder, kind, text):
    for before, after in (("call me at ", " please"), ("we have ", ", and"), ("", "")):
        assert (kind, len(before), len(before) + len(text)) in finder.spans(before + text + after)[1]


def test_recall_on_held_out_forms(finder):
    """At least nine of ten disguised spans of each kind, which the training
    has not seen, at their exact place."""
    r = random.Random(99)
    for kind in range(4):
        found, n = 0, 0
        while n < 200:
            span, before = pii._disguised(kind, pii._made(kind, r), r), r.choice(["call me at ", "joe said ", "we have ", "und dann ", "see: "])
            base, every = finder.spans(before + span + r.choice([" then", ".", ", and", " bitte"]))
            if not any(k == kind and a <= len(before) and b >= len(before) + len(span) for k, a, b in base):
                n += 1
                found += (kind, len(before), len(before) + len(span)) in every
        assert found >= 0.9 * n, (pii.KINDS[kind], found)


def test_clean_documents_are_left_alone(spark):
    """Whole documents of the tables: the field, learned from them, adds next
    to nothing to what the patterns find."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    field = pii.fit(docs)
    added = base = 0
    for (text,) in docs.select("text").collect():
        own, every = field.spans(text or "")
        base, added = base + len(own), added + len(every) - len(own)
    assert base > 30 and added <= 2


def test_windows_hold_whole_tokens():
    r = random.Random(6)
    for _ in range(300):
        text = "".join(r.choice(["ab", "1", "22", " ", " ", "@", ".", "\n", "(at)", " at ", " dot ", "é", "-"]) for _ in range(r.randrange(120)))
        base = pii.base_spans(text)
        starts = {m.start() for m in pii.TOKEN.finditer(text)} | {len(text)}
        for w in pii.windows(text, base):
            assert w.start[0] in starts or any(w.start[0] == b for _, _, b in base)
            assert not any(a < w.start[-1] and b > w.start[0] for _, a, b in base)


def test_every_kind_is_sampled(spark, monkeypatch):
    monkeypatch.setattr(pii, "SAMPLE_WINDOWS", 5)
    seen = []
    monkeypatch.setattr(pii, "train", lambda x: seen.extend(x) or {})
    monkeypatch.setattr(pii, "GENERATED", 0)
    docs = spark.createDataFrame([(i, f"a{i}@b.com and +1 (555) 010-{1000 + i} then") for i in range(40)], "doc_id long, text string")
    pii.fit(docs)
    assert {k for _, gold in seen for k, _, _ in gold} == {pii.EMAIL, pii.PHONE}


def test_field_marginals_equal_enumeration():
    segments = [(0, 2, 0, [], 1.0), (1, 3, 1, [], 0.5), (2, 3, 2, [], -0.3), (0, 1, 3, [], 0.2)]

    def paths(at):
        if at == 3:
            yield 0.0, ()
            return
        for s, p in paths(at + 1):
            yield s, p
        for x, seg in enumerate(segments):
            if seg[0] == at:
                for s, p in paths(seg[1]):
                    yield s + seg[4], (x, *p)

    every = list(paths(0))
    total = sum(np.exp(s) for s, _ in every)
    assert np.allclose(pii.marginals(3, segments), [sum(np.exp(s) for s, p in every if x in p) / total for x in range(4)])
    assert tuple(pii.decoded(3, segments)) == max(every)[1]


DIGITS_SQL = "regexp_replace(x, '[^0-9]', '', 'g')"
LUHN_SQL = f"list_sum(list_transform(range(1, length({DIGITS_SQL}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST({DIGITS_SQL}[length({DIGITS_SQL}) - i + 1] AS INTEGER) ELSE CAST({DIGITS_SQL}[length({DIGITS_SQL}) - i + 1] AS INTEGER) * 2 // 10 + CAST({DIGITS_SQL}[length({DIGITS_SQL}) - i + 1] AS INTEGER) * 2 % 10 END)) % 10 = 0"


def test_base_counts_equal_sql(spark):
    """The counts of base spans of whole documents, by SQL on the patterns as
    they stand in the contract."""
    path = "/root/testdata/sf0.01/documents.parquet"
    docs = spark.read.parquet(path)
    found = pii.find(docs).toPandas().merge(secrets.find(docs).toPandas(), on="doc_id")
    sql = duckdb.sql(f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM '{path}')
        SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+')) AS n_email,
            len(list_filter(regexp_extract_all(t, '[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)'), lambda x: len(list_filter(string_split(x, '.'), lambda p: CAST(p AS DOUBLE) > 255)) = 0)) AS n_ip,
            len(list_filter(regexp_extract_all(t, '[0-9]([ -]?[0-9])+'), lambda x: length({DIGITS_SQL}) BETWEEN 12 AND 19 AND {LUHN_SQL})) AS n_card,
            len(list_filter(regexp_extract_all(t, '\\+[0-9][ ().0-9-]+[0-9]'), lambda x: length({DIGITS_SQL}) BETWEEN 9 AND 15)) AS n_phone,
            len(list_filter(regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6)) AS n_assign,
            len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS n_access, len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24)) AS n_hex FROM d""").df()
    both = found.merge(sql, on="doc_id", suffixes=("", "_sql"))
    assert len(both) == len(found) == len(sql)
    for n in ("n_email", "n_ip", "n_card", "n_phone", "n_assign", "n_access", "n_hex"):
        assert (both[n] == both[f"{n}_sql"]).all() and both[n].sum() > 0 or n == "n_access", n


def test_masking():
    assert spans.masked("a b@c.de, 1.2.3.4", [(0, 2, 8), (1, 10, 17), (0, 3, 5)], pii.KINDS) == "a [EMAIL], [IP]"
    assert spans.masked("", [], pii.KINDS) == ""


def test_pii_edges(edge_docs, no_docs):
    found = pii.find(edge_docs).collect()
    assert len(found) == len(EDGE_ROWS) and {r["spans"] for r in found} == {""}
    assert pii.find(no_docs).count() == 0 == pii.redacted(no_docs).count()
    out = pii.redacted(edge_docs)
    assert out.columns == edge_docs.columns and out.where("text is null").count() == 1


SECRET = 'token = "abcdef123456"'


@pytest.mark.parametrize("hide", [
    urllib.parse.quote, lambda s: urllib.parse.quote(urllib.parse.quote(s)), lambda s: base64.b64encode(s.encode()).decode(), lambda s: base64.b64encode(gzip.compress(s.encode())).decode(),
    lambda s: base64.b64encode(base64.b64encode(s.encode())).decode(), lambda s: "".join(f"\\u{ord(c):04x}" for c in s), lambda s: urllib.parse.quote(base64.b64encode(zlib.compress(s.encode())).decode()),
    lambda s: base64.b64encode(gzip.compress(gzip.compress(s.encode()))).decode(), lambda s: base64.b64encode(lzma.compress(bz2.compress(zlib.compress(s.encode())))).decode(),
    lambda s: base64.b64encode(gzip.compress(b"one") + gzip.compress(s.encode())).decode(), lambda s: base64.b64encode(s.encode("utf-16-le")).decode(), lambda s: base64.b64encode(s.encode("utf-16-be")).decode(),
    lambda s: base64.encodebytes(b"words that come before, line by line " * 4 + s.encode() + b" and some after it" * 4).decode(), lambda s: base64.b64encode(b"\xff" + s.encode() + b"\xfe").decode(),
    lambda s: "files/" + base64.b64encode(s.encode()).decode(), lambda s: "files/" + base64.b64encode(zlib.compress(s.encode())).decode(), lambda s: "".join(f"\\u{{{ord(c):x}}}" for c in s),
    lambda s: "".join(f"%5Cu{ord(c):04x}" for c in s), lambda s: "".join("%" + "25" * 9 + f"{ord(c):02x}" for c in s), lambda s: base64.b64encode(gzip.compress(b"\0" * (2 * secrets.PIECE) + s.encode() + b"\0" * 99)).decode(),
])
def test_hidden_secrets(hide):
    inner = hide(SECRET)
    text = f"before {inner} after"
    assert secrets.scan(text) == [] and {k for k, _, _ in secrets.hidden(text)} == {secrets.ASSIGN}
    _, a, b = max(secrets.hidden(text), key=lambda s: s[2] - s[1])
    inner = inner.rstrip()
    assert 7 <= a < b <= 7 + len(inner)


def test_secret_scan_equals_plain_patterns():
    assign = r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    r = random.Random(1)
    for _ in range(4000):
        text = "".join(r.choice(["token", "PASSWORD", "api_key", " ", "=", ":", '"', "abc123", "AKIA", "AKIAABCDEF", "0123456789abcdef", "deadbeef0", "Z", "ſecret"]) for _ in range(r.randrange(12)))
        plain = [(0, m.start(), m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 6] + [(1, m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20] + [(2, m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        assert sorted(plain) == sorted(secrets.scan(text))


def test_wrapped_and_compressed():
    """A payload over several lines is one layer, also if it is compressed."""
    r = random.Random(2)
    text = "x\n" + base64.encodebytes(gzip.compress(r.randbytes(300) + SECRET.encode() + r.randbytes(90))).decode()
    assert any(k == secrets.ASSIGN and a == 2 for k, a, _ in secrets.hidden(text))


def test_layers_end(monkeypatch):
    assert secrets.hidden("%25" * 50) == [] and secrets.hidden("QUFB" * 30) == [] and secrets.hidden("\\u0025" * 40) == []
    bomb = base64.b64encode(zlib.compress(b"\0" * 2**23)).decode()
    assert secrets.hidden(bomb) == []
    monkeypatch.setattr(secrets, "MOST", 2**20)
    assert {k for k, _, _ in secrets.hidden(bomb)} == {secrets.OPAQUE}


def test_long_escapes_take_linear_time():
    began = time.perf_counter()
    assert secrets.hidden("%" + "25" * 500_000 + "41") == []
    assert time.perf_counter() - began < 5  # half a second on an idle core; a quadratic way takes hours


def test_escapes_reach_their_fixpoint():
    """The stack's result is that of decoding whole texts again and again."""
    r = random.Random(8)
    for _ in range(3000):
        text = "".join(r.choice(["%", "25", "2", "5", "41", "\\u00", "\\x", "5c", "7", "u", "{", "}", "a", " "]) for _ in range(r.randrange(25)))
        expected = text
        while True:
            once = re.sub(r"%([0-7][0-9A-Fa-f])|\\x([0-7][0-9A-Fa-f])|\\u00([0-7][0-9A-Fa-f])|\\u\{0*([0-7]?[0-9A-Fa-f])\}", lambda m: chr(int(next(x for x in m.groups() if x), 16)), expected, count=1)
            if once == expected:
                break
            expected = once
        if re.search(r"%[89A-Fa-f]|\\x[89A-Fa-f]|\\u00[89a-fA-F]|\\u\{", text + expected):
            continue
        n = len(text)
        layer = secrets.unescaped(secrets.Layer(text, np.arange(n), np.arange(1, n + 1), np.zeros(n, bool)))
        got = layer.text if layer else text
        assert not re.search(r"%[0-7][0-9A-Fa-f]|\\x[0-7][0-9A-Fa-f]|\\u00[0-7][0-9A-Fa-f]", got), (text, got)
        if layer:
            assert (layer.start < layer.end).all() and (np.diff(layer.start) > 0).all()


def test_secret_edges(edge_docs, no_docs):
    found = secrets.find(edge_docs).collect()
    assert len(found) == len(EDGE_ROWS) and {r["spans"] for r in found} == {""}
    assert secrets.find(no_docs).count() == 0


def test_word_hashes():
    a, start, end = words.word_hashes("One two  one\nTWO öne")
    assert list(a[:2]) == [a[2], a[3]] and len(set(a.tolist())) == 3 and list(end - start) == [3, 3, 3, 3, 4]
    assert len(words.word_hashes("")[0]) == 0 and len(words.shingles(a, 5)) == 1 and len(words.shingles(a[:3], 5)) == 1
    long, _, _ = words.word_hashes("x " * 70_000 + "one")
    assert long[-1] == a[0]


@pytest.fixture(scope="module")
def model():
    count = np.zeros((toxicity.LETTERS,) * 3)
    for w in ["stupid", "idiot", "moron", "trash", "loser", "the", "and", "worthless", "clown", "pathetic"] * 50:
        c = [0, 0, *toxicity.codes(w).tolist(), 0]
        for x in zip(c, c[1:], c[2:]):
            count[x] += 1
    return toxicity.language_model(count).tolist()


@pytest.mark.parametrize(("written", "meant"), [
    ("1d10t", "idiot"), ("$tup1d", "stupid"), ("stuuupid", "stupid"), ("s.t.u.p.i.d", "stupid"), ("tr@sh", "trash"), ("l0ser", "loser"), ("w0rthl3ss", "worthless"), ("m0r0n!!", "moron"), ("p*thetic", "pathetic"),
    ("idi07", "idiot"), ("st.upid", "stupid"), ("s-tupid", "stupid"), ("s.t.u.p.1.d", "stupid"), ("i d iot", "idiot"), ("a s t u p i d", "stupid"), ("the i d i o t", "idiot"), ("s" * 300 + "tupid", "stupid"), ("idiot.trash", "trash"), ("###trash", "trash"),
])
def test_restoring(model, written, meant):
    assert meant in {w for t in toxicity.tokens("before xxxxxx " + written + " xxxxxx after") for w in toxicity.readings(t, model)} | toxicity.readings(written, model)


def test_plain_words_stay(model):
    assert toxicity.readings("the,", model) == {"the"} and toxicity.readings("%%%", model) == set()
    assert "an i d i o t." in toxicity.tokens("an i d i o t. is") and toxicity.tokens("a loser") == {"a", "loser"}


def test_decoding_equals_enumeration(model):
    """The likeliest of all paths through the lattice, tried one by one."""
    from itertools import groupby, product

    def score(parts):
        total, u, v = 0.0, 0, 0
        for letters, p in parts:
            total += p
            if letters == " ":
                if v:
                    total, u, v = total + model[u][v][0], 0, 0
                continue
            for x in letters:
                c = toxicity._code(x)
                total, u, v = total + model[u][v][c], v, c
        return total + (model[u][v][0] if v else 0.0)

    r = random.Random(5)
    for _ in range(150):
        written = "".join(r.choice("stupid10t.-@l  ") for _ in range(r.randrange(1, 8))) + r.choice(["", "ooo", "iii"])
        options = []
        for c, run in groupby(written):
            n = len(list(run))
            mine = [(x * k, (toxicity.SELF if c.isalpha() else toxicity.LOOK) + (0 if k == n else toxicity.DROP)) for x in ([c] if c.isalpha() else toxicity.LOOKS.get(c, "")) for k in ((n,) if n < 3 else (1, 2))]
            mine += [("", toxicity.GAP), (" ", toxicity.GAP)] if c == " " else [("", toxicity.DROP), (" ", toxicity.END)] if not c.isalnum() else []
            if mine:
                options.append(mine)
        best = max(score(p) for p in product(*options))
        got = toxicity.restore(written, model)
        assert any("".join(t for t, _ in p) == got and score(p) == pytest.approx(best) for p in product(*options)), written


def test_every_word_counts(spark):
    """The strength is the sum over distinct words of their strongest unit."""
    model = toxicity.language_model(np.zeros((toxicity.LETTERS,) * 3))
    lexicon = toxicity.Lexicon(model, {"foul": 2.0, "foul-": 1.0, "vile": 3.0}, None, 0.5)
    assert lexicon.of_text("Foul, foul fouler! vile x") == (6.0, 5)
    assert toxicity.ranking(np.array([2, 2, 2.0]), np.array([0, 1, 2.0])) == pytest.approx((2 + 0.5 + 3 + 3) / 9)


def test_isotonic():
    n, p = np.array([5, 0, 5, 5, 5.0]), np.array([1, 0, 0, 4, 3.0])
    steps = labelled.isotonic(n, p)
    assert (np.diff(steps) >= -1e-12).all() and 0 < steps[0] < steps[-1] < 1
    assert (labelled.isotonic(np.zeros(3), np.zeros(3)) == 0.5).all()


def test_fourier_features_approximate_the_kernel():
    """Inner products of the features against the Gaussian kernel."""
    g = np.random.default_rng(3)
    x = g.normal(0, 1, (200, quality.WIDTH))
    f = quality.fourier(x, np.zeros(quality.WIDTH), np.ones(quality.WIDTH))[:, :-1]
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    assert np.abs(f @ f.T - np.exp(-d / (2 * quality.WIDTH))).mean() < 0.06


def test_partition_sums_give_the_ridge_solution(spark):
    """The model from per-task sums is that of one plain least-squares solve
    over all rows, whatever the partitions."""
    r = random.Random(9)
    rows, known = [], []
    for i in range(400):
        good = r.random() < 0.6
        words = [r.choice("river bends under slow sky stone and the a".split()) for _ in range(r.randrange(5, 60))]
        rows.append((i, " ".join(words if good else [w.upper() + "!!" for w in words])))
        known.append((i, int(good)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(known, "doc_id long, quality int")
    model = quality.fit(docs.repartition(7), labels)
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i, _ in rows}
    learn = [i for i, _ in rows if 0 < fold[i] < 4]
    x, y = np.array([quality.statistics(rows[i][1]) for i in learn]), np.array([known[i][1] for i in learn], float)
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, x.std(0) + 1e-6, atol=1e-5)
    z = quality.fourier(x, model.mean, model.scale)
    n = len(learn)
    plain = np.linalg.lstsq(np.vstack([z, np.sqrt(quality.RIDGE * n / quality.FEATURES) * np.eye(z.shape[1])]), np.r_[y, np.zeros(z.shape[1])], rcond=None)[0]
    assert np.allclose(model.weights, plain, atol=1e-5)
    tune = [i for i, _ in rows if fold[i] == 4]
    raw = quality.fourier(np.array([quality.statistics(rows[i][1]) for i in tune]), model.mean, model.scale) @ plain
    at = quality.place(raw, model.low, model.high)
    n_bin, positive = np.bincount(at, minlength=labelled.BINS), np.bincount(at, [known[i][1] for i in tune], minlength=labelled.BINS)
    assert np.allclose(model.steps, labelled.isotonic(n_bin, positive), atol=1e-6)


@pytest.mark.parametrize(("kind", "module"), [("quality", quality), ("toxic", toxicity)])
def test_classifier_edges(spark, edge_docs, no_docs, kind, module):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for docs, n in ((edge_docs, len(EDGE_ROWS)), (no_docs, 0)):
        for known in (labels, labels.limit(0)):
            found = module.classify(docs, known).collect()
            assert len(found) == n and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) and r["held_out"] is not None for r in found)


@pytest.mark.parametrize(("kind", "module", "threshold"), [("quality", quality, 0.3), ("toxic", toxicity, 0.5)])
def test_held_out_accuracy(spark, kind, module, threshold):
    """On synthetic documents: shouted ones are bad, those with a slur toxic."""
    r = random.Random(4)
    rows, known = [], []
    for i in range(600):
        text = " ".join(r.choice(["the", "river", "bends", "under", "a", "slow", "sky", "and", "stone"]) for _ in range(60))
        bad, toxic = r.random() < 0.25, r.random() < 0.3
        text = text.upper().replace(" ", "!! ") if bad else text
        text = text + (" grobnik" + r.choice(["", "s", "ly"]) if toxic else "")
        rows.append((i, text, "en", "s", len(text)))
        known.append((i, int(not bad), int(toxic)))
    found = module.classify(spark.createDataFrame(rows, DOCS), spark.createDataFrame(known, "doc_id long, quality int, toxic int"), threshold)
    joined = found.join(spark.createDataFrame(known, "doc_id long, quality int, toxic int"), "doc_id").where("held_out").collect()
    assert len(joined) > 60 and np.mean([r["predicted"] == r[kind] for r in joined]) > 0.95
