"""Names that clash, hashes that would, keys that repeat or are null, and plain versions of the scans for secrets and personal data."""

import base64
import datetime
import gzip
import random
import re
import time
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.llm.test_operators import plain_base, plain_components, plain_search

from quarry.llm import bm25, byte_bpe, langid, packing, pii, quality, secrets, sharding, simhash, token_files
from quarry.llm.common import discard, scratch, span_hashes, text_bytes

NAMES = ("_k", "_h", "KEPT", "Score", "PII_SPANS", "none", "c0", "Held_Out", "likeness", "a`b", "a.b", "Group", "rank")


@pytest.fixture(scope="module")
def clash(docs):
    return docs.select(*[F.lit(f"own {i}").alias(n) for i, n in enumerate(NAMES[:6])], "*", *[F.lit(f"own {i}").alias(n) for i, n in enumerate(NAMES[6:], 6)])


def own_columns(rows):
    assert rows
    for r in rows:
        assert all(r[n] == f"own {i}" for i, n in enumerate(NAMES) if n in r.__fields__)


# ---- names


OPERATORS = {
    1: lambda d, s: (lambda p: (token_files.write_token_files(d, p, P.path("byte_bpe_50k.json")), token_files.read_token_files(s, p))[1])(scratch(s, "t")),
    2: lambda d, s: sharding.assign_shards(d, 5),
    4: lambda d, s: packing.pack_documents(d, P.path("word_bpe_49k.json"), end_id=1),
    5: lambda d, s: byte_bpe.encode_documents(d, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN),
    6: lambda d, s: secrets.scan_documents(d),
    7: lambda d, s: simhash.near_duplicates(d),
    8: lambda d, s: bm25.search(d, F.col("doc_id") % 20 == 0, 3),
}


@pytest.mark.parametrize("number", OPERATORS)
def test_operators_ignore_other_columns(spark, docs, clash, number):
    f = OPERATORS[number]
    if number == 4:  # sequence ids depend on partitions
        shown = lambda d: Counter((r.doc_id, r.start, r.length) for r in f(d, spark).collect())
    else:
        shown = lambda d: Counter(map(str, f(d, spark).collect()))
    assert shown(clash) == shown(docs)


def test_results_take_the_names_of_columns_in_any_case(spark, clash):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(21, 80)], "doc_id long, quality int, toxic int")
    judged = quality.judge(clash, quality.fit(clash, labels), carry=True)
    assert [c for c in judged.columns if c.lower() in ("kept", "score")] == ["score", "kept"]
    own_columns([r for r in judged.drop("score", "kept").collect()])
    found = langid.predict(clash, langid.fit(clash), carry=True, likeness=True)
    assert dict(found.dtypes)["likeness"] == "double" and "Held_Out" not in found.columns
    own_columns(found.drop("score", "held_out", "likeness").collect())
    masked = pii.pseudonymise(clash, b"k")
    assert masked.columns == [c for c in clash.columns if c != "PII_SPANS"] + ["pii_spans"]
    own_columns(masked.drop("pii_spans").collect())


def test_stages_return_the_columns_they_got(spark, sf, docs, clash):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        want = stage(spark, docs, sf)
        got = stage(spark, clash, sf)
        assert got.columns == clash.columns
        own_columns(got.collect())
        assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter((r.doc_id, r.text) for r in want.collect())


def test_two_columns_that_differ_in_case_alone(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        both = spark.createDataFrame([(1, "x", "a b c"), (2, "y", "a b c")], "doc_id long, TEXT string, text string")
        spark.conf.set("spark.sql.caseSensitive", "false")
        kept = simhash.keep_first(both)
        assert kept.columns == ["doc_id", "TEXT", "text"] and [tuple(r) for r in kept.collect()] == [(1, "x", "a b c")]
    finally:
        spark.conf.set("spark.sql.caseSensitive", "false")


def test_stages_on_an_empty_table(spark, sf, empty):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


# ---- exact counts


def morse(n, a="a", b="b"):
    x = "a"
    while len(x) < n:
        x += x.translate(str.maketrans("ab", "ba"))
    return x.replace("a", "\0").replace("b", b).replace("\0", a)


def test_words_that_collide_modulo_a_power_of_two():
    one, two = morse(2048), morse(2048, "b", "a")
    words = " ".join("pqrstuv")
    texts = [f"{one}\n{two}", f"{one}\n{two}\n{one}", f"{one} {words} and {two} {words}", f"{one} {words} x {one} {words}", f"{words} {one} {words} {two}"]
    raw, offsets = text_bytes(pa.array(texts))
    got = quality.base_counts(raw, offsets)
    assert [tuple(int(v[i]) for v in got.values()) for i in range(len(texts))] == [plain_base(t) for t in texts]
    h = span_hashes(raw, offsets[:1], offsets[1:2])
    assert h.dtype == np.uint64 and bm25.term_counts(*text_bytes(pa.array([f"{one} {two}"])))[2].tolist() == [1, 1]


def test_counts_are_exact_even_if_all_hashes_are_equal(rows, monkeypatch):
    monkeypatch.setattr(quality, "span_hashes", lambda raw, a, b: np.zeros(len(a), np.uint64))
    texts = [r[1] for r in rows]
    raw, offsets = text_bytes(pa.array(texts, pa.string()))
    got = quality.base_counts(raw, offsets)
    assert list(zip(*(v.tolist() for v in got.values()), strict=True)) == [plain_base(t) for t in texts]


def test_hashes_of_long_texts():
    rng = np.random.default_rng(0)
    raw = rng.integers(0, 3, 1 << 16, dtype=np.uint8)
    a = np.arange(0, 60000, 500)
    b = a + rng.integers(1, 500, len(a))
    twice = np.concatenate((raw, raw))
    assert (span_hashes(twice, a, b) == span_hashes(twice, a + len(raw), b + len(raw))).all()
    assert len(set(span_hashes(raw, a, b).tolist())) == len({raw[x:y].tobytes() for x, y in zip(a, b, strict=True)})


# ---- long texts


def test_long_texts(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("aeinrst", k=rng.randint(1, 8))) for _ in range(500)]
    long = " ".join(rng.choices(words, k=120_000)) + " mail x.y@example.com password = abcdefghijklmnop"
    docs = spark.createDataFrame([(100, long), (2, long + " end"), (3, "short"), (4, "")], "doc_id long, text string")
    shards = sharding.assign_shards(docs, 2)
    assert {r.key: r["size"] for r in shards.collect()} == {100: len(long) + 16, 2: len(long) + 20, 3: 21, 4: 16}
    parts = packing.pack_documents(docs, P.path("word_bpe_49k.json"), end_id=1).groupBy("doc_id").agg(F.sum("length"), F.first("doc_tokens")).collect()
    assert all(r[1] == r[2] for r in parts) and len(parts) == 4
    assert {r.doc_id: len(r.findings) for r in secrets.scan_documents(docs).collect()} == {100: 1, 2: 1, 3: 0, 4: 0}
    masked = {r.doc_id: r for r in pii.pseudonymise(docs, b"k").collect()}
    assert [s.kind for s in masked[100].pii_spans] == ["mail"] and masked[100].text[:600_000] == long[:600_000][: len(masked[100].text)]
    found = bm25.search(docs, F.col("doc_id") == 100, 2).orderBy("rank").collect()
    assert [r.doc_id for r in found][0] in (2, 100) and len(found) == 2
    decoded = byte_bpe.encode_documents(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, decoded=True)
    assert {r.doc_id: bytes(r.decoded).decode() for r in decoded.collect()} == {100: long, 2: long + " end", 3: "short", 4: ""}


# ---- 6


def plain_secrets(text):
    """The contract's words, without the module's patterns."""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m.group(2)) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 16]
    return sorted(out)


def test_base_findings_and_digest(spark):
    import hashlib

    rng = random.Random(2)
    parts = ["password", "PassWd", "secret ", "token", "api_key", "apikey", '"', "'", " ", ":", "=", " = ", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "abcd", "x", "é", "\n", "%41", "hunter2hunter2"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(400)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.summary(secrets.scan_documents(docs)).collect()}
    for i, t in enumerate(texts):
        base = plain_secrets(t or "")
        joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in base)
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == j for _, k, _ in base) for j in range(3)]
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))
        order = [(int(a), ("assign", "access", "hex").index(k), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)]
        assert order == sorted(order) and len(order) == len(set(order))


SECRET = "a password = hunter2hunter2x z"


@pytest.mark.parametrize(
    "data",
    [SECRET.encode("utf-16"), SECRET.encode("utf-16-le"), SECRET.encode("utf-16-be"), ("é" + SECRET).encode("latin-1"), b"\0" + SECRET.encode(), ("​" + SECRET).encode(), gzip.compress(SECRET.encode("utf-16-le")), b"\xff\xfe\x80\x81" + SECRET.encode()],
)
@pytest.mark.parametrize("before", ["", "data/", "x static/js+a/", "ab-", "a_b_c_d/"])
def test_layers_of_any_bytes_behind_any_prefix(data, before):
    run = base64.b64encode(data).decode()
    text = f"so {before}{run} end"
    found = [(a, b) for a, k, b, d in secrets.find(text) if d and k == 0]
    assert any(a >= 3 and b <= 3 + len(before) + len(run) for a, b in found)


def test_spans_behind_a_prefix_are_close():
    run = base64.b64encode(SECRET.encode()).decode()
    text = f"data/{run}"
    a, b = next((a, b) for a, k, b, d in secrets.find(text) if d and k == 0)
    assert b"password = hunter2hunter2x" in base64.b64decode(text[a - (a - 5) % 4 : b + (-(b - 5)) % 4] + "==")


def test_long_chains_take_linear_time():
    began = time.perf_counter()
    for sign in ("%" + "25" * 50_000, "\\" + "u005c" * 20_000, "\\" + "x5c" * 30_000):
        end = {"%": "3d", "\\": "u003d"}[sign[0]] if "x5c" not in sign else "x3d"
        found = secrets.find(f"password{sign}{end}abcdefghijklmnop")
        assert any(k == 0 and d for _, k, _, d in found)
    assert time.perf_counter() - began < 5


# ---- 7


def test_large_groups_are_dealt_again(spark):
    rng = np.random.default_rng(5)
    base = 0x0123456789ABCDEF
    near = {base ^ sum(1 << int(b) for b in rng.choice(32, rng.integers(0, 6), replace=False)) for _ in range(400)} | {int(x) for x in rng.integers(0, 1 << 62, 50)}
    fps = sorted(near)
    classes = spark.createDataFrame([(x,) for x in fps], "fp long").repartition(3)
    want = plain_components(fps, [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 2])
    for most in (simhash.MOST, 40):
        simhash_rows = simhash._ROWS
        try:
            simhash._ROWS = 40
            got = [(r.a, r.b) for r in simhash.links(classes, most).collect()]
        finally:
            simhash._ROWS = simhash_rows
        assert all((a ^ b).bit_count() <= 64 for a, b in got)
        assert plain_components(fps, got) == want


def test_groups_that_come_in_many_batches():
    rng = np.random.default_rng(6)
    group = np.sort(rng.integers(0, 4, 3000))
    group[group == 2] = 1
    fp = np.sort(rng.integers(-(1 << 62), 1 << 62, 3000))
    order = np.lexsort((fp, group))
    rows = [pa.RecordBatch.from_arrays([pa.array(group[order][i : i + 100]), pa.array(fp[order][i : i + 100])], ["group", "fp"]) for i in range(0, 3000, 100)]
    simhash_rows = simhash._ROWS
    try:
        simhash._ROWS = 150
        out = pa.Table.from_batches(list(simhash._edges(500)(iter(rows))))
    finally:
        simhash._ROWS = simhash_rows
    sent = Counter(g for g in out["group"].to_pylist() if g is not None)
    sizes = Counter(group.tolist())
    assert sent == {g: n for g, n in sizes.items() if n > 500}
    assert {a for a, g in zip(out["a"].to_pylist(), out["group"].to_pylist(), strict=True) if g is not None} == set(fp[order][np.isin(group[order], list(sent))].tolist())


@pytest.mark.parametrize("lowest", [-(1 << 63), -1, 0])
def test_the_lowest_key_is_not_null(spark, lowest):
    docs = spark.createDataFrame([(None, "one two three four"), (lowest, "one two three four"), (None, "five six seven"), (None, "five six seven")], "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in simhash.keep_first(docs).collect()), key=str)
    assert kept == sorted([(lowest, "one two three four"), (None, "five six seven")], key=str)
    ids = [r.doc_id for r in bm25.search(docs, F.col("doc_id") == lowest, 5).orderBy("rank").collect()]
    assert ids == [None, lowest]


# ---- 8


def test_queries_with_one_id_and_different_texts(spark):
    texts = [(5, "alpha beta gamma"), (5, "delta epsilon"), (5, "delta epsilon"), (6, "alpha beta"), (7, "delta"), (None, "alpha"), (8, None), (9, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    rows = bm25.search(docs, F.col("doc_id") == 5, 3).orderBy("query_hash", "rank").collect()
    by = {}
    for r in rows:
        by.setdefault(r.query_hash, []).append(r)
    want = [plain_search([(i, t) for i, (_, t) in enumerate(texts)], [q], 3)[q] for q in (0, 1)]
    assert sorted([[(r.rank, round(r.score, 9)) for r in found] for found in by.values()]) == sorted([[(i + 1, round(s, 9)) for i, (_, s) in enumerate(x)] for x in want])
    assert all(r.query_id == 5 for r in rows) and sorted(len(x) for x in by.values()) == [3, 3]
    assert any(None in [r.doc_id for r in found] for found in by.values())


def test_pruning_loses_nothing_and_reads_less():
    rng = np.random.default_rng(1)
    n, vocabulary = 6000, 4000
    terms, counts, lengths = [], [], []
    weights = 1 / np.arange(1, vocabulary + 1)
    for _ in range(n):
        own, c = np.unique(rng.choice(vocabulary, rng.integers(5, 60), p=weights / weights.sum()), return_counts=True)
        terms.append(own.astype(np.int64).tobytes())
        counts.append(c.astype(np.int32).tobytes())
        lengths.append(int(c.sum()))
    ids = rng.permutation(n)
    index = bm25.Index(ids, np.array(lengths), terms, counts, float(np.mean(lengths)))
    df = Counter(t for x in terms for t in np.frombuffer(x, np.int64).tolist())
    queries = []
    for i in range(0, n, 400):
        own = np.frombuffer(terms[i], np.int64)
        queries.append((own, np.log(n / np.array([df[t] for t in own.tolist()])) + 0.01))
    place = {int(i): k for k, i in enumerate(index.ids)}
    found = list(index.search(queries, 10))
    for (t, w), (got, scores) in zip(queries, found, strict=True):
        every = np.zeros(n)
        for x, y in zip(t.tolist(), w.tolist(), strict=True):
            at = int(np.searchsorted(index.terms, x))
            own = slice(index.first[at], index.first[at + 1])
            every[index.row[own]] += y * index.impact[own]
        top = np.lexsort((index.ids, -every))[:10]
        assert np.allclose(sorted(every[[place[int(i)] for i in got]]), sorted(every[top])) and np.allclose(scores, every[[place[int(i)] for i in got]])
    first = index.scored
    least = np.array([s[-1] for _, s in found])
    again = list(index.search(queries, 10, least))
    assert all((a[0] == b[0]).all() and (a[1] == b[1]).all() for a, b in zip(found, again, strict=True))
    assert index.scored - first < 0.8 * index.whole / 2


# ---- 9


def plain_kinds(text):
    """Values that are surely personal data, each found by a rule of its own."""
    out = []
    for m in re.finditer(r"(?<![\d-])\d{16}(?![\d-])", text):
        total = sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, m[0])))
        if total % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d.])", text):
        if all(int(p) < 256 and str(int(p)) == p for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"(?<![\d/.-])(\d{4})-(\d\d)-(\d\d)(?![\d/.-])", text):
        try:
            if 1900 <= datetime.date(*map(int, m.groups())).year < 2100:
                out.append(("date", m.start(), m.end()))
        except ValueError:
            pass
    return out


def test_values_against_plain_rules():
    rng = random.Random(8)
    m = pii.Masker(b"key")
    seen = Counter()
    for _ in range(400):
        parts = []
        for _ in range(6):
            parts.append(rng.choice(["word", "4111111111111111", f"{rng.randint(10**15, 10**16 - 1)}", ".".join(str(rng.randint(0, 300)) for _ in range(4)), f"{rng.randint(1850, 2150)}-{rng.randint(0, 14):02d}-{rng.randint(0, 32):02d}", "and so"]))
        text = ", ".join(parts)
        new, spans = m.mask(text)
        want = plain_kinds(text)
        seen.update(k for k, _, _ in want)
        assert set(want) <= set(spans) and [s for s in spans if s[0] in ("card", "ip", "date")] == sorted(want, key=lambda x: x[1])
        assert len(new) == len(text)
        assert [k for k, _, _ in plain_kinds(new)] == [k for k, _, _ in want]
        assert pii.restore(new, spans, b"key") == text
    assert min(seen[k] for k in ("card", "ip", "date")) > 50


def date_of(text, order):
    parts = dict(zip(order, re.split("[-/.]", text), strict=True))
    return datetime.date(int(parts["y"]), int(parts["m"]), int(parts["d"]))


@pytest.mark.parametrize("day", ["2003-02-01", "2003-02-13", "1999-12-31", "2024-02-29", "1900-01-01", "2099-12-31"])
def test_one_date_has_one_pseudonym(day):
    m, d = pii.Masker(b"key"), datetime.date.fromisoformat(day)
    forms = {"ymd-": d.strftime("%Y-%m-%d"), "ymd/": d.strftime("%Y/%m/%d"), "dmy.": d.strftime("%d.%m.%Y"), "mdy/": d.strftime("%m/%d/%Y")}
    if d.day > 12:
        forms |= {"dmy/": d.strftime("%d/%m/%Y"), "mdy.": d.strftime("%m.%d.%Y")}
    new = {date_of(m.mask(x)[0], f[:3]) for f, x in forms.items()}
    assert len(new) == 1
    assert all(pii.Masker(b"key", undo=True).mask(m.mask(x)[0])[0] == x for x in forms.values())


def test_phone_numbers_are_linked_with_and_without_a_code():
    m = pii.Masker(b"key")
    ends = {re.sub("[^0-9]", "", m.mask(x)[0])[-10:] for x in ("+1 (415) 555-2671", "(415) 555-2671", "+14155552671", "415-555-2671")}
    assert len(ends) == 1


@pytest.mark.parametrize("ip", ["192.168.1.20", "10.0.0.1", "172.16.254.3", "127.0.0.1", "8.8.8.8", "203.0.113.77", "169.254.10.200", "239.1.2.3"])
def test_addresses_keep_lengths_and_ranges(ip):
    import ipaddress

    new, spans = pii.Masker(b"key").mask(f"at {ip} there")
    got = new[3:-6]
    assert spans == [("ip", 3, 3 + len(ip))] and [len(p) for p in got.split(".")] == [len(p) for p in ip.split(".")]
    a, b = ipaddress.ip_address(ip), ipaddress.ip_address(got)
    assert (a.is_loopback, a.is_link_local, a.is_multicast) == (b.is_loopback, b.is_link_local, b.is_multicast)
    assert (ip.split(".")[0] in ("10", "172", "192")) <= b.is_private
    assert pii.Masker(b"key", undo=True).mask(new)[0] == f"at {ip} there"


@pytest.mark.parametrize("mail", ["müller@example.com", "jürgen.groß@büro-straße.de", "иван@почта.com", "José+x@example.org"])
def test_mails_with_other_letters(mail):
    new, spans = pii.Masker(b"key").mask(f"to {mail}.")
    assert spans == [("mail", 3, 3 + len(mail))] and mail not in new and not set(re.findall(r"\w{4,}", mail.rpartition(".")[0])) & set(re.findall(r"\w{4,}", new))
    assert pii.Masker(b"key", undo=True).mask(new)[0] == f"to {mail}."
    assert [c.isupper() for c in new] == [c.isupper() for c in f"to {mail}."] or not mail.isascii()


# ---- scratch paths


def test_scratch_paths_can_be_discarded(spark):
    path = scratch(spark, "x")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    discard(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


# ---- values beside each other


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("415-555-2671 415-555-2672", ["phone:415-555-2671", "phone:415-555-2672"]),
        ("call 415-555-2671 12 times", ["phone:415-555-2671"]),
        ("room 12 415-555-2671", ["phone:415-555-2671"]),
        ("+14155552671 123-45-6789", ["phone:+14155552671", "ssn:123-45-6789"]),
        ("+14155552671 12/26/2003", ["phone:+14155552671", "date:12/26/2003"]),
        ("+14155552671 (415) 555-2671", ["phone:+14155552671", "phone:(415) 555-2671"]),
        ("2003-02-01 415-555-2671", ["date:2003-02-01", "phone:415-555-2671"]),
        ("+1 415 555 2671 2024", ["phone:+1 415 555 2671"]),
        ("415 555 2671 415 555 2672 415 555 2673", ["phone:415 555 2671", "phone:415 555 2672", "phone:415 555 2673"]),
        ("4111 1111 1111 1111 2003-02-01", ["card:4111 1111 1111 1111", "date:2003-02-01"]),
        ("jo+14155552671@x.com 2003-02-01@y.com", ["mail:jo+14155552671@x.com", "mail:2003-02-01@y.com"]),
        ("100 200 300 400 500", []),
    ],
)
def test_personal_values_beside_each_other(text, want):
    masked, spans = pii.Masker(b"k").mask(text)
    assert [f"{k}:{text[a:b]}" for k, a, b in spans] == want
    assert pii.restore(masked, spans, b"k") == text and all(text[a:b] not in masked for _, a, b in spans)


def test_lists_of_personal_values():
    rng = random.Random(12)
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    makers = {
        "phone": [lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"+1{digits(10)}", lambda: f"+1 {digits(3)} {digits(3)} {digits(4)}", lambda: f"{digits(3)}.{digits(3)}.{digits(4)}"],
        "date": [lambda: f"19{digits(2)}-0{rng.randint(1, 9)}-1{digits(1)}", lambda: f"0{rng.randint(1, 9)}/2{rng.randint(0, 8)}/20{rng.randint(10, 99)}"],
        "ssn": [lambda: f"1{digits(2)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}"],
        "mail": [lambda: f"a{digits(4)}@b{digits(2)}.com"],
    }
    for _ in range(400):
        want = [(k, rng.choice(makers[k])()) for k in rng.choices(list(makers), k=rng.randint(1, 5))]
        text = rng.choice([" ", ", ", "; ", " and ", "\n"]).join(v for _, v in want)
        assert [(k, text[a:b]) for k, a, b in pii.Masker(b"k").mask(text)[1]] == want, text


@pytest.mark.parametrize("name", ["_hash", "_n", "_t", "_C", "rest", "Rest_", "id", "hash", "terms", "level"])
def test_keys_of_a_search_may_have_any_name(spark, name):
    docs = spark.createDataFrame([(i, f"word{i % 3} other{i}") for i in range(9)], f"{name} long, text string")
    got = bm25.search(docs, F.col(name) == 4, 2, key=name).collect()
    assert [(r.query_id, r.doc_id) for r in sorted(got, key=lambda r: r.rank)] == [(4, 4), (4, 1)]


def test_written_tables_are_deleted(spark, docs):
    """Rounds of stars delete what they read; what stays goes with the application."""
    from quarry.llm.common import Store
    from quarry.llm.components import connected_components

    kept = []
    keep = Store.keep
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    try:
        Store.keep = lambda self, df, name: (kept.append(self), keep(self, df, name))[1]
        roots = connected_components(edges)
        assert {r.root for r in roots.collect()} == {0}
    finally:
        Store.keep = keep
    assert len(kept) > 2 and all(len(s.paths) == 1 for s in kept)
