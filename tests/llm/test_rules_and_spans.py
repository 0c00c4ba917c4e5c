"""Quality rules, personal data, WARC, sharding, the line field and the pipeline."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import line_crf, personal_data, quality_rules, sharding, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = ["", None, " \n\t", "a b c a b c a b d\n\n \na b\na b\r\x0bq", "x " * 3000 + "y|z", "é ü 😀 # $ <b>\né ü 😀", "one two three " * 30 + "end"]


def base(text):
    t = text or ""
    w = WORD.findall(t)
    seen = collections.Counter(zip(w, w[1:], w[2:]))
    inside = set()
    for i in range(len(w) - 2):
        if seen[w[i], w[i + 1], w[i + 2]] > 1:
            inside |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside)


def test_base_measures(spark):
    rng = random.Random(4)
    texts = TEXTS + ["\n".join(" ".join(rng.choice("abcdef") for _ in range(rng.randrange(9))) for _ in range(rng.randrange(9))) for _ in range(40)]
    df = spark.createDataFrame([(i, t, None if i % 5 else "en", "s", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_words int")
    for r in quality_rules.rate(df).collect():
        want = base(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.rate(df.limit(0)).count() == 0


def test_thresholds_adapt_to_language_and_source(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    rows = []
    for i in range(900):
        long = i % 2
        rows.append((i, " ".join(word(12 if long else 5) for _ in range(80)), "long" if long else "short", "s"))
    rows += [(1000, " ".join(word(12) for _ in range(80)), "short", "s"), (1001, " ".join(word(5) + "#&$" for _ in range(80)), "short", "s"), (1002, " ".join(word(12) for _ in range(80)), "long", "s")]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.rate(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(900)) and not got[1000] and not got[1001] and got[1002]


PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def valid(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(x) <= 255 for x in text.split("."))
    if kind == "card":
        total = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(map(int, reversed(digits))))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def test_base_spans(spark):
    rng = random.Random(6)
    texts = ["", None, "a@b.c_d@e.f a..b@c.d@e.g-h.i", "1.2.3.4.5.6.7.8 999.1.1.1 00012.1.1.0255", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (487) 555-7209 +49.(30) 12345678-9 ++123456789", "😀x@y.zz é +1 415 555 2671"]
    texts += ["".join(rng.choice("0123456789 -.@+()ab") for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += ["1 " * 20000, "a." * 20000 + "@b.c", "x@" + "a." * 20000, "." * 5000 + "@"]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id bigint, text string, kind string").repartition(4)
    for r in personal_data.find(df).collect():
        text, spans, counts = texts[r["doc_id"]] or "", [], []
        for kind, p in PATTERNS:
            own = [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(p, text) if valid(kind, m.group())]
            counts.append(len(own))
            spans += own
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == counts
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(r["spans"].split(",")) | {""}
    assert personal_data.find(df.limit(0)).count() == 0


def test_added_spans_and_redaction(spark):
    good = ["call me on +1 (487) 555-7209 today", "mail kim.lee@mail.example.com now", "card 4111 1111 1111 1111 ok", "host 10.20.30.40 up"]
    rows = [(i, good[i % 4], 30) for i in range(80)] + [(100, "phone (415) 555-2671 and joe (at) mail (dot) com", 1), (101, None, 0), (102, "nothing here", 12)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint")
    found = {r["doc_id"]: r for r in personal_data.find(df).collect()}
    assert "phone:6:20" in found[100]["spans"] and found[100]["n_phone"] == 0 and found[102]["spans"] == ""
    clean = {r["doc_id"]: (r["text"], r["n_chars"]) for r in personal_data.redact(df).collect()}
    assert clean[0] == ("call me on <PHONE> today", 24) and clean[1][0] == "mail <EMAIL> now" and clean[2][0] == "card <CARD> ok" and clean[3][0] == "host <IP> up"
    assert clean[101] == (None, 0) and clean[102] == ("nothing here", 12) and "2671" not in clean[100][0]


LOOSE_BY_HAND = [
    ("email", r"[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]{1,63}){1,4}"),
    ("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    ("card", r"(?<![0-9._/])[0-9]{4}[._/][0-9]{4}[._/][0-9]{4}[._/][0-9]{1,7}(?![0-9])"),
    ("phone", r"(?<![0-9+.()-])\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}(?![0-9-])"),
    ("secret", r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*[0-9])(?=[0-9_+/-]*[A-Za-z])[A-Za-z0-9_+/-]{16,}={0,2}"),
]


def votes_by_hand(kind, text, before, after):
    digits = re.sub("[^0-9]", "", text)
    has = lambda p, t: re.search(p, t) is not None
    sign = lambda x: 1 if x else -1
    plain = text
    if kind == "email":
        plain = re.sub(r" ?(?:[(\[]dot[)\]]|\.) ?", ".", re.sub(r" ?[(\[]at[)\]] ?", "@", text))
    form = {"card": digits, "phone": re.sub("[^0-9+]", "", text)}.get(kind, plain)
    regex, gazetteer = sign(has(personal_data.CANONICAL[kind], form)), sign(has(personal_data.GAZETTEER[kind], plain))
    checksum = {"card": lambda: 0, "phone": lambda: sign(10 <= len(digits) <= 13)}.get(kind, lambda: 0)()
    if kind == "card":
        checksum = sign(sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0)
    if kind == "secret":
        regex, gazetteer = max(regex, 0), max(gazetteer, 0)
        bits = -sum(n / len(text) * np.log2(n / len(text)) for n in collections.Counter(text).values())
        checksum = 1 if bits >= 2.8 else -1 if bits < 2.2 else 0
    against = has(personal_data.AGAINST_SECRET if kind == "secret" else personal_data.AGAINST, before) or has(personal_data.AFTER, after)
    context = 1 if has(personal_data.CONTEXT[kind], before) else -1 if against else 0
    return regex, sign(has(personal_data.SHAPE[kind], text)), gazetteer, context, checksum


def spans_by_hand(text, patterns, loose):
    out = []
    for kind, p in patterns:
        end, found = 0, list(re.finditer(p, text))
        for k, m in enumerate(found):
            following = found[k + 1].start() if k + 1 < len(found) else len(text)
            if loose or valid(kind, m.group()):
                votes = votes_by_hand(kind, m.group(), text[max(end, m.start() - 40) : m.start()], text[m.end() : min(following, m.end() + 40)])
                out.append((kind, m.start(), m.end(), votes, min((m.end() - m.start()) // 6, 7)))
            end = m.end()
    return out


def test_added_spans_equal_brute_force(spark):
    rng = random.Random(12)
    hexed = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    parts = [lambda: f"password={hexed(18)}", lambda: f'token = "{hexed(40)}"', lambda: "AKIA" + "".join(rng.choice("ABCDEFGH234567") for _ in range(16)), lambda: f"commit {hexed(40)}", lambda: "see https://x.org/a-long-page-name-for-2024-readers", lambda: "part aaaaaaaaaaaaaaaaaaaaa1", lambda: "joe (at) mail (dot) com", lambda: "a.b@c.org", lambda: "call (415) 555-2671", lambda: "order 123 456 7890 pages", lambda: "4111.1111.1111.1111", lambda: "2001:db8:1:2:3:4:5:6", lambda: "+1 (487) 555-7209", lambda: "10.2.3.4", lambda: "é word"]
    texts = [" ".join(rng.choice(parts)() for _ in range(rng.randrange(9))) for _ in range(300)] + [None, "", " ".join(f"password={hexed(18)}" for _ in range(700))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    base = [spans_by_hand(t or "", PATTERNS, False) for t in texts]
    loose = [[x for x in spans_by_hand(t or "", LOOSE_BY_HAND, True) if not any(x[1] < b[2] and b[1] < x[2] for b in own)] for t, own in zip(texts, base)]
    counts = collections.Counter((x[0], x[3], x[4]) for own in base + loose for x in own)
    w = personal_data.train([(*k, n) for k, n in counts.items()])
    n_added = 0
    kinds = personal_data.ALL_KINDS
    for r in personal_data.find(df).collect():
        i, good = r["doc_id"], []
        for x in loose[i]:
            score = sum(a * b for a, b in zip(w, personal_data._features(x[0], x[3], x[4])))
            if score >= 0 and not any(x[1] < b[2] and b[1] < x[2] for b in good):
                good.append(x)
        want = sorted(base[i] + good, key=lambda x: (kinds.index(x[0]), x[1]))
        assert r["spans"] == ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in want)
        assert r["n_added"] == len(good) and r["n_spans"] == len(want)
        n_added += len(good)
    assert n_added > 300
    clean = {r["doc_id"]: r["text"] for r in personal_data.redact(df).collect()}
    assert clean[len(texts) - 1] == " ".join(["password=<SECRET>"] * 700) and clean[300] is None


def test_clashing_names_stay(spark):
    df = spark.createDataFrame([(1, "a@b.org", 7, "x", 2)], "doc_id bigint, text string, _w_base_spans int, kind string, spans int")
    assert personal_data.redact(df).collect() == spark.createDataFrame([(1, "<EMAIL>", 7, "x", 2)], df.schema).collect()


def test_reliabilities_tell_labelers_apart():
    rng = random.Random(8)
    counts = collections.Counter()
    for _ in range(4000):
        y = rng.random() < 0.6
        votes = tuple((1 if (rng.random() < p) == y else -1) for p in (0.95, 0.9, 0.85, 0.55, 0.8))
        counts[votes] += 1
    table, post = personal_data.reliabilities([("card", v, n) for v, n in counts.items()])
    right = [table["card", j, 1][1] for j in range(5)]
    assert right[0] > 0.9 > right[3] and post["card", (1, 1, 1, 1, 1)] > 0.99 > 0.01 > post["card", (-1, -1, -1, -1, -1)]


@pytest.mark.parametrize("compress,range_bytes", [(True, 4 << 20), (True, 3000), (False, 2500)])
def test_archives_round_trip(spark, compress, range_bytes):
    trap = "<p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n" * 40
    rng = random.Random(9)
    pages = [(i, f"http://x/{i}\r\nevil: 1", "".join(rng.choice("abc \n") for _ in range(rng.randrange(3000)))) for i in range(60)]
    pages += [(100 + i, None, trap) for i in range(4)] + [(None, "u", trap), (200, "u", None), (201, "u", ""), (202, "u", "short"), (203, "u", "short")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id bigint, url string, html string, digest string").repartition(2)
    want = collections.Counter()
    for i, _, html in pages:
        data = (html or "").encode()
        same = [p[0] for p in pages if (p[2] or "") == (html or "") and p[0] is not None]
        owner = max(same) if len(data) >= 1000 and sum((p[2] or "") == (html or "") for p in pages) > 1 else None
        again = owner is not None and owner != i
        want[i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", owner if again else None] += 1
    got = collections.Counter(tuple(r) for r in warc.read_archives(warc.write_archives(df, compress=compress), range_bytes).collect())
    assert got == want
    if compress:
        assert warc.archive(df.limit(0)).count() == 0


def test_gzip_records_inside_payloads_are_rejected(spark, tmp_path):
    def record(page_id, payload):
        return warc.record_bytes(page_id, "u", payload, hashlib.sha1(payload).hexdigest(), None)

    def stored(data):  # a member that holds data as it is, so that whatever looks like a record inside shows
        c = zlib.compressobj(0, zlib.DEFLATED, 31)
        return c.compress(data) + c.flush()

    inner = warc._gzip(record(1, b"inner" * 30))
    data = b"".join(stored(record(k, bytes([65 + k]) * 50 + inner * (k % 3))) for k in range(2, 12))
    path = tmp_path / "one.warc.gz"
    path.write_bytes(data)
    archives = spark.createDataFrame([(f"file://{path}", len(data))], "path string, bytes bigint")
    for range_bytes in (1 << 20, 400, 150):
        ranges = [(0, f"file://{path}", s, s + range_bytes) for s in range(0, len(data), range_bytes)]
        found = spark.createDataFrame(ranges, "file bigint, path string, start bigint, end bigint").mapInArrow(warc._candidates, "file bigint, at bigint, exit bigint, range_end bigint")
        assert found.count() > 10  # the copies inside payloads do look like records
        got = sorted(r["page_id"] for r in warc.read_archives(archives, range_bytes).collect())
        assert got == list(range(2, 12))


def test_shards_are_even_and_gapless(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_A_RANGE", 20)
    rng = random.Random(10)
    texts = ["hot text " * 20] * 300 + ["t" * rng.randrange(200) for _ in range(600)] + [None, ""]
    df = spark.createDataFrame([(i if i % 50 else None, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, size string").repartition(5)
    rows = sharding.shard(df, 7).collect()
    assert len(rows) == len(texts)
    sizes, slots = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in rows)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert collections.Counter((r["size"], r["text_crc32"]) for r in rows) == collections.Counter((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for t in texts)
    # shards and slots are those of walking all records in the order of their keys
    keyed = df.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("n"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("first"), F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("second")).collect()
    total, passed, want = sum(r["n"] + 8 for r in keyed), 0, collections.Counter()
    nth = collections.Counter()
    for r in sorted(keyed, key=lambda r: (r["first"], r["second"])):
        size = r["n"] + 8
        own = min((2 * passed + size) * 7 // (2 * total), 6)
        want[r["doc_id"], size, own, nth[own]] += 1
        nth[own] += 1
        passed += size
    assert want == collections.Counter((r["doc_id"], r["size"], r["shard"], r["slot"]) for r in rows)
    assert sharding.shard(df.limit(0)).count() == 0


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    n, score, trans = np.array([3, 1, 5]), rng.normal(size=9), rng.normal(size=(2, 2))
    good, pair, log_z = line_crf.marginals(score, trans, n)
    want, pairs, total, at = [], np.zeros((2, 2)), 0.0, 0
    for m in n:
        z, on, step = 0.0, np.zeros(m), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(m)):
            w = np.exp(sum(score[at + i] * y[i] for i in range(m)) + sum(trans[y[i - 1], y[i]] for i in range(1, m)))
            z, on = z + w, on + w * np.array(y)
            for i in range(1, m):
                step[y[i - 1], y[i]] += w
        want, pairs, total, at = [*want, *(on / z)], pairs + step / z, total + np.log(z), at + m
    assert np.allclose(good, want) and np.allclose(pair, pairs) and np.isclose(log_z, total)


def test_score_of_a_text_by_enumeration():
    rng = np.random.default_rng(1)
    model = line_crf.Model(np.zeros(line_crf.FEATURES), np.ones(line_crf.FEATURES), rng.normal(size=line_crf.FEATURES) / 3, rng.normal(size=(2, 2)))
    texts = ["one two\n\nTHREE 4 #|", "a a a b", "", "x\n\n\ny!?"]
    for text, got in zip(texts, model.score(texts)):
        own, (n,), size = line_crf.line_measures([text])
        rows = [np.concatenate([own[i], own[i - 1] if i else 0 * own[0], own[i + 1] if i + 1 < n else 0 * own[0], [1.0]]) @ model.w for i in range(n)]
        z, good = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(rows[i] * y[i] for i in range(n)) + sum(model.trans[y[i - 1], y[i]] for i in range(1, n)))
            z, good = z + w, good + w * np.array(y)
        weight = size if size.sum() else np.ones(n)
        assert np.isclose(got, (good / z * weight).sum() / weight.sum())
    long = "\n".join(["a line of words", "### | ###"] * 20_000)
    assert 0 <= model.score([long, "short"])[0] <= 1


def test_classifier_holds_out(spark):
    rng = random.Random(11)
    texts = ["\n".join(" ".join(rng.choice(["the", "a", "of", "word"]) + ("###" if i % 3 == 0 else "") for _ in range(9)) for _ in range(rng.randrange(1, 6))) for i in range(240)]
    docs = spark.createDataFrame([*((i, t, "q") for i, t in enumerate(texts)), (900, None, ""), (None, "the word", "")], "doc_id bigint, text string, quality string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(240)] + [(5000, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    rows = line_crf.score(docs, labels).collect()
    assert len(rows) == 242
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        if r["held_out"] and r["doc_id"] < 240:
            assert r["predicted"] == int(r["doc_id"] % 3 != 0)
    # labels of held-out documents don't matter
    flipped = labels.withColumn("quality", F.when(line_crf.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(map(repr, line_crf.score(docs, flipped).collect())) == sorted(map(repr, rows))
    assert {r["score"] for r in line_crf.score(docs, labels.limit(0)).collect()} == {0.5}


def test_pipeline_stages(spark, sf):
    import corpus_pipeline
    from tests.llm.test_similarity import brute

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(10**6, "stay " * 3 + "only junk " * 90, "en", "s", 1), (10**6 + 1, None, None, None, None), (10**6 + 2, "", "en", "s", 0)], docs.schema)
    docs = docs.unionByName(extra)
    stages = dict(corpus_pipeline.STAGES)

    def rows(df):
        assert df.columns == docs.columns
        return {r["doc_id"]: r for r in df.collect()}

    # quality rules: what rate() keeps, and nothing that the base rules reject
    before, kept = rows(docs), stages["quality rules"](spark, docs, sf)
    verdicts = {r["doc_id"]: r["kept"] for r in quality_rules.rate(docs).collect()}
    measured = {d: base(r["text"]) for d, r in before.items()}
    good = rows(kept)
    assert set(good) == {d for d, ok in verdicts.items() if ok} and all(good[d] == before[d] for d in good)
    assert not any(measured[d][0] < 50 or 100 * measured[d][4] > 50 * measured[d][0] for d in good)
    # near copies: the least of each component
    docs = kept.unionByName(extra)
    order = sorted(rows(docs))
    texts = [rows(docs)[d]["text"] for d in order]
    kept = stages["n-gram Jaccard join"](spark, docs, sf)
    assert sorted(rows(kept)) == sorted({order[root] for _, _, root in brute(texts, 5, 80, 100)})
    # benchmark: the documents that hold an item go, by a plain search of the items' words
    docs = kept
    from weftline.llm import decontaminate

    kept = stages["benchmark decontamination"](spark, docs, sf)
    items = [" ".join(decontaminate.words_of(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    held = {d for d, r in rows(docs).items() if any(f" {x} " in f" {' '.join(decontaminate.words_of(r['text'] or ''))} " for x in items if x)}
    found = {r["doc_id"] for r in decontaminate.find_leaks(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert held <= found and set(rows(kept)) == set(rows(docs)) - found
    # personal data: each span of find() is replaced by its kind
    docs = kept
    spans = {r["doc_id"]: [(int(x.split(":")[1]), int(x.split(":")[2]), x.split(":")[0]) for x in r["spans"].split(",") if x] for r in personal_data.find(docs).collect()}
    kept = stages["personal data"](spark, docs, sf)
    clean, before = rows(kept), rows(docs)
    assert set(clean) == set(before)
    for d, r in before.items():
        text, out, at = r["text"], [], 0
        for a, b, kind in sorted(spans[d]):
            if a >= at:
                out += [text[at:a], f"<{kind.upper()}>"]
            at = max(at, b)
        assert clean[d]["text"] == ("".join([*out, text[at:]]) if spans[d] else text)
    # packing: every id of every document once
    packed = stages["packing"](spark, kept, sf)
    tokens = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t"))
    assert tokens.where("n <> t").count() == 0 and tokens.count() == len(clean)


def test_pipeline_runs_its_stages(spark, sf, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    want = docs.groupBy("doc_id").agg(F.sum("length").alias("n"))
    got = corpus_pipeline.run(spark, sf).groupBy("doc_id").agg(F.sum("length").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_pipeline_of_no_documents(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0, name
