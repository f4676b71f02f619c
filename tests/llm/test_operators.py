"""Each operator on rows of every odd kind, on an empty table, and against a plain form of itself."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hrefloom.llm import adsearch, classifier, common, components, licenses, logbilinear, minhash, mixing, pii, quality, warc
from hrefloom.llm.common import Stages

from .conftest import DOCS, prose, rows

WORD = re.compile("[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def by_row(found, *columns):
    return Counter(tuple(r[c] for c in columns) for r in found)


# WARC

def read(spark, path, **options):
    return warc.read_chunks(spark, path, **options)


def fed(parser, data, size):
    rows, most = [], 0
    for i in range(0, len(data), size):
        rows += parser.feed(data[i : i + size])
        most = max(most, len(parser.buffer))
    return rows + list(parser.finish()), most


def record(head, block):
    return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_parser_is_bounded_and_linear():
    """Blocks without an empty line or a line break, and garbage where a header should be."""
    http = "Content-Type: application/http\r\n"
    for block in (b"x" * (64 << 20), b"no end of header\r\n" * (1 << 16)):
        rows, most = fed(warc.ChunkParser("a", warc.CHUNK_BYTES), record(http, block) + record("", b"next"), 1 << 16)
        assert most < 1 << 20 and {r[1] for r in rows} == {0, 1}
        last = [r for r in rows if r[1] == 0 and r[12]]
        assert len(last) == 1 and last[0][10] == len(block) and last[0][11] == hashlib.sha256(block).hexdigest()
        assert last[0][13] == "no end of http header" and max(len(r[9]) for r in rows) <= warc.CHUNK_BYTES
        assert [(r[9], r[13]) for r in rows if r[1] == 1] == [(b"next", None)]
    garbage = b"g" * (8 << 20)
    rows, most = fed(warc.ChunkParser("a", warc.CHUNK_BYTES), garbage + b"\r\n\r\n" + record("", b"kept") + garbage, 1 << 16)
    assert most < 1 << 20 and [(r[9], r[13]) for r in rows] == [(b"", "header too long"), (b"kept", None), (b"", "header too long")]
    # a short block without a header's end is payload as well, and one that is cut off comes in chunks
    rows, _ = fed(warc.ChunkParser("a", 8), record(http, b"GET\r\nx"), 3)
    assert b"".join(r[9] for r in rows) == b"GET\r\nx" and rows[-1][13] == "no end of http header"
    rows, _ = fed(warc.ChunkParser("a", 8), record(http, b"y" * 100)[:-70], 1000)
    assert len(rows) > 3 and all(len(r[9]) <= 8 for r in rows) and rows[-1][13] == "cut off"


def test_warc_round_trip(spark, tmp_path):
    same = "twice the same payload, " * 10
    pages = [
        (3, "http://a/x", same), (1, "http://a/y", same), (2, None, None), (4, "http://a/\r\nWARC-Type: warcinfo", ""),
        (5, "", "ends with CR\r"), (6, "http://a/z", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n" * 9),
        (None, "http://a/n", same), (7, "http://a/7", "short"), (8, "http://a/8", "short"), (9, "u", "é" * 5000), (1, "http://a/y", same),
    ]
    rows = spark.createDataFrame([(*p, "x") for p in pages], "page_id BIGINT, url STRING, html STRING, payload STRING")
    path = str(tmp_path / "archives")
    warc.write_archives(rows, path, segment_bytes=700)
    chunks = read(spark, path, chunk_bytes=256)
    found = [r for r in warc.read_records(chunks).withColumn("page_id", warc.page_of(F.col("record_id"))).withColumn("to", warc.page_of(F.col("refers_to"))).collect()]
    expected = Counter()
    for page_id, _, html in pages:
        payload = (html or "").encode()
        first = len(payload) < 100 or html != same or page_id == 1
        expected[page_id, len(payload), hashlib.sha256(payload).hexdigest(), "response" if first else "revisit", None if first else 1] += 1
    assert by_row(found, "page_id", "payload_bytes", "payload_digest", "record_type", "to") == expected
    assert all(r["error"] is None for r in found)
    # chunks are bounded, their digests run on, and together they are the payload
    parts = sorted((r for r in chunks.collect() if r["record_id"] == "<urn:page:9>"), key=lambda r: r["chunk_no"])
    whole = b""
    for n, part in enumerate(parts):
        whole += part["chunk"]
        assert part["chunk_no"] == n and len(part["chunk"]) <= 256
        assert part["payload_digest"] == hashlib.sha256(whole).hexdigest() and part["payload_bytes"] == len(whole)
    assert whole == ("é" * 5000).encode() and len(parts) > 30 and parts[-1]["last"]


def test_warc_empty_table(spark, tmp_path):
    path = str(tmp_path / "archives")
    warc.write_archives(spark.createDataFrame([], "page_id BIGINT, url STRING, html STRING"), path)
    assert read(spark, path).count() == 0


@pytest.mark.parametrize("data,error", [
    (b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 10\r\n\r\nabc", "cut off"),
    (b"garbage", "no header"),
    (b"nonsense\r\n\r\n", "bad header"),
    (b"WARC/1.1\r\nWARC-Type: continuation\r\nWARC-Segment-Origin-ID: <x>\r\nContent-Length: 1\r\n\r\na\r\n\r\n", "origin not in this archive"),
])
def test_warc_broken_archives(data, error):
    parser = warc.ChunkParser("a", 64)
    found = [*parser.feed(data), *parser.finish()]
    assert found[-1][-1] == error


# quality rules

def base_counts(text):
    own = words(text)
    grams = [tuple(own[i : i + 3]) for i in range(len(own) - 2)]
    seen = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_ratio(spark, docs, stages):
    labels = spark.createDataFrame([(1, 1, None), (3, 1, 0), (12, 0, 0), (None, 1, 0), (4, None, 0)], "doc_id BIGINT, quality INT, toxic INT")
    found = quality.judge_documents(docs, labels, stages, ["doc_id", "text"]).collect()
    import xxhash

    def buckets(text):
        own = [w.encode() for w in words(text)]
        hashes = [xxhash.xxh64_intdigest(w, seed=42) for w in own]
        signed = lambda h: h - (1 << 64) if h >= 1 << 63 else h
        pairs = [xxhash.xxh64_intdigest(w, seed=h) for w, h in zip(own[1:], hashes)]
        return [signed(h) % quality.BUCKETS for h in [*hashes, *pairs]]

    raw, target = Counter(), Counter()
    for r in rows():
        raw.update(buckets(r[1]))
        if r[0] in (1, 3):
            target.update(buckets(r[1]))
    share = sum(target.values()) / sum(raw.values())

    def ratio(b):
        e = raw[b] * share
        value = np.log((target[b] + quality.PRIOR) / (e + quality.PRIOR))
        return np.sign(value) * max(0.0, abs(value) - np.sqrt(e) / (e + quality.PRIOR))

    assert len(found) == len(rows())
    for r in found:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_counts(r.text)
        own = [ratio(b) for b in buckets(r.text)]
        assert r.score == pytest.approx(float(np.mean(own)) if own else 0.0, abs=1e-9)
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed and r.score >= quality.THRESHOLD)


def test_quality_without_rows_or_labels(spark, docs, no_docs, stages):
    none = spark.createDataFrame([], "doc_id BIGINT, quality INT")
    assert quality.judge_documents(no_docs, none, stages, ["doc_id"]).count() == 0
    assert all(r.score == 0 and r.kept == (not r.base_failed) for r in quality.judge_documents(docs, none, stages, ["doc_id"]).collect())


def test_quality_counts_all_trusted_rows(spark, stages):
    n = 20_500
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), F.col("id")).alias("text"))
    trusted = stages.write("trusted", quality.trusted_ids(spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))))
    assert trusted.count() == n
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # all rows are trusted: the target is the raw corpus
        assert set(quality.bucket_ratios(docs, trusted, stages).first()["ratios"]) == {0.0}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


# personal data

def test_personal_data_of_odd_rows(spark, docs, no_docs, stages):
    found = pii.find_personal_data(docs, stages).collect()
    assert len(found) == len(rows())
    nine = next(r for r in found if r.doc_id == 9)
    assert [(pii.KINDS[s.kind], s.start, s.end) for s in nine.spans] == [("email", 5, 25), ("phone", 29, 46)]
    assert all(not r.spans for r in found if r.doc_id != 9)
    clean = {r.doc_id: r for r in pii.redact(docs, stages).collect()}
    assert clean[9].text == "mail <EMAIL> or <PHONE> now" and clean[9].n_chars == 27 and clean[9].spans == "p"
    assert clean[6].text is None and clean[1].text == prose(1, 120)
    assert pii.find_personal_data(no_docs, Stages(spark, "none")).count() == 0


def test_contexts_discover_what_patterns_miss(spark, stages):
    seeds = [f"please write to u{k}.{k}@mail.example.com today" for k in range(8)]
    texts = [*seeds, "please write to u77-at-mail-77 today", "he counted to 100200300 today", "nothing here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    found = {r.doc_id: r for r in pii.find_personal_data(docs, stages).collect()}
    assert [pii.KINDS[s.kind] for s in found[8].spans] == ["context"]
    assert texts[8][found[8].spans[0].start : found[8].spans[0].end] == "u77-at-mail-77"
    assert not found[9].spans and not found[10].spans


PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits)))
            good = (
                True, all(int(p) <= 255 for p in m[0].split(".")) if kind == 1 else True,
                12 <= len(digits) <= 19 and doubled % 10 == 0, 9 <= len(digits) <= 15,
            )[kind]
            if good:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_contexts_go_on_from_what_they_discover(spark, stages):
    lines = [f"please write to a{k}@mail.example.com today" for k in range(20)]
    lines += [f"please write to zx100{k} today" for k in range(3)]
    # no plain pattern stands behind this context
    lines += [f"your member key zx100{k} now" for k in range(3) for _ in range(4)] + ["your member key qq7001 now"]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id BIGINT, text STRING")
    found = {r.doc_id: [(s.kind, lines[r.doc_id][s.start : s.end]) for s in r.spans] for r in pii.find_personal_data(docs, stages).collect()}
    assert found[len(lines) - 1] == [(pii.KINDS.index("context"), "qq7001")]


def test_contexts_reach_over_long_gaps():
    long = "w" * 300
    text = f"call the {long}" + " " * 500 + "ab1234"
    assert pii.mentions(text, [])[0]["patterns"] == [f"the {long}", f"call the {long}"]


def test_spans_equal_the_plain_patterns():
    rng = np.random.default_rng(1)
    for alphabet in ("a.@-_1 ", "0123456789. -", "+1 ().-234", "a@b.c0_%+"):
        for n in rng.integers(0, 60, 600):
            text = "".join(rng.choice(list(alphabet), n))
            assert pii.base_spans(text) == plain_spans(text), text
    for card in ("4532015112830366", "4532 0151 1283 0366", "4532-0151-1283-0367"):
        assert pii.base_spans(card) == plain_spans(card)


def test_junk_signs_are_no_pattern(spark, stages):
    """Signs alone are not lexical: tokens behind them are not taken, however many seeds stand behind the same ones."""
    seeds = [(k, f"{prose(k, 12)} !! && u{k}@mail.example.com") for k in range(40)]
    junk = [(100 + k, f"{prose(50 + k, 12)} !! && token{k}99") for k in range(20)]
    said = [(200 + k, f"write to us at u{k}@mail.example.com") for k in range(40)] + [(300, "write to us at box77x5"), (301, "write to us at " + "9x" * 300)]
    docs = spark.createDataFrame([*seeds, *junk, *said], "doc_id BIGINT, text STRING")
    found = {r.doc_id: len(r.spans) - len(r.base) for r in pii.find_personal_data(docs, stages).collect()}
    assert all(found[100 + k] == 0 for k in range(20)) and found[300] == 1 and found[301] == 1


def test_long_surfaces_differ_beyond_any_prefix():
    one, two = (pii.mentions(f"my own code {'1a' * 500}{end}", [])[0]["surface"] for end in ("x", "y"))
    assert one != two and len(one) == 64


def test_long_texts_take_linear_time():
    for text in ("a" * 500_000, "1" * 500_000, "a@" * 200_000, "+1" + " " * 500_000, "1." * 200_000):
        pii.base_spans(text)


# licences

def test_license_scan_of_odd_rows(spark, docs, no_docs):
    found = licenses.scan_licenses(docs).collect()
    assert len(found) == len(rows())
    eleven = next(r for r in found if r.doc_id == 11)
    assert (eleven.n_base, eleven.first_word, eleven.last_word, eleven.base_labels, eleven.score) == (1, 3, 3, ["mit"], 1.0)
    assert [(s.label, s.start, s.end) for s in eleven.spans] == [("mit", 0, 5)]
    assert all(r.n_base == 0 and r.first_word is None for r in found if r.doc_id != 11)
    assert licenses.scan_licenses(no_docs).count() == 0


def test_templates_with_changed_words_keep_their_label():
    automaton = licenses.SuffixAutomaton()
    for n, (label, text) in enumerate(licenses.TEMPLATES):
        own = licenses.words_of(text)
        if len(own) < 20:
            continue
        changed = b" ".join(b"zz%d" % k if k % 9 == 8 else w for k, w in enumerate(own))
        scanned = licenses.scan_text(automaton, f"before it {changed.decode()} and after")
        assert label in {s["label"] for s in scanned["spans"]}, (n, label, scanned["score"])


def test_copies_of_a_template_are_spans_of_their_own():
    automaton = licenses.SuffixAutomaton([("x", "a b c d e f a b c d g h")])
    text = "a b c d e f a b c d g h"
    found = licenses.scan_text(automaton, f"{text} {text} q {text}")["spans"]
    assert [(s["start"], s["end"], s["covered"]) for s in found] == [(0, 12, 12), (12, 24, 12), (25, 37, 12)]
    # a run that stands twice is followed by either of its places
    found = licenses.scan_text(automaton, "a b c d z a b c d g h")["spans"]
    assert [(s["start"], s["end"]) for s in found] == [(0, 11)] or found[0]["covered"] >= 10


def test_matching_statistics_against_search():
    rng = np.random.default_rng(3)
    templates = [("a", "p q r p q s"), ("b", "q r p q q r"), ("a", "s s p")]
    automaton = licenses.SuffixAutomaton(templates, least=1)
    texts = [t.split() for _, t in templates]
    runs = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    for _ in range(300):
        own = list(rng.choice(list("pqrsx"), rng.integers(0, 14)))
        longest = [max((n for n in range(e + 1) if n == 0 or tuple(own[e - n : e]) in runs)) for e in range(len(own) + 1)]
        peaks = [(e, longest[e]) for e in range(1, len(own) + 1) if longest[e] >= 1 and (e == len(own) or longest[e + 1] <= longest[e])]
        found = list(automaton.matches([w.encode() for w in own], least=1))
        assert [(e, n) for e, n, _ in found] == peaks
        for e, n, state in found:
            ends = {(t, j) for t, x in enumerate(texts) for j in range(n, len(x) + 1) if x[j - n : j] == own[e - n : e]}
            assert automaton.ends[state] == ends


def test_license_chain_spans_an_edited_template():
    automaton = licenses.SuffixAutomaton()
    text = dict(licenses.TEMPLATES[:1])["mit"].split()
    edited = ["intro"] * 5 + text[:60] + ["inserted", "words"] + text[60:] + ["end"]
    own = licenses.words_of(" ".join(edited))
    best = max(licenses.spans(automaton, own), key=lambda s: s.covered)
    assert best.label == "mit" and best.coverage > 0.95 and (best.start, best.end) == (5, len(own) - 1)


# near duplicates

def shingles(text, size):
    own = (text or "").encode().lower().split()
    return frozenset(tuple(own[i : i + size]) for i in range(max(1, len(own) - size + 1))) if own else frozenset()


def plain_components(texts, size, percent=80):
    sets = [shingles(t, size) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root, [len(s) for s in sets]


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_against_all_pairs(spark, stages, size):
    rng = np.random.default_rng(5)
    texts = [r[1] for r in rows()]
    for group in range(6):
        own = prose(20 + group, 40).split()
        for _ in range(9):
            changed = list(own)
            for k in rng.integers(0, len(own), rng.integers(0, 6)):
                changed[k] = f"w{rng.integers(0, 50)}"
            texts.append(" ".join(changed).upper() if rng.random() < 0.2 else " ".join(changed))
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id BIGINT, text STRING, node STRING, planes STRING").repartition(4)
    root, sizes = plain_components(texts, size)
    found = {r.doc_id: r for r in minhash.near_duplicates(docs, stages, size=size).collect()}
    assert len(found) == len(texts) and len(set(root)) < len(texts) - 8
    for i in range(len(texts)):
        assert (found[i].n_shingles, found[i].component_id, found[i].kept) == (sizes[i], root[i], root[i] == i), i


def test_near_duplicates_of_odd_rows(spark, docs, no_docs, stages):
    found = minhash.near_duplicates(docs, stages).collect()
    assert len(found) == len(rows())
    kept = by_row(found, "doc_id", "component_id", "kept")
    assert kept[1, 1, True] == 1 and kept[2, 1, False] == 1 and kept[3, 1, False] == 1 and kept[4, 4, True] == 3
    assert kept[5, 5, True] == kept[6, 6, True] == kept[7, 7, True] == 1 and kept[None, None, True] == 2
    assert minhash.near_duplicates(no_docs, Stages(spark, "none")).count() == 0


def test_estimate_is_near_the_similarity(spark):
    sign, shingle = minhash.Signer(), minhash.Shingler(1)
    base = prose(9, 2000).split()
    pairs = []
    for share in (0.5, 0.8, 0.9, 1.0):
        other = base[: int(2000 * share)] + [f"z{k}" for k in range(2000 - int(2000 * share))]
        one, two = shingle(" ".join(base).encode()), shingle(" ".join(other).encode())
        pairs.append((len(np.intersect1d(one, two)) / len(np.union1d(one, two)), sign(one)[1], sign(two)[1]))
    rows = spark.createDataFrame(pairs, "j DOUBLE, p ARRAY<BIGINT>, q ARRAY<BIGINT>").withColumn("e", minhash.estimate("p", "q")).collect()
    assert all(abs(r.e - r.j) < minhash.MARGIN for r in rows) and rows[-1].e == 1.0


def test_sharp_estimate_is_near_the_similarity(spark):
    rng, pairs = np.random.default_rng(4), []
    for n in (1, 3, 40, 300, 2000, 9000):
        for share in (0.0, 0.5, 0.75, 0.88, 0.95, 1.0):
            for _ in range(6):
                one = rng.integers(0, 1 << 63, n, dtype=np.uint64)
                two = np.concatenate([one[: int(n * share)], rng.integers(0, 1 << 63, n - int(n * share), dtype=np.uint64)])
                pairs.append((len(np.intersect1d(one, two)) / len(np.union1d(one, two)), minhash.sketch(np.unique(one)), minhash.sketch(np.unique(two))))
    rows = spark.createDataFrame(pairs, "j DOUBLE, p ARRAY<BIGINT>, q ARRAY<BIGINT>").withColumn("e", minhash.sharp_estimate("p", "q")).collect()
    assert all(abs(r.e - r.j) < minhash.SHARP for r in rows if r.j > 0.6) and all(r.e == 1.0 for r in rows if r.j == 1)


def test_a_chain_is_linked_from_end_to_end(spark, stages):
    # neighbours in the chain are alike, the ends are not
    own = prose(40, 60).split()
    texts = [" ".join(f"n{k}" if k < 3 * step else w for k, w in enumerate(own)) for step in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    found = minhash.near_duplicates(docs, stages, size=2).collect()
    assert {r.component_id for r in found} == set(plain_components(texts, 2)[0])


@pytest.mark.parametrize("prunings", [1, 2])
def test_a_family_of_unlike_members(spark, stages, monkeypatch, prunings):
    """Texts that share most of one base, each with changes of its own or of a few kinds: buckets hold many components."""
    monkeypatch.setattr(minhash, "PRUNINGS", prunings)
    rng, base = np.random.default_rng(8), prose(50, 200).split()
    texts = []
    for k in range(160):
        changed = list(base)
        for at in rng.choice(len(base), rng.integers(0, 30), replace=False):
            changed[at] = f"own{k}x{at}" if rng.random() < 0.7 else f"some{rng.integers(0, 3)}"
        texts.append(" ".join(changed[: 200 - rng.integers(0, 30)]))
    root, _ = plain_components(texts, 2)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING").repartition(4)
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, stages, size=2).collect()}
    assert len(set(root)) > 20 and [found[i] for i in range(len(texts))] == root


def test_a_pair_is_tried_once(spark, stages, monkeypatch):
    """Components that are near each other but not linked were confirmed anew, full sets and all, in each round."""
    rng, base = np.random.default_rng(8), prose(50, 200).split()
    texts = []
    for k in range(160):
        changed = list(base)
        for at in rng.choice(len(base), rng.integers(0, 30), replace=False):
            changed[at] = f"own{k}x{at}" if rng.random() < 0.7 else f"some{rng.integers(0, 3)}"
        texts.append(" ".join(changed[: 200 - rng.integers(0, 30)]))
    tried, write = [], Stages.write

    def seen(self, name, df, *more):
        table = write(self, name, df, *more)
        if name.startswith("pairs"):
            tried.append([tuple(sorted((bytes(r.x), bytes(r.y)))) for r in table.collect()])
        return table

    monkeypatch.setattr(Stages, "write", seen)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING").repartition(4)
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, stages, size=2).collect()}
    assert [found[i] for i in range(len(texts))] == plain_components(texts, 2)[0]
    pairs = [p for t in tried for p in t]
    assert len([t for t in tried if t]) > 2 and len(pairs) == len(set(pairs))


def test_a_text_moves_once(spark, stages, monkeypatch):
    """The texts of the nodes asked for, copies among them, are dealt by one key, and by no second one."""
    texts = [prose(k % 5, 30) for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING").repartition(4)
    signed = minhash._signatures(docs.selectExpr("doc_id", "xxhash64(text) AS row_key", "cast(text AS binary) AS text"), 2)
    asked = stages.write("asked", signed.where("doc_id IN (1, 2, 8)").select("node", "row_key"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        sets = minhash._sets(docs, asked.dropDuplicates(["node"]), 2)
        plan = sets._jdf.queryExecution().executedPlan().toString()
        found = {bytes(r.node): bytes(r.shingles) for r in sets.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    shingle = minhash.Shingler(2)
    sets = [shingle(texts[k].encode()) for k in (1, 2, 3)]
    assert found == {minhash.node_of(s): s.tobytes() for s in sets}
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(row_key" in line]
    assert len(moved) == 2 and "SortMergeJoin" in plan
    assert not [line for line in plan.split("MapInArrow")[1].split("SortMergeJoin")[0].splitlines() if "Exchange" in line]


def test_open_nodes_alone_are_read_again(spark, stages, monkeypatch):
    """Sieved reads find what joins of all nodes found, and later joins see the open nodes only."""
    kept, keep = [], minhash._Search.keep_open

    def seen(self, rows):
        keep(self, rows)
        kept.append((self.nodes.columns, {bytes(r.node) for r in self.nodes.collect()}, {bytes(r.node) for r in rows.collect()}))

    monkeypatch.setattr(minhash._Search, "keep_open", seen)
    base = prose(50, 200).split()
    texts = [" ".join(base[:150] + [f"own{k}x{at}" for at in range(8 + k)]) for k in range(20)] + [prose(k, 40) for k in range(100, 160)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, stages, size=2).collect()}
    assert [found[i] for i in range(len(texts))] == plain_components(texts, 2)[0]
    (columns, nodes, rows), = kept
    assert nodes == rows and 0 < len(nodes) < len(texts) and "bands" not in columns


def test_components_that_meet_in_one_bucket_only(spark, stages, monkeypatch):
    """Bands of their own for all but one node of either component: one common bucket must link them."""
    one, two = [(i, f"{prose(60, 50)} {prose(61, 4)}") for i in (1, 2)], [(i, f"{prose(60, 50)} {prose(62, 3)}") for i in (3, 4)]
    crowd = [(10 + k, prose(100 + k, 50)) for k in range(40)]
    docs = spark.createDataFrame([*one, *two, *crowd], "doc_id BIGINT, text STRING")
    plain = minhash.Signer.__call__

    def alone(self, shingles):
        keys, low = plain(self, shingles)
        # every node in one bucket of the last band, and alone in the others
        own = int(shingles[0] % np.uint64(1 << 40))
        return [own * 64 + k for k in range(minhash.BANDS - 1)] + [7], low

    monkeypatch.setattr(minhash.Signer, "__call__", alone)
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, stages, size=1).collect()}
    texts = [t for _, t in (*one, *two, *crowd)]
    ids = [i for i, _ in (*one, *two, *crowd)]
    assert [found[i] for i in ids] == [ids[r] for r in plain_components(texts, 1)[0]] and found[3] == 1


def test_pairs_across_components_are_links(spark, stages, monkeypatch):
    """A family whose members are near the threshold to each other: what leaves the join across components is linked."""
    def text(i):
        words = [f"w{k}" for k in range(150)]
        for k in (3, 31, 62, 90, 120, 141):  # shared with some others, so bounds by size and by own words let pairs pass
            words[k + i % 5] = f"x{(i * 7 + k * k) % 11}"
        words[75] = f"own{i}"
        return " ".join(words)

    texts = [text(i) for i in range(60)]
    tried, across = [], minhash._Search.across

    def seen(self, rows, sets):
        pairs = across(self, rows, sets)
        tried.extend(pairs.distinct().collect())
        return pairs

    monkeypatch.setattr(minhash._Search, "across", seen)
    monkeypatch.setattr(minhash._Search, "first_stars", lambda self: spark.createDataFrame([], "x BINARY, y BINARY"))
    monkeypatch.setattr(minhash, "ROUNDS", 0)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, stages, size=2).collect()}
    root, _ = plain_components(texts, 2)
    assert [found[i] for i in range(len(texts))] == root
    sets = [minhash.Shingler(2)(t.encode()) for t in texts]
    of = {minhash.node_of(x): set(x.tolist()) for x in sets}
    assert tried
    for r in tried:
        x, y = of[bytes(r.x)], of[bytes(r.y)]
        assert 100 * len(x & y) >= 80 * len(x | y)


def test_most_common_is_a_bound_where_halves_collide(spark):
    one, two = [5 << 32 | 1, 5 << 32 | 2, 7 << 32], [5 << 32 | 1, 5 << 32 | 2, 9 << 32]
    rows = [([5, 7], [5, 9], 3, 3), ([1, 2], [2, 3], 2, 2), (None, [2, 3], 5000, 2)]
    found = spark.createDataFrame(rows, "p ARRAY<INT>, q ARRAY<INT>, n BIGINT, m BIGINT").select(minhash.most_common("p", "q", "n", "m").alias("c"))
    assert [r.c for r in found.collect()] == [2, 1, None] and len(set(one) & set(two)) == 2
    made = list(minhash._sketches(iter([pa.RecordBatch.from_pydict({"node": [b"a", b"b"], "shingles": [
        np.array(sorted(one), dtype=np.uint64).tobytes(), np.arange(minhash.BINS + 1, dtype=np.uint64).tobytes()]})])))
    assert made[0].column(2).to_pylist() == [[5, 7], None]


def test_components_write_one_star_at_a_time(spark, stages, monkeypatch):
    """Two stars in one plan computed the first of them for each reader, on the driver too."""
    joins, write = [], Stages.write

    def counted(self, name, df, *more):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return write(self, name, df, *more)

    monkeypatch.setattr(Stages, "write", counted)
    edges = spark.createDataFrame([(i + 1, i) for i in range(20)], "x BIGINT, y BIGINT")
    assert {r.root for r in components.components(edges, stages, "c").collect()} == {0}
    assert max(joins) == 1


def test_rooted_by_the_last_round(spark, stages):
    """Rows with the root of the round before are placed by one join."""
    search = minhash._Search.__new__(minhash._Search)
    search.roots = [spark.createDataFrame(r, "node STRING, root STRING") for r in ([("a", "b"), ("c", "b")], [("b", "d"), ("e", "d")])]
    rows = spark.createDataFrame([(x,) for x in "abcdef"], "node STRING")
    whole = search.rooted(rows, "node", "root")
    search.roots, last = search.roots[:1], search.roots[1]
    before = search.rooted(rows, "node", "root")
    search.roots = [*search.roots, last]
    after = search.rooted(before, "root", "root", 1)
    assert sorted(map(tuple, after.select("node", "root").collect())) == sorted(map(tuple, whole.select("node", "root").collect()))


def test_components_of_stars_are_written_once(spark, stages, monkeypatch):
    """Edges that are stars already went through a whole round, to find them as they were."""
    written, write = [], Stages.write
    monkeypatch.setattr(Stages, "write", lambda self, name, *more: written.append(name) or write(self, name, *more))
    edges = spark.createDataFrame([(0, k) for k in range(1, 9)] + [(20, 30), (30, 20)], "x BIGINT, y BIGINT")
    found = dict(components.components(edges, stages, "c").collect())
    assert found == {**{k: 0 for k in range(1, 9)}, 30: 20} and written == ["c-0"]


def test_rows_are_placed_by_one_join(spark, stages, monkeypatch):
    """Each round that linked components added one more join of all rows: rows made grew with the rounds."""
    rng, base = np.random.default_rng(8), prose(50, 200).split()
    texts = []
    for k in range(160):
        changed = list(base)
        for at in rng.choice(len(base), rng.integers(0, 30), replace=False):
            changed[at] = f"own{k}x{at}" if rng.random() < 0.7 else f"some{rng.integers(0, 3)}"
        texts.append(" ".join(changed[: 200 - rng.integers(0, 30)]))
    joins, linked, write = {}, set(), Stages.write

    def counted(self, name, df, *more):
        joins[name] = df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
        if name.startswith("roots"):
            linked.add(name.split("-")[1])
        return write(self, name, df, *more)

    monkeypatch.setattr(Stages, "write", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING").repartition(4)
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, stages, size=2).collect()}
    assert [found[i] for i in range(len(texts))] == plain_components(texts, 2)[0]
    assert len(linked) > 2 and joins["placed"] == 1


def test_a_sieve_is_as_large_as_its_keys_need(spark):
    keys, rows = spark.range(0, 3000, 3), spark.range(3000)
    sizes = [common.sieve(keys, "id", common.sieve_bits(n)).selectExpr("sum(size(words))").first()[0] for n in (1000, None)]
    assert sizes[0] * 64 == 1 << 16 and sizes[1] > 20 * sizes[0]
    for most in (1000, 10, None):  # too few bits let more through, and no key is lost
        through = {r.id for r in common.sieved(rows, "id", keys, "id", most).where("_in = 1").collect()}
        assert set(range(0, 3000, 3)) <= through and (most == 10 or len(through) < 1100)
    assert common.sieve_bits(1 << 40) == common.SIEVE_BITS


def test_components(spark, stages):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 130)] + [(200, 200), (300, 301), (301, 300)]
    found = dict(components.components(spark.createDataFrame(edges, "x BIGINT, y BIGINT"), stages, "c").distinct().collect())
    assert found == {**{k: 0 for k in range(1, 41)}, **{k: 100 for k in range(101, 130)}, 301: 300}


# classifier

def test_classifier_learns_and_scores_odd_rows(spark, docs, no_docs):
    good = [(k, prose(k, 60), 1) for k in range(60)]
    bad = [(k, " | ".join(prose(k, 60).split()), 0) for k in range(60, 120)]
    table = spark.createDataFrame(good + bad, "doc_id BIGINT, text STRING, quality INT")
    model = classifier.train(table.select("doc_id", "text"), table.select("doc_id", "quality").where("doc_id % 4 <> 0"), steps=80)
    held = {r.doc_id: r.score for r in classifier.score(table.where("doc_id % 4 = 0"), model).collect()}
    assert all((s >= 0.7) == (k < 60) for k, s in held.items())
    found = classifier.score(docs, model).collect()
    assert len(found) == len(rows()) and all(0 <= r.score <= 1 for r in found)
    assert classifier.score(no_docs, model).count() == 0
    untrained = classifier.train(docs.select("doc_id", "text"), spark.createDataFrame([(1, 1)], "doc_id BIGINT, quality INT"))
    assert all(0 <= r.score <= 1 for r in classifier.score(docs, untrained).collect())
    nothing = classifier.train(no_docs, spark.createDataFrame([], "doc_id BIGINT, quality INT"))
    assert {r.score for r in classifier.score(docs, nothing).collect()} == {0.5}


def test_classifier_takes_an_id_once(spark):
    labels = spark.createDataFrame([(1, 1)] * 9 + [(2, 1), (3, 1), (4, 0)], "doc_id BIGINT, quality INT")
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(50)] + [(2, "b"), (3, "c"), (4, None)], "doc_id BIGINT, text STRING")
    found = classifier.sampled(labels, docs, 3).collect()
    assert sorted((r.doc_id, bytes(r.text), r.quality) for r in found) == [(1, b"text 0", 1), (2, b"b", 1), (3, b"c", 1), (4, b"", 0)]


def test_gradients_against_differences():
    rng = np.random.default_rng(2)
    texts, labels, weights = [b"some text here", b"x" * 900, b""], np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    p = {k: v.astype(np.float64) for k, v in classifier.fit(texts, labels.astype(int), 0.5, steps=1).items()}
    p["E"], p["w"] = rng.normal(0, 0.5, p["E"].shape), rng.normal(0, 0.3, p["w"].shape)
    p["E"][classifier.PAD] = 0

    def loss():
        z = classifier.features(p, texts).astype(np.float64) @ p["w"] + p["c"][0]
        return float(np.sum(weights * (np.log1p(np.exp(z)) - labels * z)) / len(texts))

    g = classifier._gradients(p, texts, labels, weights)
    for name, at in (("E", (ord("x"), 3)), ("E", (ord("e"), 0)), ("K", (5, 7)), ("K", (40, 2)), ("b", (4,)), ("w", (9,)), ("w", (40,)), ("c", (0,))):
        keep, step = p[name][at], 1e-3
        p[name][at] = keep + step
        up = loss()
        p[name][at] = keep - step
        down = loss()
        p[name][at] = keep
        assert g[name][at] == pytest.approx((up - down) / (2 * step), abs=2e-3)


def test_scores_against_a_pass_window_by_window():
    rng = np.random.default_rng(3)
    p = {k: np.asarray(v, dtype=np.float32) for k, v in classifier.fit([], np.empty(0, dtype=np.int64), 0.4, 0).items()}
    p = {k: (v + rng.normal(0, 0.3, v.shape)).astype(np.float32) for k, v in p.items()}
    block, span = classifier.BLOCK, classifier.GROUP * classifier.BLOCK

    def plain(text):
        groups = (len(text) + block) // span + 1
        codes = [*text, *[classifier.PAD] * (groups * span - len(text))]
        maxima = []
        for g in range(groups):
            windows = range(g * span, (g + 1) * span, block)
            # the window at the end of the text is padding, so it is none
            own = [np.maximum(0, np.concatenate([p["E"][c] for c in codes[w : w + 2 * block]]) @ p["K"] + p["b"]) for w in windows if w + 2 * block <= len(codes)]
            maxima.append(np.max(own, axis=0))
        step = classifier.CHUNK - 1
        chunks = [np.max(maxima[s : s + classifier.CHUNK], axis=0) for s in range(0, max(1, groups - 1), step)]
        features = np.concatenate([np.max(chunks, axis=0), np.mean(chunks, axis=0)])
        z = float(features.astype(np.float64) @ p["w"].astype(np.float64)) + float(p["c"][0]) + float(p["prior"][0])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    texts = [b"", b"a", b"abc" * 40, bytes(rng.integers(0, 256, 124, dtype=np.uint8)), bytes(rng.integers(0, 256, 700, dtype=np.uint8)), prose(5, 300).encode()]
    assert classifier.score_texts(p, texts) == pytest.approx([plain(t) for t in texts], rel=1e-4, abs=1e-6)


def test_slabs_do_not_change_scores(monkeypatch):
    rng = np.random.default_rng(4)
    p = classifier.fit([b"a b c", b"| | |"], np.array([1, 0]), 0.5, steps=5)
    texts = [bytes(rng.integers(32, 120, n, dtype=np.uint8)) for n in (0, 1, 127, 128, 3000, 20_000, 511, 512)]
    whole = classifier.score_texts(p, texts)
    monkeypatch.setattr(classifier, "SLAB", 3)
    assert np.allclose(classifier.score_texts(p, texts), whole, atol=1e-6)
    assert np.allclose([classifier.score_texts(p, [t])[0] for t in texts], whole, atol=1e-6)


# nearest neighbours

def test_search_against_brute_force(spark, stages):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(400, 24)).astype(np.float32)
    v[100:220] = v[5]  # a hot vector
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(7, [float(x) for x in v[7]])]
    odd = [(None, rows[3][1]), (1000, None), (1020, [0.0] * 24), (1040, [float("nan")] * 24), (1060, [1.0] * 23), (1080, [None] * 24), (1100, [float("inf")] * 24)]
    table = spark.createDataFrame(rows + odd, "vec_id BIGINT, embedding ARRAY<DOUBLE>").withColumn("score", F.lit(1)).repartition(4)
    found = adsearch.search(table, table.where("vec_id % 20 = 0"), stages, k=20, probed=1.0).collect()
    exact = v.astype(np.float64) @ v.astype(np.float64).T
    hits, asked = 0, range(0, 400, 20)
    assert {r.query_id for r in found} == set(asked)
    for q in asked:
        own = sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21)) and all(r.vec_id != q for r in own)
        assert all(r.score == pytest.approx(exact[q][r.vec_id], rel=1e-12) for r in own)
        assert own == sorted(own, key=lambda r: (-r.score, r.vec_id))
        others = [i for i in range(400) if i != q]
        hits += len({r.vec_id for r in own} & set(sorted(others, key=lambda i: (-exact[q][i], i))[:20]))
    assert hits / (20 * len(asked)) >= 0.9


def test_search_of_few_and_no_vectors(spark, stages):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (20, [0.5, 0.5])], "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    found = adsearch.search(few, few.where("vec_id % 20 = 0"), stages).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in found) == [(0, 1, 1), (0, 2, 20), (20, 1, 0), (20, 2, 1)]
    assert adsearch.search(few.where("false"), few, Stages(spark, "none")).count() == 0


@pytest.mark.parametrize("n", [18, 21, 60, 500, 2000])
def test_recall_with_the_parameters_in_use(spark, stages, n):
    given = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").limit(n).select("vec_id", "embedding")
    table = stages.write("given", given)
    found = adsearch.search(table, table.where("vec_id % 20 = 0 OR vec_id < 20"), stages, k=20).collect()
    kept = table.collect()
    ids, v = np.array([r.vec_id for r in kept]), np.array([r.embedding for r in kept], dtype=np.float64)
    asked = [at for at, i in enumerate(ids) if i % 20 == 0 or i < 20]
    hits = rows = 0
    for at in asked:
        product = v @ v[at]
        best = [ids[o] for o in np.lexsort((ids, -product)) if o != at][:20]
        own = {r.vec_id for r in found if r.query_id == ids[at]}
        assert len(own) == len(best)
        hits, rows = hits + len(own & set(best)), rows + len(best)
    assert hits / rows >= (1 if n <= 21 else 0.9)


# language model


def test_texts_are_scored_few_bytes_at_a_time(spark, stages):
    """Long texts go one by one, whatever the rows of a batch, and no more than so many rows go to Python."""
    sizes = [10, 700_000, 700_000, 900_000, 5_000_000, 0, 20, 3_000_000]
    batch = pa.RecordBatch.from_pydict({"i": list(range(len(sizes))), "text": [b"a" * n for n in sizes]})
    found = list(logbilinear._slices(iter([batch, batch.slice(5)]), 1))
    assert [i for b in found for i in b.column(0).to_pylist()] == [*range(8), 5, 6, 7]
    assert all(b.num_rows == 1 or sum(len(t.as_py()) for t in b.column(1)) <= 1 << 21 for b in found) and len(found) < 9
    tails = logbilinear._tails([Counter([b"b", "é".encode(), b"b"]), Counter()])
    assert tails.to_pylist() == [[{"word": "b", "n": 2}, {"word": "é", "n": 1}], []]

    def lengths(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    rows, before = spark.range(0, 5000, 1, 1), spark.conf.get(Stages.ARROW_ROWS)
    few = stages.write("few", rows.mapInArrow(lengths, "n BIGINT"), logbilinear.TEXTS)
    assert max(r.n for r in few.collect()) == logbilinear.TEXTS and spark.conf.get(Stages.ARROW_ROWS) == before


def test_base_scores_by_counts(spark, docs, no_docs, stages, monkeypatch):
    monkeypatch.setattr(logbilinear, "HEAD", 40)
    training = F.col("doc_id").isNull() | (F.col("doc_id") != 3)
    chosen = docs.where(training).select("doc_id", "text")
    counts = stages.write("counts", logbilinear.count_words(chosen))
    stats = logbilinear.statistics(chosen, counts, head=40)
    parameters = logbilinear.train(chosen, stats, stages)
    found = logbilinear.score(docs.select("doc_id", "text"), counts, stats, parameters, stages).collect()
    own = lambda t: [*(t or "").encode().lower().split(), None]
    c = Counter(w for r in rows() if r[0] != 3 for w in own(r[1]))
    n, v = sum(c.values()), len(c)
    assert (stats.tokens, stats.types) == (n, v)
    expected = Counter()
    for r in rows():
        tokens = own(r[1])
        expected[r[0], len(tokens), sum(c[w] > 0 for w in tokens), round(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in tokens), 6)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in found) == expected
    assert all(np.isfinite(r.score) and r.score <= 0 for r in found)
    # the model's score, token by token: the network's share of its id, and for the id of all other words the word's share in it
    number, (other_tokens, other_types) = {w: i for i, w in enumerate(stats.words)}, stats.other()

    def plain(text):
        ids = [number[w] + 2 if w in number else logbilinear.OTHER for w in own(text)[:-1]] + [logbilinear.END]
        far, near, total = logbilinear.END, logbilinear.END, 0.0
        for word, i in zip(own(text), ids):
            context = parameters["R"][far] @ parameters["C2"] + parameters["R"][near] @ parameters["C1"]
            logits = (context @ parameters["Q"].T + parameters["b"]).astype(np.float64)
            total += (logits[i] - np.log(np.exp(logits - logits.max()).sum()) - logits.max()) / np.log(10)
            if i == logbilinear.OTHER:
                total += np.log10((c[word] + 1) / (other_tokens + other_types + 1))
            far, near = near, i
        return total

    scores = {}
    for r in rows():
        scores.setdefault((r[0], len(own(r[1]))), []).append(plain(r[1]))
    for r in found:
        assert any(r.score == pytest.approx(s, rel=1e-4, abs=1e-3) for s in scores[r.doc_id, r.n_tokens])
    empty, _ = logbilinear.score_documents(no_docs, F.lit(True), Stages(spark, "none"))
    assert empty.count() == 0
    untrained, stats = logbilinear.score_documents(docs, F.lit(False), Stages(spark, "none"))
    assert stats.tokens == 0 and {r.n_known for r in untrained.collect()} == {0}


def test_scores_are_normalised_and_training_helps():
    rng = np.random.default_rng(8)
    follow = rng.integers(2, 60, 60)
    words = [2]
    for _ in range(60_000):
        words.append(int(follow[words[-1]]) if rng.random() < 0.8 else int(rng.integers(2, 60)))
    ids = np.array(words)
    unigram = np.bincount(ids, minlength=logbilinear.VOCABULARY) + 1.0
    unigram /= unigram.sum()
    trainer = logbilinear.Trainer(logbilinear.start_parameters(unigram), unigram)
    far, near, word = ids[:-2], ids[1:-1], ids[2:]
    for _ in range(6):
        for i in range(0, len(word), logbilinear.BATCH):
            trainer.step(far[i : i + logbilinear.BATCH], near[i : i + logbilinear.BATCH], word[i : i + logbilinear.BATCH])
    score = logbilinear.Scorer(trainer.p)
    every = np.arange(logbilinear.VOCABULARY)
    for a, b in ((0, 0), (2, 7), (30, 1)):
        assert np.exp(score(np.full_like(every, a), np.full_like(every, b), every)).sum() == pytest.approx(1, abs=1e-3)
    assert score(far, near, word).mean() > np.log(unigram[word]).mean() + 0.3


# mixing

def test_mix_of_odd_rows(spark, docs, no_docs, stages):
    found = mixing.mix_sources(docs, stages).collect()
    assert len(found) == len(rows())
    sizes = Counter()
    for r in rows():
        sizes[r[3]] += len(words(r[1]))
    total = sum(sizes.values())
    weights = {s: (k % 3) + 1 for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    targets, capped = {}, set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        share = rest / sum(w for s, w in weights.items() if s not in capped)
        over = {s for s in sizes if s not in capped and share * weights[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    targets = {s: 3 * sizes[s] if s in capped else share * weights[s] for s in sizes}
    assert Counter((r.size, r.source_size, round(r.target, 6)) for r in found) == Counter((len(words(r[1])), sizes[r[3]], round(targets[r[3]], 6)) for r in rows())
    assert all(0 <= r.copies <= 3 for r in found)
    again = mixing.mix_sources(docs.repartition(7), Stages(spark, "again")).collect()
    assert by_row(found, "row_key", "copies") == by_row(again, "row_key", "copies")
    assert mixing.mix_sources(no_docs, Stages(spark, "none")).count() == 0
    mixed = mixing.mix_documents(docs, Stages(spark, "mixed"))
    assert mixed.columns == [f.name for f in DOCS] and mixed.count() == sum(r.copies for r in found)


def test_rounding_keeps_mass_and_is_fair(spark, stages):
    rng = np.random.default_rng(9)
    items = [("a" if k % 3 else "b", k, 0.3 if k % 3 else 0.62, float(rng.integers(1, 200))) for k in range(6000)]
    table = spark.createDataFrame(items, "stratum STRING, k BIGINT, p DOUBLE, s DOUBLE")
    taken = dict(mixing.pivotal_round(table, stages, group=32).collect())
    assert len(taken) == len(items) and set(taken.values()) <= {0, 1}
    for stratum in "ab":
        own = [(k, p, s) for t, k, p, s in items if t == stratum]
        assert abs(sum(taken[k] * s for k, _, s in own) - sum(p * s for _, p, s in own)) <= 100.0001
        assert np.mean([taken[k] for k, _, _ in own]) == pytest.approx(own[0][1], abs=0.05)


def test_rounding_leaves_a_short_one(spark, stages):
    """A few very long items among many short ones: what is rounded on its own at last is short, and sizes are treated alike."""
    rng = np.random.default_rng(12)
    items = [("a", k, 0.45, float(20_000 if k % 100 == 0 else rng.integers(1, 300))) for k in range(8000)]
    table = spark.createDataFrame(items, "stratum STRING, k BIGINT, p DOUBLE, s DOUBLE")
    taken = dict(mixing.pivotal_round(table, stages).collect())
    assert len(taken) == len(items)
    assert abs(sum(taken[k] * s for _, k, _, s in items) - sum(p * s for _, _, p, s in items)) <= 150
    assert np.mean([taken[k] for _, k, _, s in items if s == 20_000]) == pytest.approx(0.45, abs=0.2)
    assert np.mean([taken[k] for _, k, _, s in items if s < 300]) == pytest.approx(0.45, abs=0.03)


def test_mix_is_near_its_targets(spark, stages):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = mixing.mix_sources(docs, stages).join(docs.select("doc_id", "source"), "doc_id").collect()
    sources = {}
    for r in found:
        sources.setdefault(r.source, []).append(r)
    assert len(sources) > 5
    for own in sources.values():
        short = min((r.size for r in own if r.size), default=0)
        off = abs(sum(r.copies * r.size for r in own) - own[0].target)
        assert off <= max(0.02 * own[0].target, short / 2 + 1e-6)
