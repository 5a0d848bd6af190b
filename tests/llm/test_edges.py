"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns for every operator."""

from __future__ import annotations

import gzip
import random
import re
import time
import string
import time
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from visitlens.llm import bpe, components, decontam, exact, linedup, pii, secretscan, simhash, toxicity, urlgraph, warc
from visitlens.llm.shared import shared_dir

from . import brute

DDL = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use themselves.
NAMES = ("rid", "h", "fp", "score", "kept", "seg", "line", "key", "n", "base", "leaks", "keeper", "component", "id", "digest")
LONG = " ".join(f"w{i}" for i in range(30_000)) + "\n" + "x" * 200_000
TEXTS = [None, "", "", "same text here with some words", "same text here with some words", "Same Text", "a\nb\n\na", LONG, "é" * 50 + " ñ", "line one is quite long enough\n" * 3, "🦊 " * 40]


def clash(df):
    return df.withColumns({c: F.lit("x") for c in NAMES})


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    rows = [(i, t, None, None, None) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], None, None, None), (None, "same text here with some words", None, None, None), (None, None, None, None, None)]
    spark.createDataFrame(rows, DDL).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).transform(clash)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DDL).transform(clash)


def test_exact(docs, none):
    rows = exact.exact_dedup(docs).collect()
    assert len(rows) == len(TEXTS) + 3
    groups = {}
    for r in rows:
        groups.setdefault(r.text_sha256, []).append(r)
    for g in groups.values():
        assert sum(r.kept for r in g) == 1 and {r.group_size for r in g} == {len(g)}
        ids = [r.doc_id for r in g if r.doc_id is not None]
        assert {r.keep_id for r in g} == {max(ids, default=None)}
    assert exact.exact_dedup(none).count() == 0


def test_exact_survives_a_tiny_filter(spark, tmp_path):
    path = str(tmp_path / "d")
    spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 9000).cast("string")).alias("text")).write.parquet(path)
    got = exact.exact_dedup(spark.read.parquet(path), max_bits=1 << 14)
    want = spark.read.parquet(path).groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    assert got.where("kept").count() == want.count()
    assert got.agg(F.sum("group_size")).first()[0] == want.agg(F.sum(F.col("n") * F.col("n"))).first()[0]


def test_lines(docs, none):
    rows = linedup.line_dedup(docs, min_docs=2).collect()
    assert len(rows) == len(TEXTS) + 3
    kept = sorted(r.doc_id for r in rows if r.text and r.text.startswith("same text") and r.doc_id is not None)
    assert kept == [4]
    assert {r.n_dropped for r in rows if r.text == "" and r.doc_id == 0} == {0}
    assert linedup.line_dedup(none).count() == 0


def test_line_runs_in_many_batches(spark, tmp_path):
    rng = random.Random(5)
    lines = ["a common line number %d that is long" % i for i in range(30)] + ["short"]
    data = [(i, "\n".join(rng.choice(lines).upper() if rng.random() < 0.2 else rng.choice(lines) + " " * rng.randrange(3) for _ in range(rng.randrange(6)))) for i in range(120)]
    path = str(tmp_path / "d")
    spark.createDataFrame(data, "doc_id long, text string").repartition(4).write.parquet(path)
    want = brute.lines(data)
    for r in linedup.line_dedup(spark.read.parquet(path), batches=6, fanout=2).collect():
        n, kept = want[r.doc_id]
        assert (r.n_lines, r.n_dropped, r.text) == (n, n - len(kept), "\n".join(kept))


def test_lines_by_names(spark):
    """Ids that are no numbers are parted in batches too; reserved names are refused."""
    rng = random.Random(6)
    lines = [f"a common line number {i} that is long" for i in range(20)]
    data = [(f"doc-{i:03}", "\n".join(rng.choices(lines, k=rng.randrange(5)))) for i in range(60)]
    df = spark.createDataFrame(data, "doc_id string, text string")
    want = brute.lines(data)
    for r in linedup.line_dedup(df, batches=2, batch_lines=40).collect():
        n, kept = want[r.doc_id]
        assert (r.n_lines, r.n_dropped, r.text) == (n, n - len(kept), "\n".join(kept))
    for name in ("__rid", "__drop"):
        with pytest.raises(ValueError):
            linedup.line_dedup(df.withColumn(name, F.lit(1)))
    with pytest.raises(ValueError):
        simhash.near_dedup(df.withColumn("__rid", F.lit(1)))


def test_simhash(docs, none):
    rows = simhash.simhash_components(docs, width=3).collect()
    assert len(rows) == len(TEXTS) + 3
    assert {r.component_id for r in rows if r.fingerprint == "0" * 16} == {0}
    assert simhash.simhash_components(none).count() == 0
    assert simhash.near_dedup(none).count() == 0


def test_tree_finds_every_pair(spark):
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    points = set()
    for c in centres:
        for _ in range(12):
            x = int(c)
            for b in rng.choice(64, rng.integers(0, 3), replace=False):
                x ^= 1 << int(b)
            points.add(x)
    points = sorted(points)
    df = spark.createDataFrame([(simhash.signed(p),) for p in points], "fp long")
    links = [(simhash.signed(a), simhash.signed(b)) for k, a in enumerate(points) for b in points[:k] if (a ^ b).bit_count() <= 2]
    found = {r.node: r.component for r in components.connected_components(simhash.near_links(df, reach=2, shard=20)).collect()}
    want = brute.components([simhash.signed(p) for p in points], links)
    assert {k: v for k, v in want.items() if k in found or v != k} == found


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(1, i) for i in range(2, 60)] + [(3, 2), (2, 3), (7, 7)]
    found = {r.node: r.component for r in components.connected_components(spark.createDataFrame(chain + hub, "a long, b long")).collect()}
    assert {found[i] for i in range(100, 161)} == {100} and {found[i] for i in range(1, 60)} == {1}


def test_near_dedup(spark, tmp_path):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices(string.ascii_lowercase, k=5))
    base = [[word() for _ in range(300)] for _ in range(12)]
    data = []
    for i, w in enumerate(base):
        data.append((10 * i, " ".join(w)))
        for j in range(1, 6):
            v = list(w)
            v[rng.randrange(300)] = word()
            v.insert(rng.randrange(300), word())
            data.append((10 * i + j, " ".join(v)))
    data += [(1000, None), (1001, ""), (1002, "one two")]
    path = str(tmp_path / "d")
    spark.createDataFrame(data, "doc_id long, text string").repartition(4).write.parquet(path)
    kept = sorted(r.doc_id for r in simhash.near_dedup(spark.read.parquet(path)).collect())
    assert kept == [10 * i for i in range(12)] + [1000, 1002]


def test_leaks(spark, docs, none):
    rng = random.Random(3)
    item = " ".join("".join(rng.choices(string.ascii_lowercase, k=rng.randrange(2, 9))) for _ in range(40))
    edited = item.replace(item[50:53], "zz", 1)
    texts = [item, "before " + edited.upper() + "!! after", item[: len(item) // 4], "nothing of it", LONG + item, item.replace(" ", " ** ")]
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (None, item), (10, "tiny")], "item_id long, text string")
    got = {r.doc_id: sorted((x.item_id for x in r.leaks), key=str) for r in decontam.benchmark_leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bench, block_chars=100).collect()}
    assert got == {0: [7, None], 1: [7, None], 2: [], 3: [], 4: [7, None], 5: [7, None]}  # an item without an id is one too
    assert decontam.benchmark_leaks(docs, bench).count() == len(TEXTS) + 3
    assert decontam.benchmark_leaks(docs, bench.limit(0)).where("size(leaks) > 0").count() == 0
    assert decontam.benchmark_leaks(none, bench).count() == 0


def test_banded_edits():
    rng = random.Random(4)
    for _ in range(200):
        a = [rng.randrange(3) for _ in range(rng.randrange(1, 25))]
        b = [x for x in a if rng.random() > 0.1] + [rng.randrange(3) for _ in range(rng.randrange(3))]
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
        assert decontam.edits_within(np.array(a), np.array(b), 5) == min(d[-1], 6)


def test_warc(spark, tmp_path):
    body = "".join(random.Random(2).choices("abc\r\n\tWARC/1.1é", k=90_000)) + "WARC/1.1\r\n" * 50
    data = [(1, "http://a", body), (2, None, body), (3, "http://b\r\nX: y", None), (4, "u", ""), (0, "u", "small"), (None, "u", "small"), (5, "u", "\r\n\r\n0\r\n\r\n")]
    path = str(tmp_path / "p")
    spark.createDataFrame(data, "page_id long, url string, html string").repartition(2).write.parquet(path)
    pages = spark.read.parquet(path).transform(clash)
    rows = warc.reassemble(warc.read_warc(spark, warc.archive_pages(pages, segment_bytes=5000, chunk_bytes=700))).collect()
    assert len(rows) == len(data) and all(r.valid for r in rows)
    got = {r.record_id.split(":")[2]: r for r in rows}
    assert got["1"].payload.decode() == body and got["1"].segments > 10 and got["2"].type == "revisit"
    assert got["2"].refers_to == got["1"].record_id and got["2"].payload_bytes == len(body.encode())
    assert got["null"].refers_to == got["0"].record_id and got["4"].refers_to == got["3"].record_id
    parts = warc.read_warc(spark, warc.archive_pages(pages, segment_bytes=5000))
    broken = warc.reassemble(parts.where("segment is null or segment <> 3")).where("not valid").collect()
    assert [r.payload for r in broken] == [None]
    empty = warc.archive_pages(spark.read.parquet(path).limit(0))
    assert warc.reassemble(warc.read_warc(spark, empty)).count() == 0


def test_warc_urls_that_look_like_records(spark):
    urls = ["http://x/WARC/1.1", "http://x/WARC/1.1\r\n", "WARC/1.0", "a\r\n\r\nWARC/1.1\r\nb", ""]
    df = spark.createDataFrame([(i, u, f"page {i} \r\n\r\nWARC/1.0\r\n" * 9) for i, u in enumerate(urls)], "page_id long, url string, html string")
    rows = warc.reassemble(warc.read_warc(spark, warc.archive_pages(df, segment_bytes=50, chunk_bytes=20))).collect()
    assert sorted((r.record_id.split(":")[2], r.type, r.valid) for r in rows) == [(str(i), "response", True) for i in range(5)]
    assert {r.payload.decode() for r in rows} == {r.html for r in df.collect()}


def test_warc_records_at_the_borders_of_buffers(spark, tmp_path):
    """Every place of a record's end against the reader's buffer of 64 KB."""
    for shift in range(24):
        head = "WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:{}>\r\nContent-Length: {}\r\n\r\n"
        size = 65536 - 18 + shift - len(head.format(f"a{shift}", 65000))
        first = head.format(f"a{shift}", size) + "x" * (size - 4) + "\r\n\r\n" + "\r\n\r\n"
        (tmp_path / f"{shift}.warc").write_text(first + head.format(f"b{shift}", 2) + "ok\r\n\r\n", newline="")
    rows = warc.read_warc(spark, str(tmp_path)).select("record_id", "complete").collect()
    assert sorted(r.record_id for r in rows) == sorted(f"<urn:x:{c}{i}>" for c in "ab" for i in range(24))
    assert all(r.complete for r in rows)


def test_warc_of_others(spark, tmp_path):
    """Older versions, a gzip member for each record, malformed headers and segments sent twice."""

    def record(version, block, *head):
        return f"WARC/{version}\r\n".encode() + "".join(f"{x}\r\n" for x in head).encode() + b"\r\n" + block + b"\r\n\r\n"

    body = b"HTTP/1.1 200 OK\r\n\r\n"
    made = [record(v, body + b"hello", "WARC-Type: response", f"WARC-Record-ID: <{v}>", f"Content-Length: {len(body) + 5}") for v in ("1.0", "1.1")]
    made += [record("1.0", b"x", "WARC-Type: response", f"WARC-Record-ID: <bad{i}>", h) for i, h in enumerate(("Content-Length: many", "Content-Length: -5", "X: y", "Content-Length: 99"))]
    made.append(record("1.1", b"x", "WARC-Type: response", "WARC-Record-ID: <bad4>", "Content-Length: 1", "WARC-Segment-Number: two"))
    made.append(record("1.1", b"HTTP/1.1 200 OK\r\nContent-Length: ?\r\n\r\n", "WARC-Type: revisit", "WARC-Record-ID: <again>", "Content-Length: 40"))
    parts = [(1, body + b"ab"), (2, b"cd"), (2, b"dd"), (3, b"ef")]
    for n, block in parts:
        more = ["WARC-Segment-Origin-ID: <s>"] * (n > 1) + [f"WARC-Segment-Total-Length: {len(body) + 6}"] * (n == 3)
        made.append(record("1.1", block, f"WARC-Type: {'continuation' if n > 1 else 'response'}", f"WARC-Record-ID: <{'s' if n == 1 else (n, block)}>", f"WARC-Segment-Number: {n}", f"Content-Length: {len(block)}", *more))
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, made)))
    (tmp_path / "b.warc").write_bytes(b"".join(made).replace(b"<", b"<plain-"))
    rows = {r.record_id: r for r in warc.reassemble(warc.read_warc(spark, str(tmp_path))).collect()}
    for k in ("", "plain-"):
        assert rows[f"<{k}1.0>"].payload == rows[f"<{k}1.1>"].payload == b"hello" and rows[f"<{k}1.0>"].valid
        assert [rows[f"<{k}bad{i}>"].valid for i in range(5)] == [False] * 5 and rows[f"<{k}again>"].payload_bytes == 0
        assert rows[f"<{k}s>"].valid and rows[f"<{k}s>"].payload == b"abcdef" and rows[f"<{k}s>"].segments == 3


def test_urls(spark):
    link = '<a href="http://bad.net/x">x</a> <a href=\'//Hub.org/\'>y</a> <a href="/own">z</a>'
    data = [(i, f"http://spam{i}.net/en/{i}", link) for i in range(3)] + [(10, "http://bad.net/es/1", None), (11, None, None), (12, "no scheme", ""), (13, "HTTPS://WWW.Example.COM:80/en/?q#f", None), (14, "http://x.com", None), (15, "http://hub.org/a", None), (15, "http://hub.org/a", None)]
    rules = [urlgraph.Rule(True, "com"), urlgraph.Rule(False, "net", "/es/")]
    rows = urlgraph.judge_urls(spark.createDataFrame(data, "page_id long, url string, html string").transform(clash), rules).collect()
    got = {r.page_id: r for r in rows}
    assert len(rows) == len(data)
    assert got[13].host == "www.example.com:80" and got[13].rule is None
    assert (got[14].host, got[14].path, got[14].rule) == ("x.com", "", None)
    assert [got[i].verdict for i in (0, 10, 11, 12, 15)] == ["block", "block", "allow", "allow", "allow"]
    assert got[0].distrust > 0 and got[0].trust == 0
    assert urlgraph.judge_urls(spark.createDataFrame([], "page_id long, url string, html string"), rules).count() == 0


def test_pii(docs, none, spark):
    assert pii.find_pii(docs).count() == len(TEXTS) + 3
    assert pii.find_pii(none).count() == 0
    hard = ["a@b.c_d@e.f", "1" * 5000 + " " + "a." * 3000, "+" * 50 + "1 2", "256.1.1.1 0255.001.1.1 1.2.3.4.5.6.7.8", "4111 1111 1111 1111-1", "x@y.z" * 20, "+1 (2)3.4-5 67 890 +", "🦊 a@b.cd"]
    rows = pii.find_pii(spark.createDataFrame(list(enumerate(hard)), "doc_id long, text string")).select("doc_id", pii.span_text(F.col("base")).alias("b")).collect()
    assert {r.doc_id: r.b for r in rows} == {i: brute.spans(brute.pii(t)) for i, t in enumerate(hard)}


def test_secrets(docs, none, spark):
    rng = random.Random(8)
    key = lambda a, n: "".join(rng.choices(a, k=n))
    upper, hexa, mixed = string.ascii_uppercase + string.digits, "0123456789abcdef", string.ascii_letters + string.digits
    word = lambda: key(string.ascii_lowercase, rng.randrange(3, 12))
    filler = lambda: " ".join(word() for _ in range(120)) + " well-known 2024-05-06 Title."
    data = [(i, f"x AKIA{key(upper, 16)} y token = \"{key(hexa, 40)}\" ſecret=abcdef {filler()}") for i in range(120)]
    data += [(200 + i, f"secret: {key(mixed, 20)}.{key(mixed, 30)}.{key(mixed, 25)} password={key(mixed, 12)} {filler()}") for i in range(150)]
    bare = [f"ASIA{key(upper, 16)}", f"use ASIA{key(upper, 16)}. Then", f"see ASIA{key(upper, 16)}, or", f"é k=ASIA{key(upper, 16)}", f"({key(mixed, 20)}.{key(mixed, 30)}.{key(mixed, 25)}.)"]
    data += [(900 + i, t) for i, t in enumerate(bare)]
    data += [(950, "an ordinary sentence of long-winded-hyphenated-words 2024"), (951, "PASSWORD: abc token=abcde"), (952, "information. +1 555 0100 and 4111111111111111")]
    data += [(960, "secret=" + "aB3" * 2000)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    formats = secretscan.fit_automata(df)
    got = {r.doc_id: r for r in secretscan.scan_secrets(df, formats).collect()}
    for i, t in data:
        assert [(x.kind, x.start, x.end) for x in got[i].base] == brute.secrets(t)
    for i, t in enumerate(bare):
        token = t.strip("().") if i == 4 else t[t.index("ASIA") :][:20]
        assert [(x.start, x.end) for x in got[900 + i].added] == [(t.index(token), t.index(token) + len(token))], t
    assert [got[900 + i].added[0].kind for i in range(4)] == ["access"] * 4
    assert not any(got[i].added for i in (950, 951, 952))
    assert not any(x for i in range(120) for x in got[i].added)
    nothing = secretscan.fit_automata(docs)
    assert nothing.automata == {} and secretscan.scan_secrets(docs, nothing).count() == len(TEXTS) + 3
    assert secretscan.scan_secrets(none, formats).count() == 0


def test_every_run_is_scored():
    """The spans of the scan are those of scoring each run and its parts anew."""
    rng = random.Random(12)
    formats = secretscan.Formats({"hex": secretscan.infer(["".join(rng.choices("hd", k=rng.randrange(8, 20))) for _ in range(200)])}, {}, 3.0)
    formats.automata["hex"].least = -2.0
    signs = "dhlU+/_.=-"
    formats.pairs.update({a + b: -2.5 for a in "^" + signs for b in signs + "$"})
    for _ in range(300):
        text = "".join(rng.choices("0a1b.=/ é", weights=[5, 5, 5, 5, 1, 1, 1, 1, 1], k=80))
        want = []
        for m in re.finditer("[0-9a-z.=/]{6,}", text):
            whole = m[0].rstrip(".")
            parts = [(0, len(whole))] if len(whole) >= 6 and formats.kind(secretscan.symbols(whole)) else [x.span() for x in re.finditer("[^.=/]{6,}", whole)]
            want += [(m.start() + s, m.start() + e, "hex") for s, e in parts if formats.kind(secretscan.symbols(m[0][s:e]))]
        assert secretscan.added_spans(text, [], formats) == want


def test_bpe_pieces():
    e, own = brute.encoding(), bpe.Encoder(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    rng = random.Random(6)
    for _ in range(400):
        text = "".join(rng.choices("aaabethn  \n\t'sé🦊0099.,-ñß", k=rng.randrange(60)))
        assert own.encode(text) == e.encode_ordinary(text) and own.decode(own.encode(text)) == text.encode()
        piece = "".join(rng.choices("abcdeth", k=rng.randrange(1, 30))).encode()
        table = bpe.PrefixTable(own.vocabulary, piece[: len(piece) // 2])
        table.append(piece[len(piece) // 2 :])
        whole = bpe.PrefixTable(own.vocabulary, piece)
        assert table.last == whole.last
        a = rng.randrange(len(piece))
        table.replace(a, a + 1, b"xy")
        assert table.last == bpe.PrefixTable(own.vocabulary, piece[:a] + b"xy" + piece[a + 1 :]).last
        assert table.tokens(a) == whole.tokens(a)


def test_bpe_edits_stop_where_nothing_changes():
    v, rng = bpe.Vocabulary(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))), random.Random(11)
    longest = v.longest
    for size in (40, 3 * longest, 20 * longest):
        piece = "".join(rng.choices("abcdeth rns", k=size)).encode()
        table = bpe.PrefixTable(v, piece)
        for _ in range(12):
            a = rng.randrange(len(table.piece))
            b, new = min(len(table.piece), a + rng.randrange(4)), "".join(rng.choices("abth", k=rng.randrange(4))).encode()
            want = table.piece[:a] + new + table.piece[b:]
            found = table.replace(a, b, new)
            assert table.piece == want and table.last == bpe.PrefixTable(v, want).last
            assert found <= max(len(want) - a, 0) and (len(want) - a < 6 * longest or found <= 4 * longest)


def test_bpe_rows(docs, none):
    args = {"ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}
    rows = bpe.encode_texts(docs, ids=True, **args).collect()
    assert sorted(r.decoded for r in rows) == sorted(t or "" for t in [*TEXTS, TEXTS[4], "same text here with some words", None])
    assert bpe.encode_texts(none, **args).count() == 0


def test_segments_match_brute_force():
    """All maximal segments: the best one, then those of what lies before it and after it."""

    def plain(s, base=0):
        spans = [(s[i:j].sum(), i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)]
        x, i, j = max(spans, default=(0, 0, 0))
        return [*plain(s[:i], base), (base + i, base + j, x), *plain(s[j:], base + j)] if x > 0 else []

    rng = np.random.default_rng(9)
    for _ in range(150):
        s = rng.normal(-0.3, 1, rng.integers(0, 25))
        found, want = toxicity.maximal_segments(s), plain(s)
        assert [x[:2] for x in found] == [x[:2] for x in want]
        assert [x[2] for x in found] == pytest.approx([x[2] for x in want])


def test_segments_take_linear_time():
    """Falling sums hold every segment open; going back over all of them took minutes."""
    scores = np.where(np.arange(400_000) % 2 == 0, 1.0, -1.1)
    begin = time.process_time()
    assert len(toxicity.maximal_segments(scores)) == 200_000
    assert time.process_time() - begin < 5


def test_toxicity(docs, none, spark):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(8)] + [(None, 1, 1), (1, 1, None), (99, 0, 5)], "doc_id long, quality int, toxic int")
    for model in (toxicity.fit_toxicity(docs, labels), toxicity.fit_toxicity(docs, labels.limit(0)), toxicity.fit_toxicity(none, labels)):
        rows = toxicity.score_toxicity(docs, model).collect()
        assert len(rows) == len(TEXTS) + 3 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert toxicity.score_toxicity(none, model).count() == 0


def test_parts_of_items_leak():
    """Any part that is long enough leaks, however much the rest of the item is changed."""
    rng = random.Random(9)
    limits = {"error": 0.06, "least_chars": 60, "share": 0.6}
    table = decontam._fold_table()
    word = lambda n: "".join(rng.choices(string.ascii_lowercase, k=n))
    item = "".join(rng.choices(string.ascii_lowercase, k=240))
    changed = list(item)
    for at in (155, 180, 205):
        changed[at : at + 7] = [rng.choice("0123456789") for _ in range(6)] + [changed[at + 6]]
    short = word(60)
    cases = [(item, "".join(changed), True), (item, item[:120] + word(120), False), (short, short[:4] + "0" + short[5:], True), (short, short[:54] + "0" + short[55:], True), (item, item[40:190], True)]
    cases += [(x, y, True) for x in [word(84)] for y in ["".join(c if k % 11 != 10 or k > 60 else "0" for k, c in enumerate(x[:68]))]]
    for one, text, leaks in cases:
        q = decontam.gram_length(len(one), q=12, **limits)
        index = decontam.build_index([(1, one)], q=q, **limits)
        found = decontam.find_leaks([decontam.fold(f"{word(30)} {text} {word(30)}", table)], index, q)
        assert bool(found) == leaks, (one, text)
        for _, _, start, end, edits in found:
            assert 0 <= start < end and edits <= index.edits[0]


def test_trust_reaches_the_end_of_a_chain(spark):
    """Distrust goes on over more than twelve links."""
    hosts = spark.createDataFrame([(f"h{i}", False, i == 20, 1) for i in range(21)], "host string, trusted boolean, blocked boolean, pages long")
    links = spark.createDataFrame([(f"h{i}", f"h{i + 1}", 1) for i in range(20)], "src string, dst string, n long")
    found = urlgraph.propagate(hosts, links, damping=0.85, rounds=120, tolerance=1e-6).collect()
    got = {r.host: r.distrust for r in found}
    share = 1 / sum(0.85**k for k in range(21))  # what reaches h0, which nobody links to, starts again
    assert all(abs(got[f"h{20 - k}"] - share * 0.85**k) < 1e-5 for k in range(21))
    assert sum(r.distrust for r in found) == pytest.approx(1.0) and sum(r.rank for r in found) == pytest.approx(1.0)
    with pytest.raises(RuntimeError):
        urlgraph.propagate(hosts, links, damping=0.85, rounds=12, tolerance=1e-6)


def test_secrets_of_a_text_with_very_many_spans():
    """50,000 digests and as many runs between them: spans are merged in order, not compared with each other."""
    text = " ".join(f"{i:024x} zq-{i:07d}Zq" for i in range(50_000))
    base = secretscan.base_spans(text)
    assert len(base) == 50_000
    signs = "dhlU+/_.=-"
    any_format = secretscan.Formats({"hex": secretscan.infer(["ll-dddddddUl"] * 30)}, {a + b: -3.0 for a in "^" + signs for b in signs + "$"}, 1.0)
    any_format.automata["hex"].least = -5.0
    began = time.process_time()
    found = secretscan.added_spans(text, base, any_format)
    assert time.process_time() - began < 30
    assert [text[s:e][:3] for s, e, _ in found[:2]] == ["zq-", "zq-"] and len(found) == 50_000


def test_lines_without_a_copy(spark, tmp_path):
    """Of stored documents no copy stays on disk, and the texts are joined alike at any size."""
    rng = random.Random(8)
    lines = [f"a common line number {i} that is long" for i in range(20)]
    data = [(i // 2, "\n".join([*rng.choices(lines, k=rng.randrange(4)), rng.randbytes(2000).hex()])) for i in range(400)]
    path = str(tmp_path / "a folder, é")
    spark.createDataFrame(data, "doc_id long, text string").repartition(5).write.parquet(path)
    size = lambda folder: sum(f.stat().st_size for f in Path(folder).rglob("*.parquet"))
    scratch = Path(shared_dir(spark).removeprefix("file:")) / "visitlens"
    docs, before = spark.read.parquet(path), size(scratch)
    found = linedup.line_dedup(docs.where("doc_id >= 0").select("text", "doc_id"), batches=4, stored=True)
    rows = found.collect()
    assert size(scratch) - before < 0.1 * size(path)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and plan.count("BroadcastHashJoin") <= 2  # the list of files
    assert found.columns == ["text", "doc_id", "n_lines", "n_dropped"] and len(rows) == len(data)
    want = linedup.line_dedup(docs, batches=4)
    assert sorted((r.doc_id, r.n_lines) for r in rows) == sorted((r.doc_id, r.n_lines) for r in want.collect())
    left = [x for r in rows for x in r.text.split("\n") if x in lines]
    assert sorted(set(left)) == sorted(lines) and len({(r.doc_id, x) for r in rows for x in r.text.split("\n") if x in lines}) == len(lines)
    assert sum(r.n_dropped for r in rows) == sum(x in lines for _, t in data for x in t.split("\n")) - len(left)
