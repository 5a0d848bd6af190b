"""Each stage of the pipeline on what its predecessor kept, against plain versions."""

from __future__ import annotations

import os
import random
import re
import time
from collections import defaultdict
from pathlib import Path

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from visitlens.llm import simhash, toxicity  # noqa: E402
from visitlens.llm.shared import shared_dir, write_table  # noqa: E402

from . import brute  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output rows of every stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = write_table(stage(spark, docs, SF), "test-stage")
        out[name] = (docs.collect(), after.collect(), docs.columns, after.columns)
        docs = after
    return out


def test_columns(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == list(stages) and len(names) == 5
    for n in names[:-1]:
        assert stages[n][2] == stages[n][3] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_toxicity(spark, stages):
    before, after, *_ = stages["toxicity"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = model.scorer()
    want = {r.doc_id for r in before if model.probability(model.read(scores(toxicity.WORDS.findall((r.text or "").lower())))[0]) < 0.5}
    assert {r.doc_id for r in after} == want


def test_lines(stages):
    before, after, *_ = stages["line dedup"]
    want = brute.lines([(r.doc_id, r.text) for r in before])
    texts = {i: "\n".join(kept) for i, (n, kept) in want.items()}
    gone = {i for i, (n, kept) in want.items() if texts[i] == "" and n > len(kept)}
    assert {r.doc_id: r.text for r in after} == {i: t for i, t in texts.items() if i not in gone}
    changed = {i for i, (n, kept) in want.items() if n > len(kept)}
    assert all(r.n_chars == len(r.text) for r in after if r.doc_id in changed)


def test_near_copies(stages):
    before, after, *_ = stages["SimHash near-dedup"]
    sets = {r.doc_id: set(brute.shingles(r.text, 5)) for r in before}
    index = defaultdict(set)
    for i, s in sets.items():
        for x in s or {None}:
            index[x].add(i)
    links = {(max(i, j), min(i, j)) for ids in index.values() for i in ids for j in ids if i != j}
    alike = [(a, b) for a, b in links if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    found = brute.components(sets, alike)
    assert {r.doc_id for r in after} == {i for i in sets if found[i] == i}


def test_leaks(spark, stages):
    before, after, *_ = stages["benchmark decontamination"]
    fold = lambda t: " ".join("".join(c.lower() if c.isalnum() else " " for c in t or "").split())
    items = [fold(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in after}
    for r in before:
        text = fold(r.text)
        if any(x in text for x in items):
            assert r.doc_id not in kept
        elif not any(x[k : k + len(x) // 3] in text for x in items for k in (0, len(x) // 3, 2 * len(x) // 3)):
            assert r.doc_id in kept


def test_tokens(stages):
    before, after, *_ = stages["byte-level BPE encoding and decoding"]
    e, want = brute.encoding(), {r.doc_id: r.text or "" for r in before}
    assert {r.doc_id for r in after} == set(want)
    for r in after:
        ids = e.encode_ordinary(want[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(want[r.doc_id]))


def test_registered(spark):
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries() and corpus_pipeline.ORACLE_SQL is None


def test_short_near_copies(spark):
    """A word more, or another first word, makes a near copy of any short text."""
    rng, docs, want = random.Random(1), [], set()
    for i in range(60):
        text = [f"w{rng.randrange(10**6)}" for _ in range(9 + i % 25)]
        docs += [(3 * i, " ".join(text)), (3 * i + 1, " ".join([*text, "more"])), (3 * i + 2, " ".join(["other", *text[1:]]))]
        sets = [set(brute.shingles(t, 5)) for _, t in docs[-3:]]
        want |= {3 * i + k for k in range(3) if not any(len(sets[k] & s) >= 0.8 * len(sets[k] | s) for s in sets[:k])}
    table = write_table(spark.createDataFrame(docs, "doc_id long, text string"), "short")
    kept = simhash.near_dedup(table).collect()
    assert {r.doc_id for r in kept} == want
    assert len(want) < 100


def test_near_copies_in_a_family_with_boilerplate(spark):
    """Near copies that have only boilerplate passages in common with the first text of the family."""
    rng, docs, want = random.Random(2), [], set()
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    common = words(140)
    for i in range(40):
        own = words(60)
        for k in range(2):
            docs.append((2 * i + k, " ".join([*own[: 30 - k], *["edit"] * k, *own[30:], *common])))
        want.add(2 * i)
    table = write_table(spark.createDataFrame(docs, "doc_id long, text string"), "family")
    assert {r.doc_id for r in simhash.near_dedup(table).collect()} == want


def test_edges(spark, tmp_path):
    """Null, empty and very long texts, null ids, repeated rows, more columns, and no rows, through every stage."""
    texts = [None, "", "a few words that stand here twice", "a few words that stand here twice", " ".join(f"w{i}" for i in range(20_000)), "é\n\n🦊"]
    rows = [(i, t, None, None, None, "x") for i, t in enumerate(texts)] + [(2, texts[2], None, None, None, "x"), (None, None, None, None, None, None)]
    ddl = "doc_id long, text string, lang string, source string, n_chars long, rid string"
    for part in (rows, []):
        docs = write_table(spark.createDataFrame(part, ddl), "edges")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = write_table(stage(spark, docs, SF), "edges")
            assert after.columns == docs.columns and after.count() <= docs.count()
            docs = after
        kept = sorted(r.doc_id for r in docs.collect())
        assert kept == ([0, 3, 4, 5] if part else [])  # the common line stays in 3
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(kept)


def scratch(spark):
    folder = Path(shared_dir(spark).removeprefix("file:")) / "visitlens"
    return {f.name for f in folder.iterdir()} if folder.exists() else set()


def shuffled(spark):
    """Shuffle files on this machine's disk."""
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f.name for d in folders for f in Path(d).rglob("shuffle_*.data")}


@pytest.mark.parametrize(
    ("stage", "stay"),
    [(1, {"line-input", "line-drops"}), (2, {"near-input", "near-gone", "star-links"})],
)
def test_disk_is_freed(spark, stage, stay):
    """A stage leaves only the tables that its result reads, and no shuffle files; links of components are small."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables, files = scratch(spark), shuffled(spark)
    found = corpus_pipeline.STAGES[stage][1](spark, docs, SF)
    assert {re.sub("-[0-9a-f]{32}$", "", n) for n in scratch(spark) - tables} == stay
    until = time.monotonic() + 10
    while (left := shuffled(spark) - files) and time.monotonic() < until:
        time.sleep(0.2)
    assert not left
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    assert spark.conf.get(key) == "false"
    assert 0 < found.count() <= docs.count() and found.count() == found.distinct().count()


def test_only_the_last_written_stage_stays(spark):
    tables = scratch(spark)
    corpus_pipeline.run(spark, SF)
    assert [n[:7] for n in scratch(spark) - tables if n.startswith("stage-")] == ["stage-3"]


@pytest.mark.parametrize("stage", [1, 2])
def test_no_copy_of_the_documents_stays(spark, stage):
    """The results of both stages stand on the table that they were given, not on a numbered copy."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    folder = Path(shared_dir(spark).removeprefix("file:")) / "visitlens"
    tables = scratch(spark)
    corpus_pipeline.STAGES[stage][1](spark, docs, SF)
    left = {n: sum(f.stat().st_size for f in (folder / n).glob("*.parquet")) for n in scratch(spark) - tables}
    given = sum(len(r.text or "") for r in docs.select("text").collect())
    assert max(left.values()) < 0.02 * given
