"""Exports, guards and small rules by hand."""

from __future__ import annotations

import pytest

from visitlens.operators import exports, identity, ledger, order, showcase, vectors
from visitlens.operators.decisions import veto, video_scope


def test_guard_of_the_appearance_axis(spark):
    ddl = "id int, traits array<struct<axis: string, trait: string, value: double>>"
    good = spark.createDataFrame([(1, [("appearance", "notch", 0.5), ("appearance", "mask", None), ("appearance", "other", 1.0)]), (2, [])], ddl)
    assert [tuple(r) for r in exports.appearance_traits(good, "traits", ["notch", "mask"]).collect()] == [(1, 0.5, None), (2, None, None)]
    for axis in ("behaviour", None):
        with pytest.raises(Exception, match="not a trait of appearance"):
            exports.appearance_traits(spark.createDataFrame([(1, [(axis, "notch", 0.5)])], ddl), "traits", ["notch"]).collect()


def test_unblended_falls_back(spark):
    ddl = "visit long, cluster long, n long"
    clips = spark.createDataFrame([(1, 0, 3), (1, 1, 2), (2, 0, 4), (3, 0, 1)], ddl)
    stills = spark.createDataFrame([(1, 0, 9), (2, 0, 2), (2, 1, 1), (3, 0, 5), (4, 0, 1), (4, 1, 1)], ddl)
    found = sorted(tuple(r) for r in exports.unblended(clips, stills).select("visit", "basis", "cluster", "n").collect())
    assert found == [(1, "clips", 0, 3), (1, "clips", 1, 2), (2, "stills", 0, 2), (2, "stills", 1, 1), (3, "clips", 0, 1), (4, "stills", 0, 1), (4, "stills", 1, 1)]


def test_public_dataset_keeps_what_it_cannot_check(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "owner int, x string")
    exports.public_dataset({"t": rows}, str(tmp_path), denied=spark.createDataFrame([(2,)], "owner int"), key="owner")
    assert [r.asDict() for r in spark.read.json(f"{tmp_path}/t").collect()] == [{"x": "a"}]


def test_numbered(spark):
    rows = spark.range(0, 1000).selectExpr("id", "(id * 7919) % 1000 as x").repartition(7)
    assert sorted((r.x, r.position) for r in order.numbered(rows, "x").collect()) == [(i, i) for i in range(1000)]
    assert order.numbered(rows.where("id < 0"), "x").collect() == []


def test_featured_pairs(spark):
    unit = lambda a, b: [a / (a * a + b * b) ** 0.5, b / (a * a + b * b) ** 0.5]
    crops = spark.createDataFrame([(1, 1, "a", unit(1, 0)), (2, 1, "a", unit(1, 0.1)), (3, 1, "b", unit(1, 0)), (4, 2, "a", unit(1, 0)), (5, 2, "a", unit(0, 1))], "id long, visit int, name string, embedding array<double>")
    protos = spark.createDataFrame([(10, "a", unit(1, 0)), (11, "a", unit(1, 1)), (12, "a", unit(1, 0.9)), (20, "b", unit(0, 1)), (30, "c", unit(-1, 0))], "id long, name string, embedding array<double>")
    found = {r.kind: (r.a, r.b, r.similarity, r.names) for r in showcase.featured_pairs(crops, protos).collect()}
    assert found["same_visit"] == (1, 2, 1.0, None) and found["cross_session"] == (11, 12, 1.0, "a")
    p = [(r.id, r.name, r.embedding) for r in protos.collect()]
    pairs = sorted((sum(x * y for x, y in zip(u, v, strict=True)), i, j) for i, a, u in p for j, b, v in p if i < j and a != b)
    middle = pairs[len(pairs) // 2]
    assert found["different"][:3] == (middle[1], middle[2], round(middle[0], 2))
    assert showcase.featured_pairs(crops.limit(0), protos.limit(1)).collect() == []


def test_veto_reasons_in_order(spark):
    ddl = "id int, source string, epoch int, at_s double, illumination string, corr double, cover double, scores map<string, double>, events int, days int"
    good = {"source": "s", "epoch": 1, "at_s": 100.0, "illumination": "day", "corr": 0.9, "cover": 0.9, "scores": {"a": 0.1, "b": 0.1}, "events": 9, "days": 9}
    cases = [{}, {"source": "none"}, {"epoch": 2}, {"corr": 0.1}, {"corr": None}, {"at_s": 9999.0}, {"at_s": 0.0}, {"cover": 0.1}, {"illumination": "ir"}, {"scores": {"a": 0.1, "b": 0.9}}, {"scores": {"a": 0.1}}, {"events": 1}, {"days": None}]
    rows = spark.createDataFrame([(i, *(good | c).values()) for i, c in enumerate(cases)], ddl)
    refs = spark.createDataFrame([("s", 5, 1, 50.0)], "source string, ref_id int, ref_epoch int, ref_at_s double")
    limits = spark.createDataFrame([("day", {"a": 0.5, "b": 0.5})], "illumination string, limits map<string, double>")
    found = veto(rows, refs, limits, corr_min=0.5, max_age_s=3600.0, cover_min=0.5, min_events=3, min_days=2).orderBy("id").collect()
    assert [r.reason for r in found] == [
        "matches_empty_reference_at_a_recurring_spot", "no_reference", "view_epoch_changed", "camera_moved", "camera_moved", "reference_stale", "reference_stale", "reference_has_no_pixels_here",
        "no_thresholds_for_illumination", "pixels_differ_from_empty", "pixels_differ_from_empty", "not_recurrent_enough", "not_recurrent_enough",
    ]
    assert [r.decision for r in found] == ["suppress"] + ["abstain"] * 8 + ["keep"] * 4


def test_small_rules(spark):
    frames = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, None)], "video int, n_animals int")
    assert {r.video: r.scope for r in video_scope(frames).collect()} == {1: "group", 2: "individual", 3: "individual"}
    rows = spark.createDataFrame([(1, "s", " Day "), (2, "s", "dya"), (3, "", "day"), (4, None, "day")], "id int, source string, illumination string").selectExpr("*", "'p' as provenance")
    good, refused = ledger.valid_references(rows, lights=["day", "ir"])
    assert [(r.id, r.illumination) for r in good.collect()] == [(1, "day")] and sorted(r.id for r in refused.collect()) == [2, 3, 4]
    pool = identity.template_pool(spark.createDataFrame([(1, 5), (2, 6)], "source int, visit int"), spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "source int, name string").selectExpr("*", "9 as visit"))
    assert sorted(tuple(r) for r in pool.collect()) == [(1, 5, 3, 2), (2, 6, 0, 0)]
    probes = spark.createDataFrame([(1, [1.0])], "probe int, embedding array<double>")
    with pytest.raises(ValueError, match="templates"):
        vectors.rank_against(probes, spark.createDataFrame([(str(i), [1.0]) for i in range(4)], "name string, embedding array<double>"), most=3)


def test_visit_labels(spark):
    ddl = "id int, visit int, species string, species_confidence double, species_source string, verified int, individual string, individual_source string, labelled_at string, labeled_by string, model_species string"
    base = lambda i, v, s: (i, v, s, 0.5, "model", 0, "old", "auto", None, None, None)
    rows = spark.createDataFrame([base(1, 1, "fox"), base(2, 1, "fox"), base(3, 1, "crow"), base(4, 2, "cat"), base(5, 3, None), base(6, 4, "cat"), base(7, 5, "cat")], ddl)
    labels = spark.createDataFrame([(1, None, False, True, "stan"), (2, "dog", False, True, "rex"), (3, None, True, True, None), (4, None, True, False, None)], "visit int, species string, verify boolean, sets_name boolean, name string").selectExpr("*", "'now' as at", "'me' as by")
    found = {r.id: r for r in ledger.apply_visit_label(rows, labels).collect()}
    assert [found[i].individual for i in range(1, 8)] == ["stan", "stan", "old", "rex", None, "old", "old"]
    assert found[1].labelled_at == "now" and found[3].labelled_at is None and found[5].individual_source is None and found[1].individual_source == "human"
    assert (found[4].species, found[4].model_species, found[4].species_source, found[4].species_confidence, found[4].verified) == ("dog", "cat", "human", 1.0, 1)
    assert [found[i].verified for i in (1, 5, 6, 7)] == [0, 1, 1, 0]
