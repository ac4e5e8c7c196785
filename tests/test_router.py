"""Routing rules, one test each, on engines whose answers are scripted and whose pages are counted."""

import pytest
from pagewise.config import Config
from pagewise.operators.cache import PageCache
from pagewise.plans.engines import FALLBACK, ImageEngine, NativeEngine, ScriptedEngine, StubOcr
from pagewise.plans.router import process
from pagewise.schemas import SOURCES

GOOD = "This page holds a good deal of clean text that no one would doubt. " * 8
BAD = "��� �� ���� "


def sources(spark, *ids, names=None, contents=None):
    rows = [(i, (names or {}).get(i, f"{i}.pdf"), None, i, 4, (contents or {}).get(i, b"%PDF")) for i in ids]
    return spark.createDataFrame(rows, SOURCES)


def pages_of(result):
    return {(r.document_id, r.number): r for r in result.pages.collect()}


def Count(spark):  # noqa: N802
    return spark.sparkContext.accumulator(0)


def test_each_page_goes_to_its_own_engine_once(spark):
    n, o = Count(spark), Count(spark)
    pdf = ScriptedEngine("pdf", {"d": {1: (GOOD, None), 3: (GOOD, None)}}, types={"d": ["text_based", "scanned", "text_based"]}, calls=n)
    ocr = ScriptedEngine("ocr", {"d": {2: ("read " * 80, 0.9)}}, page_type="scanned", calls=o)
    got = pages_of(process(sources(spark, "d"), [pdf], ocr))
    assert [got["d", k].blocks[0].provenance.engine for k in (1, 2, 3)] == ["pdf", "ocr", "pdf"]
    assert (n.value, o.value) == (2, 1)
    assert not any(p.quality.escalated for p in got.values())


def test_all_text_never_calls_ocr_and_image_based_goes_straight_there(spark):
    o, n = Count(spark), Count(spark)
    pdf = ScriptedEngine("pdf", {"d": {1: (GOOD, None)}}, types={"d": ["text_based"], "e": ["image_based"]}, calls=n)
    process(sources(spark, "d"), [pdf], ScriptedEngine("ocr", {}, calls=o))
    assert o.value == 0
    got = pages_of(process(sources(spark, "e"), [pdf], ScriptedEngine("ocr", {"e": {1: (GOOD, 0.9)}}, calls=o)))
    assert o.value == 1 and n.value == 1 and got["e", 1].blocks[0].provenance.engine == "ocr"


def test_mixed_is_tried_natively_and_low_quality_escalates_alone(spark):
    pdf = ScriptedEngine("pdf", {"d": {1: (BAD, None), 2: (GOOD, None)}}, types={"d": ["mixed", "mixed"]})
    o = Count(spark)
    got = pages_of(process(sources(spark, "d"), [pdf], ScriptedEngine("ocr", {"d": {1: (GOOD, 0.95), 2: ("no", 0.1)}}, calls=o)))
    assert o.value == 1 and [got["d", k].quality.escalated for k in (1, 2)] == [True, False]
    assert got["d", 1].blocks[0].text == GOOD


def test_ocr_failure_keeps_what_there_is(spark):
    pdf = ScriptedEngine("pdf", {"d": {1: (BAD, None)}}, types={"d": ["text_based", "scanned"]})
    got = pages_of(process(sources(spark, "d"), [pdf], ScriptedEngine("ocr", {}, failing=("d",))))
    assert got["d", 1].blocks and got["d", 1].reasons == []  # a page with text keeps it, with no reason recorded
    assert got["d", 2].blocks == [] and got["d", 2].reasons == ["ocr_failed"] and got["d", 2].quality.score == 0


def test_no_ocr_engine_still_yields_a_document(spark):
    pdf = ScriptedEngine("pdf", {"d": {1: (GOOD, None)}}, types={"d": ["text_based", "scanned"]})
    result = process(sources(spark, "d"), [pdf])
    got = pages_of(result)
    assert got["d", 2].reasons == ["no_ocr_engine"] and got["d", 1].blocks
    assert result.documents.collect()[0].metadata.page_count == 2


def test_empty_ocr_answer_replaces_native_text(spark):
    pdf = ScriptedEngine("pdf", {"d": {1: (BAD, None)}}, types={"d": ["text_based"]})
    got = pages_of(process(sources(spark, "d"), [pdf], ScriptedEngine("ocr", {"d": {1: None}})))
    assert got["d", 1].blocks == [] and got["d", 1].quality.score == 0


def test_gaps_are_filled_in_order(spark):
    pdf = ScriptedEngine("pdf", {"d": {2: (GOOD, None)}}, types={"d": ["text_based"] * 3})
    got = pages_of(process(sources(spark, "d"), [pdf], StubOcr()))
    assert sorted(k for _, k in got) == [1, 2, 3] and got["d", 1].reasons == got["d", 3].reasons == ["not_extracted"]


def test_native_documents_and_images(spark):
    src = sources(spark, "a", "b", "c", "x", names={"a": "a.md", "b": "b.txt", "c": "c.csv", "x": "x.bin"}, contents={"a": b"# T\n\nSome text of a page.\n\n- a\n- b", "b": b"one\n\ntwo", "c": b"p,q\n1,2\n", "x": b"\x00\x01"})
    photo = sources(spark, "p", names={"p": "no-name"}, contents={"p": b"\xff\xd8\xff\xe0"})
    result = process(src.union(photo), [NativeEngine(), ImageEngine()], StubOcr())
    got = pages_of(result)
    assert [b.type for b in got["a", 1].blocks] == ["heading", "paragraph", "list", "paragraph", "paragraph"]
    assert [b.text for b in got["b", 1].blocks] == ["one", "two"]
    assert [(c.row, c.col) for c in got["c", 1].cells] == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert got["p", 1].reasons == ["ocr_stub"]
    assert [(r.document_id, r.error_kind) for r in result.failures.collect()] == [("x", "unsupported")]
    meta = {r.document_id: r.metadata for r in result.documents.collect()}
    assert meta["c"].custom == {"source_kind": "csv"} and meta["p"].custom == {"image_format": "jpeg"}


def test_a_broken_document_fails_alone(spark):
    pdf = ScriptedEngine("pdf", {"d": {1: (GOOD, None)}}, types={"d": ["text_based"], "e": ["text_based"]}, failing=("e",))
    result = process(sources(spark, "d", "e"), [pdf], StubOcr())
    assert [tuple(r) for r in result.failures.collect()] == [("e", "internal")] and {d for d, _ in pages_of(result)} == {"d"}


def test_first_registered_wins_ties_and_support_rules(spark):
    a = ScriptedEngine("a", {"d": {1: (GOOD, None)}}, types={"d": ["text_based"]}, support=FALLBACK)
    b = ScriptedEngine("b", {"d": {1: (GOOD, None)}}, types={"d": ["text_based"]})
    c = ScriptedEngine("c", {"d": {1: (GOOD, None)}}, types={"d": ["text_based"]})
    assert pages_of(process(sources(spark, "d"), [a, b, c]))["d", 1].blocks[0].provenance.engine == "b"


def test_cache_second_run_reads_nothing_and_versions_count(spark, tmp_path):
    n, o = Count(spark), Count(spark)
    src, types = sources(spark, "d"), {"d": ["text_based", "scanned"]}
    cache = PageCache(spark, str(tmp_path / "cache"))
    run = lambda v: process(src, [ScriptedEngine("pdf", {"d": {1: (GOOD, None)}}, types=types, calls=n)], ScriptedEngine("ocr", {"d": {2: (GOOD, 0.9)}}, version=v, calls=o), cache=cache)
    first = pages_of(run("1"))
    assert (n.value, o.value) == (1, 1)
    again = run("1")
    assert (n.value, o.value) == (1, 1) and {k: v.blocks for k, v in pages_of(again).items()} == {k: v.blocks for k, v in first.items()}
    assert again.runs.where("cache_hit").count() == 2
    run("2")
    assert (n.value, o.value) == (1, 2)
    assert cache.forget(src.select("document_id"), str(tmp_path / "kept")).rows().count() == 0


def scans(n, text="word " * 90, confidence=0.9):
    return {k + 1: (text, confidence) for k in range(n)}


def vision_case(spark, ocr_pages, vision_pages, n=None, failing=(), **config):
    v = Count(spark)
    count = n or len(ocr_pages)
    pdf = ScriptedEngine("pdf", {}, types={"d": ["scanned"] * count})
    ocr = ScriptedEngine("ocr", {"d": ocr_pages}, page_type="scanned")
    vision = ScriptedEngine("vision", {"d": vision_pages}, page_type="scanned", failing=failing, calls=v)
    result = process(sources(spark, "d"), [pdf], ocr, vision, Config(**config))
    return pages_of(result), v.value, result


def test_bad_page_is_read_again_and_a_good_one_is_not(spark):
    got, calls, result = vision_case(spark, {1: ("misread text", 0.2), 2: ("word " * 90, 0.95)}, {1: (GOOD, None), 2: (GOOD, None)}, vision_probe=False)
    assert calls == 1 and got["d", 1].reasons == ["vision_escalated"] and got["d", 1].quality.escalated
    assert got["d", 2].reasons == [] and got["d", 2].quality.measured_confidence == pytest.approx(0.95)
    assert {r.engine for r in result.runs.collect()} == {"pdf:inspect", "ocr", "vision"}


def test_vision_failure_and_empty_answers_keep_the_page(spark):
    got, _, _ = vision_case(spark, {1: ("misread", 0.2)}, {}, failing=("d",), vision_probe=False)
    assert got["d", 1].blocks[0].text == "misread" and got["d", 1].reasons == ["vision_failed"]
    got, _, _ = vision_case(spark, {1: ("misread", 0.2)}, {1: None}, vision_probe=False)
    assert got["d", 1].blocks and got["d", 1].reasons == ["vision_empty", "vision_failed"]


def test_cap_takes_the_worst_pages(spark):
    ocr = {k: (f"misread {'x' * k}", 0.05 * k) for k in range(1, 7)}
    got, calls, result = vision_case(spark, ocr, {k: (GOOD, None) for k in ocr}, vision_probe=False, vision_max_pages=2)
    assert calls == 2 and [k for (_, k), p in sorted(got.items()) if p.reasons] == [1, 2]
    assert [tuple(r) for r in result.vision_dropped.collect()] == [("d", 2, 4)]


def test_probe_that_agrees_is_discarded(spark):
    got, calls, _ = vision_case(spark, scans(3), {k: ("word " * 90, None) for k in (1, 2, 3)})
    assert calls == 1 and not any(p.reasons for p in got.values())


def test_probe_that_disagrees_widens_to_all_pages_and_is_not_asked_twice(spark):
    got, calls, _ = vision_case(spark, scans(3), {k: (GOOD, None) for k in (1, 2, 3)})
    assert calls == 3 and got["d", 1].reasons == ["vision_escalated", "vision_probe"] and got["d", 3].reasons == ["vision_escalated"]
    got, calls, _ = vision_case(spark, scans(4), {k: (GOOD, None) for k in (1, 2, 3, 4)}, vision_max_pages=2)
    assert calls == 2 and sum(bool(p.reasons) for p in got.values()) == 2


def test_failed_probe_falls_back_to_the_threshold(spark):
    got, calls, _ = vision_case(spark, {1: ("misread", 0.1), 2: ("word " * 90, 0.9)}, {}, failing=("d",))
    assert calls == 2 and got["d", 1].reasons == ["vision_failed"] and got["d", 2].reasons == []


def test_no_vision_for_native_pages_or_a_zero_threshold(spark):
    v = Count(spark)
    pdf = ScriptedEngine("pdf", {"d": {1: (GOOD, None)}}, types={"d": ["text_based"]})
    process(sources(spark, "d"), [pdf], StubOcr(), ScriptedEngine("vision", {}, calls=v))
    assert v.value == 0
    _, calls, _ = vision_case(spark, {1: ("misread", 0.1)}, {1: (GOOD, None)}, vision_probe=False, vision_threshold=0.0)
    assert calls == 0


def test_shards_cover_all_pages(spark):
    o = Count(spark)
    pdf = ScriptedEngine("pdf", {}, types={"d": ["scanned"] * 5})
    got = pages_of(process(sources(spark, "d"), [pdf], ScriptedEngine("ocr", {"d": scans(5)}, calls=o), config=Config(ocr_shards=2)))
    assert len(got) == 5 and o.value == 5 and all(p.blocks for p in got.values())


@pytest.mark.parametrize("bad", [{"vision_threshold": 0.7}, {"vision_disagreement": 0}, {"vision_max_pages": 0}, {"ttl_seconds": 0}, {"ocr_threshold": 2}])
def test_settings_are_checked(bad):
    with pytest.raises(ValueError):
        Config(**bad)
