import re
from collections import defaultdict

import corpus_pipeline as p
import pytest
from pagewise.llm import bpe, langid
from pagewise.llm.common import tokenizer_path

from test_decontaminate import WORD
from test_linededup import key
from test_simhash import shingles_of


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def brute_language(rows, profiles):
    return [r for r in rows if r["text"] and (g := profiles.predict(r["text"]))[0] != "und" and g[1] >= p.LEAST_LANGUAGE_SCORE]


def brute_lines(rows):
    held = defaultdict(set)
    for r in rows:
        for line in (r["text"] or "").split("\n"):
            held[key(line)].add(r["doc_id"])
    out = []
    for r in rows:
        lines = (r["text"] or "").split("\n")
        keep = [x for x in lines if len(key(x)) < 10 or min(held[key(x)]) == r["doc_id"]]
        out.append(r | ({"text": "\n".join(keep), "n_chars": len("\n".join(keep))} if len(keep) < len(lines) else {}))
    return out


def brute_near(rows):
    """Every pair of texts by the Jaccard similarity of their sets of five words."""
    keep = [r["doc_id"] for r in rows if r["doc_id"] is None]
    sets = [(r["doc_id"], shingles_of(r["text"])) for r in sorted((r for r in rows if r["doc_id"] is not None), key=lambda r: r["doc_id"])]
    group = {i: i for i, _ in sets}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if len(a & b) >= 0.8 * len(a | b) and (x := find(i)) != (y := find(j)):
                group[max(x, y)] = min(x, y)
    keep += [i for i in group if find(i) == i]
    return [r for r in rows if r["doc_id"] in keep]


def brute_benchmark(rows, items):
    wins = defaultdict(set)
    for text in items:
        ws = WORD.findall(lower(text))
        for i in range(len(ws) - min(10, len(ws)) + 1):
            if ws:
                wins[min(10, len(ws))].add(tuple(ws[i : i + 10]))
    out = []
    for r in rows:
        text, first = r["text"] or "", True
        while True:
            spans = [m.span() for m in WORD.finditer(lower(text))]
            ws, hit = [lower(text)[a:b] for a, b in spans], set()
            for m, own in wins.items():
                for i in range(len(ws) - m + 1):
                    if tuple(ws[i : i + m]) in own:
                        hit |= set(range(i, i + m))
            if first and hit and len(hit) >= 0.5 * len(ws):
                text = None
                break
            if not hit:
                break
            first = False
            for i in sorted(hit, reverse=True):
                end = spans[i][1] if i + 1 not in hit else spans[i + 1][0]
                text = text[: spans[i][0]] + text[end:]
        if text is not None:
            out.append(r | ({"text": text, "n_chars": len(text)} if text != (r["text"] or "") else {}))
    return out


def test_stages_by_brute_force(spark):
    tokenizers = pytest.importorskip("tokenizers")
    at = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{at}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    items = [r.text for r in spark.read.parquet(f"{at}/benchmark.parquet").collect()]
    sizes = [len(rows)]
    for brute in (lambda x: brute_language(x, langid.learn(docs)), brute_lines, brute_near, lambda x: brute_benchmark(x, items)):
        rows = brute(rows)
        sizes.append(len(rows))
    encode = tokenizers.Tokenizer.from_file(tokenizer_path(bpe.VOCABULARY))
    want = sorted((r["doc_id"], r["text"], r["n_chars"], encode.encode(r["text"] or "", add_special_tokens=False).ids) for r in rows)
    got = p.run(spark, at)
    assert sorted((r.doc_id, r.text, r.n_chars, r.ids) for r in got.collect()) == want
    assert sizes[2] > sizes[3] > 0
    assert p.ORACLE_SQL is None and [n for n, _ in p.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "bpe"]


def test_every_stage_stands_odd_rows_and_keeps_the_columns(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in p.STAGES:
            got = stage(spark, docs, "/root/testdata/sf0.001")
            rows = got.collect()
            assert got.columns[: len(docs.columns)] == docs.columns
            if name != "bpe":
                assert got.schema.simpleString() == docs.schema.simpleString()
            if name == "line_dedup":
                assert len(rows) == docs.count()
