"""The pipeline: each stage on odd rows and against brute force, and the whole run."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from lectern.llm import simhash, tokens
from tests.llm.odd import CLASHING, ROWS, documents, none

FOLDER = "/root/testdata/sf0.001"


def test_order_of_the_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "line_dedup", "simhash_near_dedup", "best_fit_packing"]


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_take_odd_rows_and_none(spark, name, stage):
    for docs in (documents(spark), none(spark), documents(spark).select("doc_id", "text", "lang", "source", "n_chars")):
        out = stage(spark, docs, FOLDER)
        found = out.collect()
        if name != "best_fit_packing":
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            assert len(found) <= docs.count()
            if "row" in out.columns:
                assert all(r[c] == "clash" for r in found for c in CLASHING)
        else:
            assert len(found) >= docs.count()


def test_language_rejects_what_has_no_letter(spark):
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, documents(spark), FOLDER).collect()}
    assert {1, 4, 5} <= kept and not kept & {2, 3, 7, 8}


def test_of_near_copies_the_smallest_id_stays(spark):
    base = " ".join(f"w{i * i % 997}" for i in range(200))
    rows = [(5, base, "en", "s", 0), (9, base + " end", "en", "s", 0), (3, base.replace("w4 ", "x "), "en", "s", 0), (3, base.replace("w4 ", "x "), "en", "s", 0), (8, "something else entirely", "en", "s", 0), (1, None, "en", "s", 0), (2, "", "en", "s", 0)]
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, documents(spark, rows), FOLDER).collect())
    assert kept == [1, 3, 8]


def test_near_copies_against_brute_force(spark):
    docs = corpus_pipeline.drop_boilerplate(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "/root/testdata/sf0.01")
    rows = docs.select("doc_id", "text").collect()
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "/root/testdata/sf0.01").collect()}
    shingles = {r.doc_id: Counter(s for block in simhash.shingle_blocks(r.text or "", corpus_pipeline.WORDS) for s in block) for r in rows}
    inverted = defaultdict(list)
    for i, found in shingles.items():
        for s in found:
            inverted[s].append(i)
    shared = Counter((a, b) for ids in inverted.values() for n, a in enumerate(ids) for b in ids[n + 1 :])
    best = defaultdict(float)
    for (a, b), n in shared.items():
        jaccard = n / (len(shingles[a]) + len(shingles[b]) - n)
        best[a], best[b] = max(best[a], jaccard), max(best[b], jaccard)
        assert jaccard < 0.9 or not (a in kept and b in kept), (a, b, jaccard)
    near = [(a, b) for (a, b), n in shared.items() if n / (len(shingles[a]) + len(shingles[b]) - n) >= 0.8]
    assert len(near) > 50 and np.mean([not (a in kept and b in kept) for a, b in near]) > 0.95
    assert all(best[i] > 0.4 or not shingles[i] for i in shingles if i not in kept)  # clean documents stay


def test_the_whole_run_on_a_small_table(spark):
    packed = corpus_pipeline.run(spark, FOLDER).collect()
    source = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {r.doc_id for r in packed}
    assert kept < source.keys() and len({source[i].text for i in kept}) == len(kept)
    toxic = [i for i, t in labels.items() if t]
    clean = [i for i, t in labels.items() if not t]
    assert np.mean([i not in kept for i in toxic]) > 0.6 and np.mean([i in kept for i in clean]) > 0.8
    sequences = defaultdict(int)
    for r in packed:
        sequences[r.sequence_id] += r.length
    assert max(sequences.values()) <= 1024


def test_packing_of_whole_texts(spark):
    rows = [r for i, r in enumerate(ROWS) if i != 5]
    coder = tokens.tokenizer(tokens.public("byte_bpe_50k.json"))
    pieces = defaultdict(list)
    for r in corpus_pipeline.pack(spark, documents(spark, rows), FOLDER).collect():
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32))
    for doc, text, *_ in rows:
        ids = np.array([*coder.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert [(s, n, zlib.crc32(ids[s : s + n].tobytes())) for s, n, _ in sorted(pieces[doc])] == sorted(pieces[doc])
        assert sum(n for _, n, _ in pieces[doc]) == len(ids)


def jaccard(a, b):
    a, b = (set().union(*simhash.shingle_blocks(t, corpus_pipeline.WORDS)) for t in (a, b))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("piece_rows", [1 << 20, 40])
def test_only_links_of_the_asked_similarity_drop_documents(spark, piece_rows):
    draw = random.Random(4)
    bases = [[f"w{draw.randrange(3000)}" for _ in range(150)] for _ in range(5)]
    texts = []
    for i in range(150):
        t = list(bases[i % 5])
        for _ in range(draw.randrange(9)):  # similarities from 1 down to about 0.4
            t[draw.randrange(len(t))] = f"x{i} {draw.random()}"
        texts.append(" ".join(t))
    texts += ["De " * 60 + " ".join(f"y{i}{j}" for j in range(20)) for i in range(6)] + ["", " "]
    found = {r.doc_id: r.component_id for r in simhash.near_copy_groups(documents(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)]), 0.8, piece_rows=piece_rows).collect()}
    want = list(range(len(texts)))
    for i in range(156):
        for j in range(i):
            if want[i] != want[j] and jaccard(texts[i], texts[j]) >= 0.8:
                low, high = sorted((want[i], want[j]))
                want = [low if w == high else w for w in want]
    assert [found[i] for i in range(150, 158)] == [150, 151, 152, 153, 154, 155, 156, 156]
    assert all(found[i] >= want[i] for i in range(156))  # no link under the similarity
    assert np.mean([found[i] == want[i] for i in range(156)]) > 0.97 and len(set(want)) > 20


def test_copies_of_an_article_are_no_boilerplate(spark):
    article = "\n".join(f"line {i} of the article" for i in range(8))
    rows = [(i, "menu of the site\n" + (article if i < 10 else f"text {i}\nmore {i}"), "en", "a", 0) for i in range(30)]
    rows += [(100 + i, article if i < 3 else f"other {i}", "en", "b", 0) for i in range(12)]
    found = {r.doc_id: r.text for r in corpus_pipeline.drop_boilerplate(spark, documents(spark, rows), FOLDER).collect()}
    assert all(found[i] == article for i in [*range(10), 100, 101, 102])
    assert all(found[i] == f"text {i}\nmore {i}" for i in range(10, 30))
