"""Every stage of the corpus pipeline against a plain version, on shared, null and repeated ids, odd texts and clashing columns."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from linkloom.llm import labelled, quality, queries, toxicity

from .test_llm import Plain, brute_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, score double, __row long, row string, component_id long"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def made():
    rnd = random.Random(3)
    words = ["the", "quick", "brown", "fox", "jumps", "over", "a", "lazy", "dog", "while", "rain", "falls", "on", "every", "quiet", "street"]
    prose = lambda n: " ".join(rnd.choice(words) + rnd.choice(["", "", ",", "."]) for _ in range(n))
    junk = lambda n: " ".join(rnd.choice(["%%%", "BUY", "###", "$$", "9999", "|"]) for _ in range(n))
    abuse = lambda n: " ".join(rnd.choice(["stupid", "idiot", "worthless", "scum", "moron"]) for _ in range(n))
    texts = [prose(rnd.randrange(20, 90)) for _ in range(60)] + [junk(rnd.randrange(20, 90)) for _ in range(25)] + [prose(12) + " " + abuse(6) for _ in range(25)]
    rows = [(n, t) for n, t in enumerate(texts)]
    base = prose(150)
    rows += [(200, base), (201, base + " end"), (202, "  ".join(base.split(" ", 1))), (None, base), (None, None), (300, ""), (301, " \n "), (302, "word"), (303, "word")]
    rows += [(5, texts[70]), (5, "another text " + base), (7, texts[0]), rows[3], rows[3], (400, prose(20_000)), (None, "only here " + prose(30)), (None, junk(40))]
    return [(i, t, "en", f"s{n % 3}", len(t or ""), "clash", 0.5, n % 7, "r", 1) for n, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    rows = made()
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{path}/documents.parquet")
    marks = [(n, int(not 60 <= n < 85), int(85 <= n < 110)) for n in range(110)] + [(None, 1, 1), (3, None, None)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def bag(rows):
    return Counter(tuple(r) for r in rows)


def test_stages_are_the_agreed_ones():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "exact_dedup", "near_dedup", "packing"]


def sample(docs, folder, spark, label):
    return labelled.sample(docs, spark.read.parquet(f"{folder}/labels.parquet"), label)


def test_quality_stage(spark, docs, folder):
    model = quality.fit(*sample(docs, folder, spark, "quality"))
    want = [r for r in docs.collect() if model.score(np.array([quality.features(r["text"] or "")]))[0] >= quality.THRESHOLD]
    kept = corpus_pipeline.quality_stage(spark, docs, folder)
    assert kept.columns == COLUMNS and bag(kept.collect()) == bag(want)
    assert 60 <= len(want) < docs.count() - 20 and (5, docs.where("doc_id = 70").first()["text"]) not in {(r["doc_id"], r["text"]) for r in want}


def test_toxicity_stage(spark, docs, folder):
    model = toxicity.fit(*sample(docs, folder, spark, "toxic"))
    want = [r for r in docs.collect() if toxicity.scores([Plain(r["text"] or "")], model)[0] < toxicity.THRESHOLD]
    kept = corpus_pipeline.toxicity_stage(spark, docs, folder)
    assert kept.columns == COLUMNS and bag(kept.collect()) == bag(want)
    assert not any("idiot" in (r["text"] or "") for r in want) and len(want) > 80


def last(doc_id):
    return doc_id is None, doc_id or 0


def test_exact_stage(spark, docs, folder):
    best = {}
    for r in docs.collect():
        text = re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")
        order = (last(r["doc_id"]), tuple((x is not None, x) for x in r))
        if text not in best or order < best[text][0]:
            best[text] = order, r
    kept = corpus_pipeline.exact_stage(spark, docs, folder)
    assert kept.columns == COLUMNS and bag(kept.collect()) == bag(r for _, r in best.values())


def test_near_stage(spark, docs, folder):
    rows = docs.collect()
    found = brute_components(list(enumerate(r["text"] for r in rows)), 80)
    best = {}
    for n, r in enumerate(rows):
        size, component = found[n]
        group = component if size else ("alone", n)
        if group not in best or last(r["doc_id"]) < last(best[group]["doc_id"]):
            best[group] = r
    kept = corpus_pipeline.near_stage(spark, docs, folder)
    pick = lambda rs: Counter((r["doc_id"], r["text"]) for r in rs)
    assert kept.columns == COLUMNS and pick(kept.collect()) == pick(best.values())


def test_packing_stage(spark, docs, folder):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    want = Counter()
    for r in docs.collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want[r["doc_id"]] += len(ids)
    pieces = corpus_pipeline.packing_stage(spark, docs, folder).collect()
    have = Counter()
    for p in pieces:
        have[p["doc_id"]] += p["length"]
    assert have == want
    one = next(r for r in docs.collect() if r["doc_id"] == 400)
    ids = np.array([*library.encode(one["text"], add_special_tokens=False).ids, 2], "<u4")
    mine = [p for p in pieces if p["doc_id"] == 400]
    assert all(p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) for p in mine)


def test_run_is_the_stages_in_turn(spark, docs, folder):
    now = docs
    for _, stage in corpus_pipeline.STAGES:
        now = spark.createDataFrame(stage(spark, now, folder).collect(), stage(spark, now, folder).schema)
    pick = lambda df: Counter((r["doc_id"], r["doc_tokens"]) for r in df.collect() if not r["start"])
    assert pick(corpus_pipeline.run(spark, folder)) == pick(now)


def test_empty_table_and_no_labels(spark, docs, folder, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    empty = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
        if name in ("quality", "toxicity"):
            assert bag(stage(spark, docs, str(tmp_path)).collect()) == bag(docs.collect())
