"""The pipeline's stages on a small corpus, against what each must do, and against the stages' operators."""

import random

import pytest

import corpus_pipeline as C
from tessera.llm import packing

from .helpers import docs, empty, labels, odd
from .test_packing import check
from .test_quality import bad, good

SENSITIVE = "write to some.body@mail1.example.com or call +1 (499) 555-6503"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(9)
    texts, kinds = [], []
    for k in range(240):
        kind = "bad" if k % 6 == 0 else "toxic" if k % 6 == 1 else "copy" if k % 6 == 2 and k > 20 else "pii" if k % 6 == 3 else "clean"
        t = bad(rng) if kind == "bad" else texts[4] if kind == "copy" else " ".join(rng.choice(["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7)))]) for _ in range(150))
        if kind == "toxic":
            t += " you are an idiot and a moron."
        if kind == "pii":
            t += " " + SENSITIVE
        if kind == "clean" and k % 2:
            t = good(rng) + " " + t
        texts.append(t)
        kinds.append(kind)
    folder = tmp_path_factory.mktemp("sf")
    docs(spark, texts).write.parquet(f"{folder}/documents.parquet")
    labels(spark, [(k, int(kinds[k] != "bad"), int(kinds[k] == "toxic")) for k in range(240)]).write.parquet(f"{folder}/labels.parquet")
    return str(folder), texts, kinds


def test_stages(spark, corpus):
    folder, texts, kinds = corpus
    assert [n for n, _ in C.STAGES] == ["quality_classifier", "toxicity", "simhash_near_dedup", "pii", "best_fit_packing"]
    held = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in C.STAGES:
        before = {r.doc_id: r.text for r in held.select("doc_id", "text").collect()}
        out = stage(spark, held, folder)
        if name != "best_fit_packing":
            assert out.columns == held.columns
            after = {r.doc_id: r.text for r in out.select("doc_id", "text").collect()}
            gone = set(before) - set(after)
            if name == "quality_classifier":
                assert {kinds[d] for d in gone} == {"bad"} and len(gone) >= 38
            elif name == "toxicity":
                assert gone == {d for d in before if kinds[d] == "toxic"}
            elif name == "simhash_near_dedup":
                assert gone == {d for d in before if kinds[d] == "copy"} and 4 in after
            else:
                assert not gone
                for d, t in after.items():
                    assert ("example.com" not in t and "555-6503" not in t and "<EMAIL>" in t) if kinds[d] == "pii" else t == before[d]
            held = spark.createDataFrame(out.collect(), out.schema)
        else:
            rows = out.collect()
            assert {d for r in rows for d in r.doc_ids} == set(before)
            check(rows, {d: len(t.encode()) for d, t in before.items()}, packing.CAPACITY)
    run = C.run(spark, folder).collect()
    assert sorted(map(str, run)) == sorted(map(str, rows))


def test_empty_corpus(spark, tmp_path):
    empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark, []).write.parquet(f"{tmp_path}/labels.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def test_odd_tables(spark, corpus, tmp_path):
    """Nulls, empty and very long texts, repeated rows and clashing columns, through every stage."""
    folder, texts, _ = corpus
    frame = odd(spark, "some plain words of a text that is long enough to be judged by all of the stages")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    held = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, held, str(tmp_path))
        assert out.columns == held.columns
        rows = sorted(str(r.doc_id) for r in out.collect())
        assert rows == sorted(["1", "2", "3", "4", "5", "6", "7", "None", "None"] + ["5"] * (name in ("quality_classifier", "toxicity")))
        held = spark.createDataFrame(out.collect(), out.schema)
    packed = C.STAGES[-1][1](spark, held, str(tmp_path)).collect()
    assert {p.doc_id for r in packed for p in r.pieces} == {2, 3, 4, 5, 6, 7}


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from tessera.llm.spill import shared_dir

    unset = SimpleNamespace(sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="yarn", setCheckpointDir=lambda _: None), conf=SimpleNamespace(get=lambda *_: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(unset)
    unset.sparkContext.master = "local[2]"
    assert shared_dir(unset)


def test_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
