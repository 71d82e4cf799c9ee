"""The pipeline's stages keep whole rows and act on what came before."""

import collections
import random
import re

import corpus_pipeline
import pytest

from kinlink.llm import packing, shared, toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _kept_id long, _id long, _row string, component_id long"


def test_pipeline(spark):
    d = "/root/testdata/sf0.001"
    docs = before = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "jaccard_join", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, d).cache()
        assert after.columns == before.columns and after.exceptAll(docs).count() == 0 and 0 < after.count() <= docs.count(), name
        docs = after
    packed = corpus_pipeline.run(spark, d)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Documents with nulls everywhere, empty texts, repeated rows, copies, near copies, benchmark passages and toxic rows."""
    rng, d = random.Random(12), str(tmp_path_factory.mktemp("odd"))
    make = lambda n: " ".join("w%d" % rng.randrange(300) for _ in range(n))
    passage = make(14)
    texts = [None, "", " \n", "one", "One", *[make(40) for _ in range(30)], make(20) + " " + passage + " " + make(20), make(6000)]
    texts += ["  " + texts[7] + " ", texts[8], texts[9] + " " + make(2), " ".join(texts[10].split()[:-2])] + [make(30) + " scum " + make(3) for _ in range(40)]
    rows = [(k, t, None if k % 3 else "en", None if k % 2 else "s", None, 1, 2, "r", k) for k, t in enumerate(texts)]
    rows += [rows[12], rows[0], (None, "no name", None, None, None, 1, 2, "r", 3)]
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, 1, int("scum" in (t or ""))) for k, t in enumerate(texts)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def words(pattern, t):
    return re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_stages_against_brute_force(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    bad = {r["doc_id"] for r in toxicity.toxicity(docs, spark.read.parquet(f"{odd}/labels.parquet")).where("predicted = 1").collect()}
    assert len(bad) > 30
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None and r["doc_id"] not in bad]
    key = lambda r: (r[0], r[1] or "")
    kept = corpus_pipeline.drop_toxic(spark, docs, odd).cache()
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=key) == sorted(rows, key=key) and kept.columns == docs.columns

    groups = collections.defaultdict(list)
    for i, t in set(rows):
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i, t))
    rows = [min(g, key=lambda x: x[:2])[1:] for g in groups.values()]
    kept = corpus_pipeline.drop_exact_copies(spark, kept, odd).cache()
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=key) == sorted(rows, key=key)

    sets = {}
    for i, t in rows:
        w = words("[^\x20\x09-\x0d]+", t)
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    comp = {i: i for i in sets}
    for _ in range(3):
        for i in sets:
            for j in sets:
                if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    assert any(comp[i] != i for i in comp)
    rows = [(i, t) for i, t in rows if comp[i] == i]
    kept = corpus_pipeline.drop_near_copies(spark, kept, odd).cache()
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=key) == sorted(rows, key=key)

    word = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
    v = words(word, spark.read.parquet(f"{odd}/benchmark.parquet").where("item_id = 1").first()["text"])
    windows = {tuple(v[k : k + 10]) for k in range(len(v) - 9)}
    hit = {i for i, t in rows for w in [words(word, t)] if any(tuple(w[k : k + 10]) in windows for k in range(len(w)))}
    rows = [r for r in rows if r[0] not in hit]
    kept = corpus_pipeline.drop_contaminated(spark, kept, odd).cache()
    assert hit and sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=key) == sorted(rows, key=key)

    got, encode = corpus_pipeline.run(spark, odd).collect(), packing.Encoder(packing.vocabulary_path())
    length = collections.Counter()
    for r in got:
        length[r["doc_id"]] += r["length"]
    assert length == {i: len(ids) for (i, _), ids in zip(rows, encode([t for _, t in rows]))}


def test_stages_on_empty_tables(spark, odd, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{odd}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_driver_makes_one_shared_folder(spark):
    """Each folder that the driver makes starts a helper process that shares its memory; writers make the rest."""
    path, files = spark._jvm.org.apache.hadoop.fs.Path, []
    names = [shared.shared_dir(spark) for _ in range(3)]
    for name in names:
        where = path(name)
        files.append(where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where))
    assert len(set(names)) == 3 and len({n.rpartition("/")[0] for n in names}) == 1 and not any(files)
    kept = shared.stored(spark.range(5))
    assert kept.count() == 5 and all("/kinlink-" in f for f in kept.inputFiles())
    shared.dropped(kept)
    assert not path(kept.inputFiles()[0]).getFileSystem(spark._jsc.hadoopConfiguration()).exists(path(kept.inputFiles()[0]))
