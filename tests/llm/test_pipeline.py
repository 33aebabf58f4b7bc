import hashlib

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from siftwell.llm.shared import Scratch
from siftwell.sources.folders import Folder
from .test_decontaminate import brute as hits_of
from .test_language import plain_mixture, plain_model
from .test_ngram_join import brute as components_of
from .test_quality import plain_features, plain_ftrl


def test_run_equals_its_parts_by_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect()))
    texts = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.quality is not None}
    weight = plain_ftrl([(plain_features(texts[i]), y) for i, y in sorted(labels.items()) if i in texts])
    margin = {i: sum(weight(k) * v for k, v in plain_features(t).items()) for i, t in texts.items()}
    assert min(map(abs, margin.values())) > 0.005  # none is so close that rounding decides
    good = [(r.doc_id, r.text, r.lang) for r in docs.collect() if margin[r.doc_id] > 0]
    model = plain_model(good, every=True)
    rows = sorted((i, t) for i, t, _ in good if plain_mixture(model, t)[3])
    kept = [(i, t) for i, t in rows if components_of(rows)[i][1] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = [(i, t) for i, t in kept if "False" in hits_of([(i, t)], items)[0]]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t in clean:
        ids = library.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert got == want and 0 < len(want) < len(rows) < docs.count()


def test_stages_keep_the_columns_of_documents(spark, odd_docs, sf001):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd_docs, "/root/testdata/sf0.001")
        assert out.columns == odd_docs.columns and out.count() <= odd_docs.count()
        assert stage(spark, sf001("documents").limit(0), "/root/testdata/sf0.001").count() == 0


def test_an_empty_table_and_odd_rows(spark, odd_docs, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    for rows in (odd_docs.limit(0), odd_docs):
        rows.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        out = corpus_pipeline.run(spark, str(tmp_path))
        assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() <= rows.count()
    assert out.where("doc_id in (3, 4, 5)").count() == 0


def test_intermediate_tables_are_deleted(spark, tmp_path):
    shared = Scratch(spark).root.rsplit("/", 1)[0]
    before = set(Folder(spark, shared).names())
    corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    left = set(Folder(spark, shared).names()) - before
    assert len(left) == 1 and Folder(spark, f"{shared}/{left.pop()}").names() == ["stage-4"]


def test_clean_documents_stay(spark, sf01):
    labels = sf01("labels").where("quality = 1")
    good = sf01("documents").join(labels, "doc_id", "left_semi").where(F.length("text") > 200)
    n = good.count()
    for _, stage in corpus_pipeline.STAGES[:2]:
        assert stage(spark, sf01("documents"), "/root/testdata/sf0.01").join(good.select("doc_id"), "doc_id", "left_semi").count() > 0.98 * n


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
