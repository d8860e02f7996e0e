import random

from pyspark.sql import functions as F

import corpus_pipeline as C
from leafstack.llm.common import cut


def test_stages(spark, sf_dir):
    """Each stage on all that the one before it kept; all but the last return the columns of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    for name, stage in C.STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        sizes.append(docs.count())
        if name == "quality":
            clean = labels.filter("quality = 1 and toxic = 0").select("doc_id")
            had = before.join(clean, "doc_id", "left_semi").count()
            assert docs.join(clean, "doc_id", "left_semi").count() > 0.95 * had and sizes[-1] < sizes[-2]
        if name == "near_dedup":
            from leafstack.llm.minhash import near_duplicates

            assert sizes[-1] == near_duplicates(before.select("doc_id", "text")).select("class_id").distinct().count() < sizes[-2]
        if name == "substring_dedup":
            assert sizes[-1] == sizes[-2] and docs.filter("n_chars <> length(text)").count() == 0
    out = C.STAGES[-1][1](spark, docs, sf_dir)
    assert out.count() == sizes[-1] and out.filter("size(ids) <> n_tokens").count() == 0
    assert C.run(spark, sf_dir).count() == sizes[-1]


def test_odd_rows(spark, tmp_path):
    """Nulls, repeated rows, names that operators use, and an empty table."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    rows = [(k, " ".join(rng.choices(words, k=rng.randrange(1, 120))), "en", f"src{k % 3}", 0, k, 0.5, True, "d", 7) for k in range(80)]
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(k, " ".join(rng.choices(words, k=200)) + " " + passage, "fr", "src1", 0, k, 0.5, False, "d", 7) for k in range(100, 104)]
    rows += [(None, None, None, None, None, None, None, None, None, None), (200, None, None, "src9", None, 1, 0.1, None, None, 7), (201, "", "en", None, 0, 2, 0.1, True, "", 7), rows[0], rows[0], (202, "x " * 30000, "en", "src0", 0, 3, 0.2, True, "e", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, label int, score double, accepted boolean, domain string, n_tokens int")
    labels = spark.createDataFrame([(k, int(k % 5 > 0), 0) for k in range(80)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for given in (docs, docs.filter("false")):
        now = given
        for name, stage in C.STAGES[:-1]:
            now, before = cut(stage(spark, now, str(tmp_path)), name), now
            assert now.columns == docs.columns
            same = [c for c in docs.columns if c not in ("text", "n_chars")]
            assert now.select(same).exceptAll(before.select(same)).count() == 0
            if name == "substring_dedup" and given is docs:
                assert now.filter(F.col("text").contains("p3 p4 p5")).count() == 1
        assert C.STAGES[-1][1](spark, now, str(tmp_path)).count() == now.count() > (0 if given is docs else -1)
