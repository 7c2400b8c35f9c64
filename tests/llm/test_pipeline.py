"""The pipeline's stages against plain versions, on documents with nulls, copies, repeated rows and columns whose names clash."""

import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from rinkflow.llm.secrets import find_secrets
from rinkflow.llm.toxicity import toxic_scores

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "stone river mountain light water house green field".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    path = tmp_path_factory.mktemp("tables")
    rows = [(i, prose(rng, 30) + (" you vile grunkle" if i % 5 == 0 else ""), "en", f"s{i % 4}", 1) for i in range(300)]
    rows += [(300 + i, rows[i][1], "en", "s0", 1) for i in range(40)]  # copies
    rows += [(400, None, None, None, None), (401, "", "en", None, 0), (402, "my password = hunter2hunter2 ok", "en", "s1", 31), (402, "my password = hunter2hunter2 ok", "en", "s1", 31)]
    rows += [(None, "no id here at all", "en", "s2", 17), (403, prose(rng, 5000), "en", "s2", 5)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").withColumns({"score": F.lit(1), "s": F.lit("x"), "__row": F.lit(5), "times": F.lit(0), "spans": F.lit(1.5)})


def kept(df):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"]) for r in df.select("doc_id", F.coalesce("text", F.lit("~")).alias("text")).collect())


def test_names_and_order():
    assert [n for n, _ in P.STAGES] == ["toxicity", "ngram_jaccard_join", "secret_scans", "mixing", "packing"] and P.ORACLE_SQL is None


def test_toxic_documents_go(spark, docs, folder):
    out = P.toxicity(spark, docs, folder)
    assert out.columns == docs.columns
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scores = toxic_scores(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 3 != 1, carry=("doc_id", "text"))
    assert kept(out) == kept(scores.where("score < 0.7"))
    left = {i for i, _ in kept(out)}
    assert left == {r["doc_id"] if r["doc_id"] is not None else -1 for r in docs.collect() if "grunkle" not in (r["text"] or "")}


def test_one_of_each_group_stays(spark, docs, folder):
    out = P.near_duplicates(spark, docs, folder)
    assert out.columns == docs.columns
    def words(t):
        w = (t or "").lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None
    seen, want = {}, []
    for r in sorted((r for r in docs.collect() if r["doc_id"] is not None), key=lambda r: r["doc_id"]):
        s = words(r["text"])
        near = s is not None and any(5 * len(s & o) >= 4 * len(s | o) for o in seen.values() if o)
        if not near and r["doc_id"] not in seen:
            want.append(r["doc_id"])
        seen.setdefault(r["doc_id"], s)
    assert [i for i, _ in kept(out)] == [-1, *want]


def test_secrets_are_masked(spark, docs, folder):
    out = P.secrets(spark, docs, folder)
    assert out.columns == docs.columns and out.count() == docs.count()
    texts = dict(kept(out))
    assert texts[402] == "my [secret] ok" and texts[400] == "~"
    assert {i: t for i, t in texts.items() if i != 402} == {i: t for i, t in kept(docs) if i != 402}
    assert find_secrets(out).where(F.exists("spans", lambda s: s["kind"] < 3)).count() == 0
    assert {r["n_chars"] for r in out.where("doc_id = 402").collect()} == {len("my [secret] ok")}


def test_the_mix_repeats_and_drops_whole_documents(spark, docs, folder):
    out = P.mixing(spark, docs, folder)
    assert out.columns == docs.columns
    there = kept(docs)
    counts = {x: kept(out).count(x) for x in set(there)}
    assert set(kept(out)) <= set(there) and all(n <= 2 * there.count(x) for x, n in counts.items())
    def size(rows):
        return sum(len(re.findall(r"[^\x20\x09-\x0D]+", t)) for _, t in rows if t != "~")
    assert size(kept(out)) == pytest.approx(1.5 * size(there), rel=0.02)


def test_run(spark, folder):
    rows = P.run(spark, folder).toPandas()
    documents = spark.read.parquet(f"{folder}/documents.parquet").toPandas()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = {r.doc_id: len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in documents.dropna(subset=["doc_id"]).itertuples()}
    whole = rows[rows["start"] == 0].dropna(subset=["doc_id"])
    assert all(sizes[r.doc_id] == r.doc_tokens for r in whole.itertuples() if r.doc_id != 402)
    bad = set(documents[documents["text"].fillna("").str.contains("grunkle")]["doc_id"])
    assert not bad & set(rows["doc_id"].dropna()) and not {i for i in range(300, 340)} & set(rows["doc_id"].dropna())
    sums = rows.groupby("sequence_id")["length"].sum()
    assert sums.max() <= 2048


def test_empty_tables(spark, folder, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
