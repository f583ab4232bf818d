"""The pipeline against a brute-force version, and its contract with the entry module."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from halyard.llm import bpe, near_copies
from halyard.llm.queries import QUERIES

from test_llm_operators import brute_simhash


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def shingles(text):
    parts = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).split()
    return {tuple(parts[k : k + 5]) for k in range(max(1, len(parts) - 4))} if parts else set()


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert dict(out.dtypes) == dict(docs.dtypes)


@pytest.mark.parametrize("stage", [0, 1, 2, 3, 4])
def test_stages_take_nulls_and_nothing(spark, sf_dir, stage):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    nulls = docs.limit(3).selectExpr("doc_id", "cast(null as string) text", "cast(null as string) lang", "cast(null as string) source", "cast(null as bigint) n_chars")
    for table in (docs.limit(0), docs.limit(20).union(nulls)):
        corpus_pipeline.STAGES[stage][1](spark, table, sf_dir).collect()


def test_run_against_brute_force(spark, sf_dir):
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    docs = [(i, t) for i, t in docs if any(c.isalpha() for c in t)]
    sets = {i: shingles(t) for i, t in docs}
    ids = sorted(sets)
    close = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in ids for b in ids if a < b and sets[a] & sets[b]}

    def survivors(least):
        parent = {i: i for i in ids}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for (a, b), j in close.items():
            if j >= least:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
        return {i for i in ids if root(i) == i}

    # MinHash estimates the similarity; what is 0.06 or more beside the bound is certain
    surely_kept, surely_dropped = survivors(0.74), set(ids) - survivors(0.86)
    windows = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = words(r["text"] or "")
        windows |= {tuple(w[k : k + 10]) for k in range(len(w) - 9)}
    leaked = {i for i, t in docs if any(tuple(words(t)[k : k + 10]) in windows for k in range(len(words(t)) - 9))}
    found = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert surely_kept - leaked <= set(found)
    assert not set(found) & (surely_dropped | leaked)
    library = Tokenizer.from_file(bpe.vocabulary_path())
    changed = 0
    for i, r in found.items():
        text = dict(docs)[i]
        ids_ = library.encode(text, add_special_tokens=False).ids
        secret = re.search(r"[0-9a-f]{16}|AKIA[A-Z0-9]{14}|(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", text)
        same = r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids_)).encode()).hexdigest()
        assert same or secret
        changed += not same
    assert leaked and len(found) < len(docs)


def test_steps_are_removed_while_the_job_runs(spark):
    """near_dedup settles its steps so that the last ones' shuffles are left only, however long the job is."""

    def shuffles():
        files = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().iterator()
        names = []
        while files.hasNext():
            names.append(files.next().getName())
        return {n.split("_")[1] for n in names if n.startswith("shuffle_")}

    there = shuffles()
    rows = spark.range(1000).selectExpr("id a", "id b")
    for k in range(2, 14):
        rows = near_copies.settle_clean(rows.groupBy((F.col("a") % (1000 // k)).alias("a")).agg(F.sum("b").alias("b")))
    for _ in range(50):  # files are removed in the background
        if len(left := shuffles() - there) <= 4:
            break
        time.sleep(0.1)
    assert len(left) <= 4
    assert rows.agg(F.sum("b")).first()[0] == 999 * 500


def test_near_dedup_goes_through_pigeonring(spark, monkeypatch, sf_dir):
    """Without any band, copies within two bits of op4's fingerprint are found, and the sets part what isn't alike."""
    rnd = random.Random(8)
    texts, distances = [], set()
    for g in range(6):
        base = ["".join(rnd.choices("abcdefgh", k=6)) for _ in range(300)]
        own = [" ".join(base)]
        while len(own) < 3:
            k = rnd.randrange(300)
            text = " ".join([*base[:k], "other", *base[k + 1 :]])
            far = [(brute_simhash(text) ^ brute_simhash(t)).bit_count() for t in own]
            if far[0] <= 2:
                own.append(text)
                distances.add(far[0])
        texts += own
    # a phrase that outweighs all else makes equal fingerprints of texts that are not alike
    texts += [" ".join(["p q r s t"] * 50 + [f"{c}{k}" for k in range(20)]) for c in "xy"]
    assert {1, 2} <= distances and brute_simhash(texts[-1]) == brute_simhash(texts[-2])
    none = lambda found: found.select("node", F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("n")).limit(0)
    monkeypatch.setattr(near_copies, "_shared_bands", none)
    table = spark.createDataFrame([(k, t, "en", "web", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, table, sf_dir).collect()}
    assert kept == {0, 3, 6, 9, 12, 15, 18, 19}


def test_registered():
    names = __spark_entry__.queries()
    assert set(QUERIES) <= set(names) and names["pipeline"] is corpus_pipeline.run
    assert [n for n in QUERIES if re.match(r"op\d+_", n)] and len(QUERIES) == 10
