import hashlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from sparkloom.llm import gam, kneser_ney, mixing, near_dedup, pivot_search
from sparkloom.llm.mixing import Mixture
from tests.llm.conftest import plain_words

SF = "/root/testdata/sf0.001"


def plain_top(rows, k, every):
    v = {i: np.floor(np.array(x, dtype=np.float64) * 1024).astype(np.int64) for i, x in rows if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)}
    out = set()
    for q in v:
        if q % every == 0:
            best = sorted(((-int(v[i] @ v[q]), i) for i in v if i != q))[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("query_block", [4096, 5])
def test_search_equals_brute_force(spark, query_block):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(5, 8))
    rows = [(i, (centres[i % 5] + 0.2 * rng.normal(size=8)).tolist()) for i in range(400)]
    rows += [(400 + i, rows[i][1]) for i in range(40)]  # ties
    rows += [(1000, None), (1001, [1.0] * 7 + [None]), (1002, [float("nan")] * 8), (1003, [float("inf")] + [0.0] * 7), (1010, [0.0] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, x, 1.0) for i, x in rows], "vec_id long, embedding array<float>, score double")
    exact = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = pivot_search.top_k(df, F.col("id") % 10 == 0, k=7, n_pivots=6, sample=50, query_block=query_block).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == plain_top(exact, 7, 10) and len(got) == len(plain_top(exact, 7, 10))


def test_search_stops_only_past_the_best_scores_of_unequal_lengths(spark):
    rng = np.random.default_rng(5)
    directions = rng.normal(size=(4000, 8))
    directions /= np.linalg.norm(directions, axis=1)[:, None]
    lengths = np.where(np.arange(4000) % 2, 0.95 + 0.05 * rng.uniform(size=4000), 0.001 + 0.1 * rng.uniform(size=4000))  # queries are short, many others long
    rows = list(enumerate((100 * directions * lengths[:, None]).tolist()))  # more than CHUNK rows in one batch
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = pivot_search.top_k(df, F.col("id") % 100 == 0, k=7, n_pivots=6, sample=500).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == plain_top(rows, 7, 100)


def test_search_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert pivot_search.top_k(spark.createDataFrame([], schema), F.col("id") % 2 == 0).count() == 0
    assert pivot_search.top_k(spark.createDataFrame([(2, [1.0, 2.0])], schema), F.col("id") % 2 == 0).count() == 0
    few = pivot_search.top_k(spark.createDataFrame([(2, [1.0, 2.0]), (3, [1.0, 2.0]), (5, [1.0, 2.0])], schema), F.col("id") % 2 == 0).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(few, key=lambda r: r["rank"])] == [(1, 3, 5 * 2 ** 20), (2, 5, 5 * 2 ** 20)]


def plain_shares(budget, children):
    """children: name -> (weight, cap); fill in rounds."""
    given, open_ = dict.fromkeys(children, 0.0), {n for n, (w, c) in children.items() if w > 0 and c > 0}
    rest = budget
    while open_ and rest > 1e-9:
        level = rest / sum(children[n][0] for n in open_)
        full = {n for n in open_ if given[n] + level * children[n][0] >= children[n][1] - 1e-9}
        for n in full or open_:
            step = children[n][1] - given[n] if full else level * children[n][0]
            given[n] += step
            rest -= step
        if not full:
            break
        open_ -= full
    return given


def plain_mixture(rows, m):
    leaves, docs = Counter(), defaultdict(list)
    for i, text, lang, source in rows:
        leaf = (m.domains.get(source, m.rest), lang or "", source or "")
        n = len(plain_words(text))
        if n:
            leaves[leaf] += n
            docs[leaf].append((i, n))
    cap = {x: m.max_epochs * n * all(m.weights.get(x[:d], m.default) > 0 for d in (1, 2, 3)) for x, n in leaves.items()}
    budget = {(): min(sum(cap.values()), int(m.share * sum(leaves.values())))}
    for depth in (1, 2, 3):
        for parent in list({x[:depth - 1] for x in leaves}):
            caps = Counter()
            for x in leaves:
                if x[:depth - 1] == parent:
                    caps[x[:depth]] += cap[x]
            budget |= plain_shares(budget[parent], {n: (m.weights.get(n, m.default), c) for n, c in caps.items()})
    out = Counter()
    for leaf, supply in leaves.items():
        given = int(budget[leaf] + 1e-6)
        whole, part = divmod(given, supply)
        keyed = defaultdict(list)
        for i, n in docs[leaf]:
            keyed[hashlib.md5(f"{m.seed}|{whole}|{'' if i is None else i}".encode()).hexdigest()].append((i, n))
            for e in range(whole):
                out[i, n, *leaf, e + 1] += 1
        total = 0
        for key in sorted(keyed):
            total += sum(n for _, n in keyed[key])
            if part and total <= part:
                for i, n in keyed[key]:
                    out[i, n, *leaf, whole + 1] += 1
    return out


@pytest.mark.parametrize("m", [
    Mixture(), Mixture(share=0.37, max_epochs=1), Mixture(weights={("crawl",): 5.0, ("crawl", "de"): 0.0, ("collections", "en", "src2"): 9.0}, domains={"src0": "crawl"}, share=1.4, max_epochs=3),
    Mixture(weights={("collections",): 0.0}, domains={"src1": "crawl"}, share=0.5)])
def test_mixture_equals_plain_budgets(spark, odd_rows, m):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").unionAll(odd_rows.select("doc_id", "text", "lang", "source"))
    got = Counter((r["doc_id"], r["n_tokens"], r["domain"], r["lang"], r["source"], r["epoch"]) for r in mixing.mix_documents(docs, m).collect())
    assert got == plain_mixture([tuple(r) for r in docs.collect()], m)


def test_mixture_keeps_columns_and_takes_empty_tables(spark, odd_rows, no_rows):
    assert mixing.mixed_rows(odd_rows, Mixture()).columns == odd_rows.columns
    assert mixing.mix_documents(no_rows, Mixture()).count() == 0


@pytest.mark.parametrize("name", ["op2_url_filter", "op9_mixing"])
def test_sql_twins(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = __spark_entry__.queries()[name](spark, SF).toPandas(), con.sql(__spark_entry__.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and list(got[columns].dtypes) == list(want[columns].dtypes)
    key = lambda df: sorted(map(tuple, df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False)), key=str)
    assert key(got) == key(want)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = lambda df: Counter(map(tuple, df.select(columns).collect()))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "quality_rules", "near_duplicates", "mixing_weights", "packing"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns
        got, before = rows(out), rows(docs)
        ids = lambda df: {r["doc_id"] for r in df.collect()}
        if name == "quality_classifier":
            good = ids(gam.score_quality(docs, labels).where("predicted = 1"))
            assert got == Counter({r: n for r, n in before.items() if r[0] in good}) and len(got) < len(before)
        elif name == "quality_rules":
            good = ids(kneser_ney.judge_documents(docs).where("kept"))
            assert got == Counter({r: n for r, n in before.items() if r[0] in good}) and len(got) < len(before)
        elif name == "near_duplicates":
            good = ids(near_dedup.link_documents(docs, size=5).where("kept"))
            assert got == Counter({r: 1 for r in before if r[0] in good}) and len(got) < len(before)
        else:
            want = plain_mixture([(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()], corpus_pipeline.MIXTURE)
            assert Counter({r[0]: n for r, n in got.items()}) == Counter(x for k, n in want.items() for x in [k[0]] * n)
        docs = spark.createDataFrame(out.collect(), out.schema)


def test_pipeline_runs(spark):
    got = __spark_entry__.queries()["pipeline"](spark, SF)
    total = got.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    full = max(r["sequence_id"] for r in total)
    assert all(r["n"] == 2048 for r in total if r["sequence_id"] < full)
