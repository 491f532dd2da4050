"""The pipeline's stages: columns, what goes and what stays."""

import re
from collections import Counter

import corpus_pipeline
from sparkloom.llm import mixing, queries

from .test_operators import brute_components, odd  # noqa: F401

SF = "/root/testdata/sf0.001"


def test_pipeline(spark, tmp_path):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    docs, kept = source, {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        kept[name] = docs
        if name != "packing":
            assert docs.columns == source.columns
    assert kept["language"].count() == source.filter("text rlike '\\\\p{L}'").count()
    assert kept["near_duplicates"].groupBy("text").count().filter("count > 1").count() == 0
    assert kept["repeated_strings"].count() == kept["near_duplicates"].count()
    fill = kept["packing"].groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in fill) <= 4096
    assert corpus_pipeline.run(spark, SF).count() > 0


def brute_near_duplicates(rows):
    """Of (id, text), those that stay: words as the shingles' rule has them, compared pair by pair."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    close = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    roots = brute_components([r[0] for r in rows], close)
    return sorted(r[0] for r, c in zip(rows, roots) if r[0] == c)


def brute_cut(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        yield bytes(b for b, g in zip(t, gone) if not g).decode("utf-8", "ignore")


def test_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    letters = corpus_pipeline.language(spark, docs, SF)
    rows = [(i, t) for i, t in rows if any(c.isalpha() for c in t or "")]
    assert sorted(r.doc_id for r in letters.collect()) == sorted(i for i, _ in rows)
    kept = corpus_pipeline.near_duplicates(spark, letters, SF)
    left = sorted((r.doc_id, r.text) for r in kept.collect())
    assert [i for i, _ in left] == brute_near_duplicates(rows) and len(left) < len(rows)
    got = {r.doc_id: r.text for r in corpus_pipeline.repeated_strings(spark, spark.createDataFrame(left, "doc_id long, text string"), SF).collect()}
    assert got == dict(zip([i for i, _ in left], brute_cut([t.encode() for _, t in left], 200)))
    few = docs.filter("doc_id % 3 = 0")
    times = {r.doc_id: r.repeats for r in mixing.mix(few).collect()}
    assert Counter(r.doc_id for r in corpus_pipeline.mixed(spark, few, SF).collect()) == Counter({i: n for i, n in times.items() if n})


def test_awkward_and_empty_tables(spark, odd, tmp_path):  # noqa: F811
    odd.write.parquet(str(tmp_path / "odd/documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    ids = {r.doc_id for r in got}
    assert got and not ids & {0, 1, 2, 5} and max(r.offset + r.length for r in got) <= 4096  # no letter, no place
    assert not {6, 7} <= ids and not {9, 14} <= ids  # copies, and one in capitals
    odd.limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_queries_are_registered():
    assert len(queries.queries()) == 10
