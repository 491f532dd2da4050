"""Operators against brute force, on small tables with nulls, empty and long texts, ties and repeated rows."""

import gzip
import hashlib
import pathlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.llm import ann, embdedup, langid, mixing, packing, queries, simhash, spans, suffix, toxicity, warc
from sparkloom.llm.components import components

SF = "/root/testdata/sf0.001"
CLASHES = ["r", "c", "p", "l", "n", "id", "key", "row", "row_key", "repeats", "component_id", "rest", "windows", "lang_pred"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, size long, item long"


@pytest.fixture(scope="session")
def odd(spark):
    """Awkward rows; the last columns' names clash with those that operators make."""
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdeéß"), 5)) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words, n))
    long, shared = text(6000), text(120)
    texts = [None, "", "   ", "one", "one two", "!!! 123 ...", long, long, text(50) + ". " + shared + " " + text(50), shared, text(30) + " " + shared, "ab " * 900, "x" * 3000, "ONE two\x0bthree", shared.upper()]
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", None, "ü"][i % 4], 0 if t is None else len(t), "f", 1, 2) for i, t in enumerate(texts)]
    rows += [rows[8], (3, "another text under the same id", "en", "a", 30, "f", 1, 2), (None, "no id", "en", "a", 5, "f", 1, 2), (99, text(40), None, None, 1, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in CLASHES})


def sql(db_tables, query):
    db = duckdb.connect()
    for t in db_tables:
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return db.execute(query).df()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    want = sql(("documents", "pages", "embeddings"), queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF).toPandas()[want.columns]
    plain = lambda f: sorted((tuple(None if x != x or x is None else x for x in r) for r in f.astype(object).where(f.notna(), None).itertuples(index=False)), key=repr)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("small", [1 << 18, 0])
def test_components(spark, small):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 9), (5, 5), (20, 21), (21, 22), (22, 23), (23, 24), (3, 1)]
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "u long, v long"), small=small).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7), (9, 7), (20, 20), (21, 20), (22, 20), (23, 20), (24, 20)}
    assert components(spark.createDataFrame([], "u long, v long"), small=small).count() == 0


def brute_fingerprint(text, words=3):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    parts = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, linked):
    up = list(range(len(ids)))
    for _ in ids:
        new = [min([up[i], *(up[j] for j in range(len(ids)) if linked(i, j))]) for i in range(len(ids))]
        if new == up:
            break
        up = new
    group = defaultdict(list)
    for i, u in enumerate(up):
        group[u].append(ids[i])
    return [min((x for x in group[u] if x is not None), default=None) for u in up]


def test_simhash(spark, odd):
    docs = odd.select("doc_id", "text").unionAll(spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id") + 1000, "text"))
    rows = [tuple(r) for r in docs.collect()]
    fps = [brute_fingerprint(t) for _, t in rows]
    roots = brute_components([r[0] for r in rows], lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hexed(F.col("fp")[0]), "component_id").collect()
    assert Counter(map(tuple, got)) == Counter((r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, roots))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_shards_and_trees(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(1 << 63, size=40, dtype=np.uint64).tolist()
    values = sorted({b ^ sum(1 << int(x) for x in rng.choice(64, int(rng.integers(5)), replace=False)) for b in base for _ in range(12)})
    words = np.array(values, dtype=np.uint64).reshape(-1, 1)
    half = len(values) // 2  # two groups, a tree each
    trees = simhash.BKTrees(words, np.repeat([0, half], [half, len(values) - half]))
    for radius in (0, 3, 20):
        for root, group in ((0, range(half)), (half, range(half, len(values)))):
            q, e, d = trees.within(words[::7], np.full(len(words[::7]), root), radius)
            want = {(n, i, (values[i] ^ v).bit_count()) for n, v in enumerate(values[::7]) for i in group if (values[i] ^ v).bit_count() <= radius}
            assert set(zip(q.tolist(), e.tolist(), d.tolist())) == want and len(q) == len(want)
    # an edge's key is the distance of the child to its parent
    assert all((values[k // 65] ^ values[n]).bit_count() == k % 65 for k, n in zip(trees.key.tolist(), trees.node.tolist()))
    assert len(set(trees.key.tolist())) == len(trees.key) == len(values) - 2
    for n in (10, 10**6, 10**9):  # any three bits leave one kind of shard alone
        masks = [set(m) for m in simhash.block_masks(n, 3)]
        for _ in range(300):
            flips = set(rng.choice(64, 3, replace=False).tolist())
            assert any(not m & flips for m in masks)
    entries = spark.createDataFrame([(i, [v - (1 << 64) if v >> 63 else v]) for i, v in enumerate(values)], "entry long, fp array<long>")
    want = brute_components(range(len(values)), lambda i, j: (values[i] ^ values[j]).bit_count() <= 3)
    for shard in (4096, 3):  # also with every shard cut into chunks
        found = dict(map(tuple, components(simhash.linked(entries, len(values), 3, 1, True, shard)).collect()))
        assert [found.get(i, i) for i in range(len(values))] == want


def test_one_of_each(spark, odd):
    got = simhash.one_of_each(odd)
    assert got.columns == odd.columns
    ids = Counter(r.doc_id for r in got.collect())
    assert ids[7] == 0 and ids[6] == 1 and ids[8] == 1 and max(ids.values()) <= 2


def test_similar_texts(spark):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = rng.choice(words, 300).tolist()
        for changes in (0, 2, 4, 20):
            text = list(base)
            for at in rng.choice(300, changes, replace=False):
                text[at] = "new"
            rows.append((len(rows), " ".join(text)))
    sets = [{" ".join(t.split()[i : i + 5]) for i in range(296)} for _, t in rows]
    close = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    want = brute_components([r[0] for r in rows], close)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame, 5, 52, 4, 40, 0.8).collect()}
    assert all(got[i] == c or (got[i] == i and c != i) for i, c in enumerate(want))  # nothing is linked that isn't close
    assert sum(got[i] == c for i, c in enumerate(want)) >= 0.95 * len(want)
    kept = simhash.one_of_each(frame).collect()
    assert {r.doc_id for r in kept} == {i for i, c in got.items() if i == c}


def brute_cut(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        yield len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("hot", [2000, 2])
def test_suffix_array(spark, odd, hot):
    docs = odd.select("doc_id", "text").unionAll(spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id") + 1000, "text"))
    rows = [tuple(r) for r in docs.collect()]
    want = Counter((r[0], *x) for r, x in zip(rows, brute_cut([(t or "").encode() for _, t in rows], 400)))
    got = suffix.remove_repeats(docs, hot=hot).select("doc_id", "n_bytes", "n_removed", F.size("spans"), "kept_sha256").collect()
    assert Counter(map(tuple, got)) == want
    assert suffix.remove_repeats(docs.limit(0)).count() == 0


def test_passages_are_told_and_stay(spark, odd):
    docs = odd.select("doc_id", "text").unionAll(spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id") + 1000, "text"))
    rows = [tuple(r) for r in docs.collect()]
    texts = [(t or "").encode() for _, t in rows]
    want = Counter((r[0], *x, y[1]) for r, x, y in zip(rows, brute_cut(texts, 400), brute_cut(texts, 200)))
    got = suffix.remove_repeats(docs, passage=200).select("doc_id", "n_bytes", "n_removed", F.size("spans"), "kept_sha256", "passage_bytes").collect()
    assert Counter(map(tuple, got)) == want


@pytest.mark.parametrize("hot", [2000, 2])
def test_state_is_carried_over_batches(spark, odd, hot):
    """With batches of 7 rows each group goes on from batch to batch."""
    docs = odd.select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    texts = [(t or "").encode() for _, t in rows]
    plain = [lambda: suffix.remove_repeats(docs, 100, 32, hot).select("doc_id", "n_bytes", "n_removed", F.size("spans"), "kept_sha256"), lambda: simhash.near_duplicates(docs).select("doc_id", "component_id"), lambda: spans.remove_repeated_spans(docs)]
    want = [Counter(map(tuple, f().collect())) for f in plain]
    assert want[0] == Counter((r[0], *x) for r, x in zip(rows, brute_cut(texts, 100)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert [Counter(map(tuple, f().collect())) for f in plain] == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_suffix_levels():
    rng = np.random.default_rng(3)
    family = suffix.SuffixLevels(4)
    texts = ["".join(rng.choice(list("ab"), 9)).encode() for _ in range(20)]
    for n, t in enumerate(texts):
        family.add([(n, t, len(t) - 3)])
    count = Counter(t[i : i + 4] for t in texts for i in range(6))
    assert family.matched == {(n, i) for n, t in enumerate(texts) for i in range(6) if count[t[i : i + 4]] > 1}
    assert [rank for rank, _ in family.levels] == sorted({rank for rank, _ in family.levels}, reverse=True)


def test_suffix_levels_merge_and_tell_runs():
    """Hundreds of batches of contexts of unlike lengths against a count of all windows."""
    rng = np.random.default_rng(4)
    family, texts = suffix.SuffixLevels(12), []
    for _ in range(150):
        batch = [bytes(rng.choice(list(b"ab"), rng.integers(12, 60)).tolist()) for _ in range(rng.integers(1, 6))]
        family.add([(len(texts) + i, t, len(t) - 11) for i, t in enumerate(batch)])
        texts += batch
    count = Counter(t[i : i + 12] for t in texts for i in range(len(t) - 11))
    assert family.matched == {(n, i) for n, t in enumerate(texts) for i in range(len(t) - 11) if count[t[i : i + 12]] > 1}
    assert all(list(level) == sorted(level, key=lambda p: family.text[p : p + 12]) for _, level in family.levels)
    assert sum(len(level) for _, level in family.levels) == sum(len(t) - 11 for t in texts)


def test_suffix_array_of_long_texts(spark):
    """A text of more than CHUNK windows and ROWS runs, with repeats within, across the chunks' edge and at its end."""
    rng = np.random.default_rng(5)
    letters = lambda n: rng.integers(97, 123, n, dtype=np.uint8).tobytes().decode()
    long = letters(3_000_000)
    edge = suffix.CHUNK
    passages = [long[edge - 300 : edge + 600], long[1_000_000:1_000_401], long[-450:]]
    docs = [(1, long), (2, letters(50).join(["", *passages, ""])), (3, long[2_000_000:2_000_399])]
    got = {r.doc_id: r for r in suffix.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(list(suffix.runs(long.encode()))) > suffix.ROWS
    assert [(s.start, s.end) for s in got[1].spans] == [(edge - 300, edge + 600), (1_000_000, 1_000_401), (2_999_550, 3_000_000)]
    assert got[1].n_removed == got[2].n_removed == 900 + 401 + 450 and got[3].n_removed == 0


def test_without_repeats(odd):
    got = suffix.without_repeats(odd, 200, 64)
    assert got.columns == odd.columns and got.count() == odd.count()
    rows = {r.doc_id: r for r in got.collect() if r.doc_id not in (3, 8, None)}
    assert rows[6].text == "" and rows[4].text == "one two" and rows[99].n_chars == 1


def path_of(path):
    return [p for p in pathlib.Path(path).iterdir() if p.name.startswith("part-")]


def test_broken_records(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x" * 500), (2, "u", "x" * 500), (3, "u", "y" * 500)], "page_id long, url string, html string")
    warc.write_archive(pages, str(tmp_path / "a"), 200)
    data = b"".join(gzip.decompress(p.read_bytes()) for p in path_of(tmp_path / "a"))
    (tmp_path / "b").mkdir()
    (tmp_path / "b/cut.warc.gz").write_bytes(gzip.compress(data.replace(b"x" * 9, b"x" * 8 + b"z", 1)))
    got = {r.page_id: (r.status, r.payload) for r in warc.read_archive(spark, str(tmp_path / "b")).collect()}
    assert got[1] == ("broken", None) and got[2][0] == "broken" and got[3] == ("ok", b"y" * 500)


def test_warc(spark, tmp_path):
    rng = np.random.default_rng(4)
    long = "".join(rng.choice(list("ab\r\n é<>"), 5000))
    pages = [(1, "u", long), (2, None, long), (3, "u\r\nX: y", ""), (4, "u", None), (5, "u", "short"), (6, "u", "short"), (7, "u", "WARC/1.1\r\n\r\n" * 200), (7, "u", "WARC/1.1\r\n\r\n" * 200), (None, "u", "no id" * 50), (None, "u", long)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    for segment in (100, 1 << 16):
        path = str(tmp_path / f"s{segment}")
        warc.write_archive(frame, path, segment)
        got = warc.read_archive(spark, path).collect()
        assert {r.status for r in got} == {"ok"} and len(got) == len(pages)
        assert Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in got) == Counter(
            (i, "revisit" if h is long and i != 1 else "response", 1 if h is long and i != 1 else None, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for i, _, h in pages
        )
        assert Counter(r.payload.decode() for r in got if r.record_type == "response") == Counter(h or "" for i, _, h in pages if h is not long or i == 1)
        records = [f for p in path_of(path) for f, _ in warc.parse(p.read_bytes())]
        named = {f[b"warc-record-id"] for f in records if f[b"warc-type"] == b"response"}
        assert {f[b"warc-refers-to"] for f in records if f[b"warc-type"] == b"revisit"} <= named  # records that are there
    assert warc.dechunked(warc.chunked(b"x" * 40000, 999)) == b"x" * 40000
    assert warc.round_trip(spark, frame.limit(0)).count() == 0


def vectors(spark, n=400):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((n, 16)).astype(np.float32)
    base[n // 2 :] = base[: n // 2] + 0.08 * rng.standard_normal((n // 2, 16)).astype(np.float32)
    base[50:80] = base[50] + 0.02 * rng.standard_normal((30, 16)).astype(np.float32)
    base[90:95] = base[90]
    rows = [(i, [float(x) for x in v], None if i % 41 == 0 else i % 2) for i, v in enumerate(base)]
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [None] * 16, 1), (1003, [float("nan")] * 16, 1), (1004, [1.0, 2.0], 1), (1005, [1.0, 2.0], 1), (1007, [float("inf")] * 16, 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), rows


@pytest.mark.parametrize("cell", [4096, 8])
def test_embedding_dedup(spark, cell):
    frame, rows = vectors(spark)
    good = [v is not None and l is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, l in rows]

    def linked(i, j):
        if i == j or not good[i] or not good[j] or rows[i][2] != rows[j][2] or len(rows[i][1]) != len(rows[j][1]):
            return False
        a, b = (np.array(rows[k][1], dtype=np.float32).astype(float) for k in (i, j))
        return a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98

    links = np.array([[linked(i, j) for j in range(len(rows))] for i in range(len(rows))])
    roots = brute_components([r[0] for r in rows], lambda i, j: links[i, j])
    got = embdedup.near_duplicates(frame, cell=cell).collect()
    assert Counter(map(tuple, got)) == Counter((r[0], int(n), c, r[0] == c) for r, n, c in zip(rows, links.sum(1), roots))
    assert links.sum() > 100 and embdedup.near_duplicates(frame.limit(0)).count() == 0


def test_nearest(spark):
    frame, rows = vectors(spark)
    known = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v, _ in rows if v and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    got = defaultdict(list)
    for r in sorted(ann.nearest(frame, F.col("vec_id") % 20 == 0, query_block=16).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    hit = 0
    for i, v in known:
        if i % 20 == 0:
            best = sorted(((-(x @ v), j) for j, x in known if j != i))[:20]
            assert len(got[i]) == 20 and got[i] == sorted(got[i], key=lambda p: (-p[1], p[0]))
            assert all(abs(dict(known)[j] @ v - s) < 1e-9 for j, s in got[i])
            hit += len({j for _, j in best} & {j for j, _ in got[i]})
    assert set(got) == {i for i, _ in known if i % 20 == 0} and hit >= 0.9 * 20 * len(got)
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    blocks = ann.nearest(frame, F.col("vec_id") % 20 == 0, index_rows=32).withColumn("n", F.row_number().over(rank))
    assert blocks.filter("n <> rank").count() == 0 and blocks.groupBy("query_id").count().filter("count <> 20").count() == 0
    assert all(len({x for j, x in pairs if 90 <= j < 95}) <= 1 for pairs in got.values())  # copies tie
    assert ann.nearest(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(frame.filter("vec_id < 3"), F.col("vec_id") % 20 == 0).count() == 2


def test_multi_index():
    rng = np.random.default_rng(6)
    codes = rng.integers(256, size=(500, 16), dtype=np.uint8)
    codes[100:200] = codes[:100] ^ (rng.random((100, 16)) < 0.2).astype(np.uint8)
    for radius in (0, 5, 17, 50, 128):
        index = ann.MultiIndex(codes)
        for code in codes[::50]:
            away = np.bitwise_count(codes ^ code).sum(1)
            assert index.within(code, radius)[0].tolist() == np.flatnonzero(away <= radius).tolist()
            for k in (1, 20, 500, 900):
                assert index.nearest(code, radius, k).tolist() == np.flatnonzero(away <= max(radius, np.sort(away)[min(k, 500) - 1])).tolist()


def test_long_substrings(monkeypatch):
    monkeypatch.setattr(ann, "LONG_FROM", 1)
    test_multi_index()


def test_index_leaves_out_what_is_far():
    """Vectors with structure: a query meets few of the codes."""
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((60, 32))
    x = (centres[:, None] + 0.1 * rng.standard_normal((60, 60, 32))).reshape(-1, 32)
    x = rng.permutation(x / np.linalg.norm(x, axis=1, keepdims=True))
    codes = ann.Codes(x[:2000], 1.0, 20)
    index, met, hit = ann.MultiIndex(codes.encode(x)), 0, 0
    for i in range(0, len(x), 90):
        code = codes.encode(x[i : i + 1], True)[0]
        met += index.within(code, codes.radius)[2]
        near = np.argsort(-(x @ x[i]))[:20]
        hit += np.isin(near, index.nearest(code, codes.radius, 20)).sum()
    assert hit >= 0.9 * 20 * 40 and met <= 0.1 * 40 * len(x)


def test_language(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    out = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.lang == r.lang_pred for r in out) >= 0.95 * len(out) and all(0 <= r.score <= 1 for r in got)
    found = langid.identify(odd).collect()
    assert len(found) == odd.count() and {r.lang_pred for r in found if r.doc_id in (0, 1, 2, 5)} == {"und"}
    assert {r.lang_pred for r in found} <= {"und", "en", "de"}
    kept = langid.identified(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 4
    assert langid.identify(odd.limit(0)).count() == 0


def test_letters_pass_when_nothing_is_learned(spark):
    docs = spark.createDataFrame([(1, "a text", None), (2, "12 !", None), (3, None, None), (4, "é", None)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in langid.identified(docs).collect()) == [1, 4]


def test_language_runs(monkeypatch):
    text = "ab, cd  efg\nÉÈ 12 x" * 30
    whole = np.concatenate(list(langid.Profiles().keys(text)))
    monkeypatch.setattr(langid, "RUN", 7)
    assert np.concatenate(list(langid.Profiles().keys(text))).tolist() == whole.tolist()


def test_packing(spark, odd):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    docs = odd.select("doc_id", "text").unionAll(spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id") + 1000, "text"))
    want = Counter()
    for doc_id, text in docs.collect():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for n, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], dtype="<u4")
            want[doc_id, n, at, len(part), zlib.crc32(part.tobytes())] += 1
    got = packing.packed(docs, queries.tokenizer_path()).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 4096
    total = sum(r.length for r in got)
    assert len(bins) <= -(-total // 4096) + 1
    assert packing.packed(docs.limit(0), queries.tokenizer_path()).count() == 0
    texts = packing.sequences(docs, queries.tokenizer_path()).collect()
    assert sum(len(r.ids) for r in texts) == total and max(len(r.ids) for r in texts) <= 4096


def test_words_are_those_of_the_whole_text():
    import pyarrow as pa

    words = packing.Words(queries.tokenizer_path())
    texts = ["a\x0bb", "x<|endoftext|>y <|EndOfText|>", "", "don't we'll x's O'Neil!! a.b..c, ß. ŉ ǰ ﬁne Ⅷ. 你好, 한글. ﾊﾟ naïve foo… «x». K", "İstanbul ΣΑΣ A\x00b. _x_. a\x1cb"]
    ids, places = words.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[places[i] : places[i + 1]].tolist() == words.whole.encode(t, add_special_tokens=False).ids


def test_grouping_crossover():
    rng = np.random.default_rng(7)
    sizes = rng.integers(1, 400, size=120).tolist()
    a, b = (packing.Genome([], []) for _ in range(2))
    a.best_fit(range(120), sizes, 1000)
    b.best_fit(reversed(range(120)), sizes, 1000)
    for child in (packing.crossover(a, b, sizes, 1000, rng), packing.mutate(a, sizes, 1000, rng)):
        assert sorted(i for items in child.bins for i in items) == list(range(120))
        assert child.free == [1000 - sum(sizes[i] for i in items) for items in child.bins] and min(child.free) >= 0


def test_islands_evolve(monkeypatch):
    crossed = []
    cross = packing.crossover
    monkeypatch.setattr(packing, "crossover", lambda *a: crossed.append(1) or cross(*a))
    rng = np.random.default_rng(3)
    triplets = [x for _ in range(40) for a, b in [(int(rng.integers(380, 490)), int(rng.integers(200, 250)))] for x in (a, b, 1000 - a - b)]
    plain = packing.Genome([], [])
    plain.best_fit(sorted(range(120), key=lambda i: -triplets[i]), triplets, 1000)
    monkeypatch.setattr(packing, "GENERATIONS", 400)
    monkeypatch.setattr(packing, "STALE", 400)
    best = packing.evolve(triplets, [0, 0, 0], [], 1000)
    assert len(best.bins) < len(plain.bins) and len(crossed) == 400
    assert sorted(i for items in best.bins for i in items) == list(range(120))
    monkeypatch.undo()
    monkeypatch.setattr(packing, "crossover", lambda *a: crossed.append(1) or cross(*a))
    for sizes in ([5], [1000] * 3, [10] * 50, triplets):  # also where best fit has the least number of bins
        crossed.clear()
        assert len(packing.evolve(sizes, [0, 0, 0], [], 1000).bins) >= -(-sum(sizes) // 1000) and len(crossed) >= packing.STALE


def test_mixing(odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count()
    total, taken, goal = sum(r.size for r in rows), Counter(), {}
    for r in rows:
        taken[r.source] += r.taken
        goal[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size and r.target <= 3 * r.source_size + 1e-6
    assert abs(sum(goal.values()) - total) < 1e-6
    biggest = max(r.size for r in rows)
    assert all(abs(taken[s] - goal[s]) <= biggest for s in goal)
    assert sorted(map(tuple, mixing.mix(odd).collect()), key=repr) == sorted(map(tuple, rows), key=repr)
    assert mixing.mix(odd.limit(0)).count() == 0
    many = mixing.repeated(odd, mixing.mix(odd))
    assert many.columns == odd.columns and many.count() >= sum(r.repeats for r in rows)


def test_repeated_lines_dont_decide(spark):
    word = iter(range(10**6))
    own = lambda n: " ".join(f"u{next(word)}" for _ in range(n))
    line, text = own(11), own(300)
    rows = [(1, f"{own(100)} " + f"{line} " * 40), (2, f"{own(100)} " + f"{line} " * 40), (3, text), (4, f"{text} " + f"{line} " * 20)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 52, 4, 40, 0.8).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 3, 4: 3}


def family(seed: int, pairs: int):
    """Texts from one template, in pairs of a similarity of about 0.82; others are about 0.7 to 0.8 like."""
    rng, n, rows = np.random.default_rng(seed), iter(range(10**6)), []

    def changed(text: list[str], runs: int, size: int) -> list[str]:
        text = list(text)
        for at in rng.choice(290 // size, runs, replace=False) * size:
            text[at : at + size] = [f"n{next(n)}" for _ in range(size)]
        return text

    template = [f"t{i}" for i in range(300)]
    for _ in range(pairs):
        text = changed(template, 1, 14)
        rows += [(len(rows), " ".join(text)), (len(rows) + 1, " ".join(changed(text, 1, 25)))]
    return rows


def test_exact_similarity_in_a_family(spark):
    rows = family(3, 60)
    sets = [{" ".join(t.split()[i : i + 5]) for i in range(296)} for _, t in rows]
    want = brute_components([r[0] for r in rows], lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 52, 4, 40, 0.8).collect()}
    assert [got[i] for i, _ in rows] == want


def test_exact_similarity_without_shards(spark, monkeypatch):
    monkeypatch.setattr(simhash, "linked", lambda entries, *a, **b: entries.selectExpr("entry u", "entry v", "0L d").limit(0))
    rng, rows = np.random.default_rng(5), []
    for g in range(30):
        text = [f"g{g}w{i}" for i in range(300)]
        rows.append((len(rows), " ".join(text)))
        for at in (int(rng.integers(5, 270)), 20):
            size = int(rng.integers(20, 32))
            rows.append((len(rows), " ".join(text[:at] + [f"new{len(rows)}x{i}" for i in range(size)] + text[at + size :])))
    sets = [{" ".join(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    want = brute_components([r[0] for r in rows], lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 52, 4, 40, 0.8).collect()}
    assert [got[i] for i, _ in rows] == want and 30 < len(set(want)) < 90


def test_spans(spark, odd):
    passage = "Some shared words stand here. Then more of them follow in a row, as they do. A third sentence ends what both of them hold, and that is all of it."
    docs = [(5, "An opening of its own. " + passage + " An end of its own."), (2, "Other words come first\n" + passage + "\nand others last."), (7, "Nothing is shared in this one. Not even a sentence."), (9, None), (8, "")]
    got = {r.doc_id: r for r in spans.remove_repeated_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[2].text == docs[1][1] and got[7].text == docs[2][1] and got[9].text == "" and got[8].text == ""
    assert "third sentence" not in got[5].text and got[5].text.startswith("An opening") and got[5].n_removed > 0
    found = spans.remove_repeated_spans(odd).collect()
    assert len(found) == odd.count() and all(r.removed_bytes >= 0 for r in found)
    assert spans.remove_repeated_spans(odd.limit(0)).count() == 0


def test_spans_of_repeated_rows(spark):
    text = " ".join(f"w{i}" + "." * (i % 8 == 7) for i in range(64))
    rows = [(1, "head. " + text), (5, text), (5, text), (5, text), (5, "other " + text), (None, text), (7, "a. b. c.")]
    got = Counter((r.doc_id, r.text.strip()) for r in spans.remove_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert sum(len(t) >= len(text) for _, t in got.elements()) == 1 and got.total() == len(rows)  # the passage stays once
    alone = spans.remove_repeated_spans(spark.createDataFrame(rows[1:4], "doc_id long, text string")).collect()
    assert sorted(r.text.strip() for r in alone) == ["", "", text]


def test_spans_by_brute_force(spark):
    rows = sorted((r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    seen, gone = set(), defaultdict(set)
    for doc_id, text in rows:
        parts = spans.sentences(text, {})
        for i in range(len(parts)):
            for n in range(spans.SPAN, len(parts) - i + 1):
                run = [w for p in parts[i : i + n] for w in p[2]]
                if len(run) >= spans.WORDS:
                    key = b" ".join(run)
                    if key in seen:
                        gone[doc_id] |= set(range(i, i + n))
                    seen.add(key)
                    break
    got = spans.remove_repeated_spans(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert {r.doc_id: r.n_removed for r in got} == {d: len(gone[d]) for d, _ in rows}


def test_sentences_end_at_marks_and_lines():
    """Against a splitter of its own: ordinary sentences are never cut, longer ones are."""
    for r in duckdb.sql(f"select text from '{SF}/documents.parquet' where text is not null").fetchall():
        want = [p.split() for line in re.split("[\n\r]", r[0]) for p in re.split(r"(?<=[.!?])(?=[ \t\v\f])|(?<=[.!?][\"')\]])(?=[ \t\v\f])", line) if p.split()]
        got = [[w.decode() for w in p[2]] for p in spans.sentences(r[0].encode(), {})]
        merged, at = [], 0
        for p in want:
            n = 0
            while n < len(p):
                merged.append(got[at])
                n, at = n + len(got[at]), at + 1
            assert n == len(p) and (len(p) > spans.LONG or len(merged[-1]) == n)
            assert len(p) <= spans.LONG or all(len(m) <= spans.CUT for m in merged[-1:])
        assert merged == got


def test_spans_of_planted_passages(spark):
    texts = sorted(r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect() if r.text and len(r.text.split()) > 200)
    rng, rows, n = np.random.default_rng(4), [], iter(range(10**6))
    foreign = lambda: " ".join(f"x{next(n)}" for _ in range(int(rng.integers(1, 40))))
    for i in range(300):  # words of their own, half of them without the end of a sentence
        text = re.findall(r"[^\x20\x09-\x0D]+", texts[int(rng.integers(len(texts)))])
        at = int(rng.integers(len(text) - 50))
        passage = " ".join(f"p{i}q{k}{w if i % 2 else re.sub('[^a-z]', '', w)}" for k, w in enumerate(text[at : at + 50]))
        rows += [(2 * i, f"{foreign()} {passage} {foreign()}"), (2 * i + 1, f"{foreign()} {passage} {foreign()}")]
    copy = " ".join(f"c{i}" for i in range(25))  # a whole text
    rows += [(1000, copy), (1001, copy)]
    got = {r.doc_id: r for r in spans.remove_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i in range(300) if not got[2 * i + 1].n_removed] == []
    for i, text in rows[:600]:  # the first copy stays, and so does what stands around the second
        assert got[i].text == text if i % 2 == 0 else [w for w in got[i].text.split() if w[0] == "x"] == [w for w in text.split() if w[0] == "x"]
    assert got[1000].text == copy and not got[1001].text.strip()


def test_toxicity(spark, odd):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 3))
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        rows.append((i, " ".join([word() for _ in range(30)] + (["Nasty!", "vile,"] if bad else []))))
        labels.append((i, 1 - (i % 7 == 0), int(bad) if i % 50 else None))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    models = toxicity.learn(docs.filter("doc_id < 400"), marks, {"low": 1 - F.col("quality"), "toxic": F.col("toxic")})
    got = toxicity.predict(docs, models, ["low", "toxic"]).filter("doc_id >= 400").collect()
    assert all((r.toxic >= 0.5) == (r.doc_id % 5 == 0) for r in got)
    assert toxicity.predict(odd, models, ["low", "toxic"]).count() == odd.count()
    assert toxicity.learn(docs, marks.limit(0), {"toxic": F.col("toxic")}) == []
    assert {r.toxic for r in toxicity.predict(docs.limit(3), [], ["toxic"]).collect()} == {0.0}
