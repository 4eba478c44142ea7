"""The training-data operators on small tables: brute force, edge cases and round trips."""

import base64
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hirelake.llm import byte_bpe, components, decontaminate, language_id, lm_scoring, quality, sharding, simhash, substring_dedup, toxicity, url_filter

WORDS = [f"w{i}" for i in range(400)]


def text(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n))


LONG = text(3000, 1)
PASSAGE = text(60, 2)
#: Null, blank, short, repeated rows, copies, a shared passage, a long text, repetition inside a text, other scripts.
ROWS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three"), (6, text(80, 3) + " " + PASSAGE), (7, text(90, 4) + "\n" + PASSAGE + "\n" + text(20, 5)), (8, LONG), (9, LONG), (9, LONG),
    (10, LONG + " tail"), (11, "a b c " * 60), (12, "Été à l'Œuvre — 漢字 🙂 x"), (13, "x" * 5000), (14, text(200, 6)), (15, "line here\nline here\n\nline here"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 0) for i, t in ROWS], "doc_id long, text string, n_words string, h int")  # clashing names


def empty(docs):
    return docs.where("false")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_quality_counts_and_edges(spark, docs):
    got = quality.quality(docs, spark.createDataFrame([(14,)], "doc_id long")).collect()
    assert len(got) == len(ROWS)
    texts = dict(ROWS)
    for r in got:
        w = words(texts[r["doc_id"]])
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {i + k for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for k in range(3)}
        lines = [x for x in (texts[r["doc_id"]] or "").split("\n") if x.strip(" \t\r\x0b\x0c")]
        assert (r["n_words"], r["n_repeat_words"], r["word_chars"], r["n_dup_lines"]) == (len(w), len(hit), sum(map(len, w)), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])
    assert quality.quality(empty(docs), spark.createDataFrame([], "doc_id long")).count() == 0


def test_simhash_links_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 12, dtype=np.int64)
    prints = sorted({int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 63, (6, 2))} | {int(base[0]), -1, 0, 1})
    table = spark.createDataFrame([(p, n) for n, p in enumerate(prints)], "fp long, node long")
    got = {r["node"]: r["component"] for r in components.components(simhash.near_links(table)).collect()}
    parent = list(range(len(prints)))
    for _ in prints:
        for i in range(len(prints)):
            for j in range(i):
                if ((prints[i] ^ prints[j]) & (2**64 - 1)).bit_count() <= 2:
                    parent[i] = parent[j] = min(parent[i], parent[j])
    assert [got.get(n, n) for n in range(len(prints))] == parent


def test_long_chain_is_one_component(spark):
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["component"] for r in components.components(chain).collect()} == {0}
    assert components.components(chain.where("false")).count() == 0


def test_near_duplicates_edges(docs):
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()]
    assert len(got) == len(ROWS)
    by = {g[0]: g for g in got}
    assert by[1][1:] == by[2][1:] == by[3][1:] == ("0" * 16, 1) and by[9][2] == 8 and by[10][2] == 8
    assert simhash.near_duplicates(empty(docs)).count() == 0


def test_decontamination_both_ways_equal_brute_force(spark, docs):
    bench = spark.createDataFrame([(1, PASSAGE.upper()), (2, "one, two"), (3, None), (4, "..."), (2, "one, two")], "item_id long, text string")
    ways = [{(r["doc_id"], r["n_words"], r["n_hit"], tuple(sorted(r["items"]))) for r in decontaminate.find_leaks(docs, bench, most).collect()} for most in (1000, 1)]
    assert ways[0] == ways[1]
    hit = {r[0]: r for r in ways[0] if r[2]}
    assert set(hit) == {5, 6, 7} and hit[6][2] == 60 and hit[5][2:] == (2, ("2",))
    span = decontaminate.find_leaks(docs, bench).where("doc_id = 7").first()["spans"][0]
    assert dict(ROWS)[7][span["start"] : span["end"]] == PASSAGE
    assert decontaminate.find_leaks(docs, bench.where("false")).where("n_hit > 0").count() == 0


def test_substring_dedup_equals_brute_force(docs):
    seen, gone = {}, {}
    for i, t in sorted({r for r in ROWS}, key=lambda r: r[0]):
        w = words(t)
        for k in range(len(w) - 19):
            if seen.setdefault(tuple(w[k : k + 20]), (i, k)) != (i, k):
                gone.setdefault(i, set()).update(range(k, k + 20))
    got = substring_dedup.deduplicate(docs.drop("n_words")).collect()
    assert len(got) == len(ROWS) and "h" in got[0].asDict()
    for r in got:
        w, out = words(dict(ROWS)[r["doc_id"]]), gone.get(r["doc_id"], set())
        assert (r["n_words"], r["n_removed"]) == (len(w), len(out))
        assert words(r["kept_text"]) == [x for k, x in enumerate(w) if k not in out]
    assert substring_dedup.deduplicate(empty(docs)).count() == 0


def test_bpe_round_trip_and_reference_merges(spark, docs):
    import public_tokenizers as p
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(p.path("byte_bpe_50k.tiktoken"), "rb"))}
    codec = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder = byte_bpe.Encoder(spark, p.path("byte_bpe_50k.tiktoken"))
    for limit in (1000, 3):  # most pieces from the dictionary, most folded in their row
        for r in encoder.decode(encoder.encode(docs.select("doc_id", "text", "h"), limit)).collect():
            t = dict(ROWS)[r["doc_id"]] or ""
            assert r["ids"] == codec.encode_ordinary(t) and bytes(r["decoded"]).decode() == t
    assert encoder.encode(empty(docs).select("doc_id", "text")).count() == 0


def test_shards_fit_and_cover(spark, docs):
    got = sharding.shard(docs, 8000).collect()
    assert len(got) == len(ROWS)
    assert all(r["shard_bytes"] <= 8000 or r["shard_docs"] == 1 for r in got)
    names = {r["shard"].split(".")[0] for r in got}
    assert not any(a != b and b.startswith(a) for a in names for b in names)
    same = spark.createDataFrame([(1, "x" * 100)] * 50, "doc_id long, text string")
    assert all(r["shard_bytes"] <= 300 for r in sharding.shard(same, 300).collect())
    assert sharding.shard(empty(docs)).count() == 0


def test_url_rules(spark):
    urls = ["http://a.example.net/en/1", "http://EXAMPLE.net/EN/1", "https://net/", "http://net", "x.net/", None, "http://x.example.com/de/?a=1", "http://y.org/fr/2#z", "http://fakenet/", "https://q.example.org/es/5?x=1&y=2"] * 3
    got = {r["page_id"]: r for r in url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [got[i]["rule"] for i in range(10)] == ["example.net/en/", "net/", "net/", None, None, None, "example.com/de/", "org/fr/", None, None]
    assert [got[i]["host"] for i in (1, 4, 5, 6)] == ["example.net", "", "", "x.example.com"] and got[6]["path"] == "/de/"
    assert all(r["verdict"] in ("allow", "block") for r in got.values()) and got[0]["verdict"] == got[10]["verdict"] == "allow"
    plain = url_filter.filter_urls(spark.createDataFrame([(1, "http://a.b/")], "page_id long, url string")).first()
    assert plain["verdict"] == "allow"


def test_toxicity_learns_held_out_labels(spark):
    rng = np.random.default_rng(2)
    rows = [(i, text(60, i) + (" zorb grack" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(300)] + [(900, None, 0), (901, "", 0)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if rng.random() < 0.9], "doc_id long, toxic int")
    got = {r["doc_id"]: r["toxic_score"] for r in toxicity.score_toxicity(docs, toxicity.train(docs, labels)).collect()}
    assert all((got[i] >= 0.7) == bool(y) for i, _, y in rows)
    assert toxicity.train(docs, labels.where("toxic = 0")) is None


def test_language_of_held_out_texts(spark):
    sample = {"aa": "kira lomu tesa ", "bb": "zwixt qorgh bjalv "}
    rows = [(i, " ".join(np.random.default_rng(i).permutation((sample[k] * 20).split())), k) for i, k in enumerate(["aa", "bb"] * 40)] + [(500, "123 ...", None), (501, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in language_id.identify(docs.drop("lang"), language_id.train(docs)).collect()}
    assert all(got[i][0] == k for i, _, k in rows[:80]) and got[500] == got[501] == ("und", 0.0)
    assert language_id.train(docs.where("false")) is None


def test_language_model_sums_and_normalises(spark, docs):
    training = docs.where("doc_id % 2 = 0")
    c = Counter(w for i, t in ROWS if i % 2 == 0 for w in lm_scoring.tokens(t))
    n, v = sum(c.values()), len(c)
    got = lm_scoring.score(docs, training).collect()
    assert len(got) == len(ROWS)
    for r in got:
        w = lm_scoring.tokens(dict(ROWS)[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert np.isclose(r["base_score"], sum(np.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        assert r["score"] < 0
    table = lm_scoring.train_nce(np.random.default_rng(1).integers(0, 9, (12, 12)).astype(float))
    assert np.allclose((10.0 ** table.astype(float)).sum(axis=1), 1, atol=1e-4)


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:2]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
        docs = out


def test_language_model_grows_with_the_words(spark):
    """Each of 1,500 frequent words has one successor; those beyond the 1,022 first know theirs too."""
    names = [f"v{i:04d}" for i in range(1500)]
    ring = spark.createDataFrame([(i, " ".join(names[(i * 15 + k) % 1500] for k in range(1500))) for i in range(100)], "doc_id long, text string")
    late = [names[i] for i in range(1100, 1500)]
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score(spark.createDataFrame([(1, " ".join(late)), (2, " ".join(late[::-1]))], "doc_id long, text string"), ring).collect()}
    assert got[1] > got[2] + 200
