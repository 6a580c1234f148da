"""Every operator and stage on rows without or with repeated ids, repeated rows, clashing column names, empty tables and long texts."""

import hashlib
import random
import zlib

import corpus_pipeline
import pytest

from glossarium.llm import decontaminate, fingerprint, jaccard_join, license_scan, packing, quality, secrets, substring_dedup, toxicity, warc, wordhash
from glossarium.llm.queries import tokenizer_path

#: Names that operators use, or used, inside.
CLASHING = "_id _values _dirty _row _text _gone _toxicity row row_id row_a gone score whole values line ROW_B a.b lang".split()
ITEM = "Today Tom has 3 apples and Mary gives Tom 5 kg of old apples before he walks home"
LEAK = 'see token = "1eb9c654e721b4f812088970e66a6345cee33dd6" here'
OTHER = 'see token = "aab9c654e721b4f812088970e66a6345cee33d99" here'


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(900)}" for _ in range(n))


def table(spark, rows):
    schema = "doc_id long, text string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(i, t, 1, *CLASHING) for i, t in rows], schema)


ROWS = [(None, LEAK), (None, OTHER), (None, "plain"), (None, None), (5, prose(60, 1)), (1, prose(60, 1)), (5, prose(60, 2)), (7, ITEM), (7, "clean words"), (None, ITEM), (8, ""), (8, ""), (9, LEAK), (9, "1eb9c654e721b4f812088970e66a6345cee33dd6 is named")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("awkward")
    spark.createDataFrame([(1, ITEM), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    spark.createDataFrame([(k, k % 2, k % 2) for k in range(9)] + [(None, 1, None)], "doc_id long, toxic int, quality int").write.parquet(f"{top}/labels.parquet")
    return str(top)


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_stages_decide_by_rows(spark, folder):
    docs = table(spark, ROWS)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.schema == docs.schema
        kept[name] = pairs(out)
        assert stage(spark, docs.filter("false"), folder).collect() == []
    whole = pairs(docs)
    assert [x for x in whole if x not in kept["near_duplicates"]] == [(5, prose(60, 1))]
    assert kept["decontamination"] == [x for x in whole if x[1] != ITEM]
    said = dict.fromkeys(t for _, t in kept["secrets"])
    assert sum("[SECRET]" in (t or "") for _, t in kept["secrets"]) == 3 and "plain" in said and "1eb9c654e721b4f812088970e66a6345cee33dd6 is named" in said
    last = corpus_pipeline.STAGES[-1][1]
    assert len({(r["doc_id"], r["doc_tokens"]) for r in last(spark, docs, folder).collect()}) >= 9 and last(spark, docs.filter("false"), folder).collect() == []


def test_repeated_rows_keep_one(spark):
    docs = table(spark, [(3, prose(30, 4)), (3, prose(30, 4)), (2, prose(30, 4) + " x"), (4, ""), (4, "")])
    assert pairs(jaccard_join.keep_one(docs)) == [(2, prose(30, 4) + " x"), (4, ""), (4, "")]
    got = sorted(tuple(r) for r in jaccard_join.join(docs).collect())
    assert got == [(2, 27, 2, 2), (3, 26, 2, 2), (3, 26, 2, 2), (4, 0, 4, 0), (4, 0, 4, 0)]


def test_one_id_for_two_texts_links_neither(spark):
    docs = table(spark, [(5, prose(30, 1)), (5, prose(30, 2)), (1, prose(30, 1)), (2, prose(30, 2))])
    assert sorted((r["doc_id"], r["component_id"], r["n_links"]) for r in jaccard_join.join(docs).collect()) == [(1, 1, 1), (2, 2, 1), (5, 1, 1), (5, 2, 1)]


def test_scores_of_every_row(spark, folder):
    docs, labels = table(spark, ROWS), spark.read.parquet(f"{folder}/labels.parquet")
    for op in (toxicity, quality):
        rows = op.classify(docs, labels).collect()
        assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 and r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
        assert op.classify(docs.filter("false"), labels).collect() == []


def test_license_rows_each_have_their_own(spark):
    docs = table(spark, [(None, "under the mit license"), (None, "cc by nc"), (1, "under the mit license"), (1, "license"), (2, "cc by nc"), (2, "cc by nc"), (3, "under the"), (3, "mit license")])
    got = sorted(((r["doc_id"], r["base_labels"], r["n_base"], r["n_words"]) for r in license_scan.scan(docs).collect()), key=str)
    assert got == sorted([(None, "mit", 1, 4), (None, "cc-by-nc", 1, 3), (1, "mit", 1, 4), (1, "", 0, 1), (2, "cc-by-nc", 1, 3), (2, "cc-by-nc", 1, 3), (3, "", 0, 2), (3, "", 0, 2)], key=str)
    found = license_scan.scan(docs, phrases=[("x", "the mit license")], texts=[("y", "a b c d")]).collect()
    assert sorted(str(r["doc_id"]) for r in found if r["n_base"]) == ["1", "None"] and len(found) == 8
    with pytest.raises(ValueError, match="3 words"):
        license_scan.scan(docs, phrases=[("x", "under the")])


def test_fingerprints_of_tied_and_null_ids(spark):
    """Both the edit and near_next speak of the same next row."""
    r = random.Random(3)
    rows = [(r.choice([1, 1, 1, 2, 3, 3, 4, 9, 9]), prose(40, r.randrange(6))) for _ in range(24)] + [(None, prose(40, 30 + k)) for k in range(3)] + [(3, None), (9, "")]
    bins = {t: {x["fingerprint"] for x in fingerprint.fingerprints(table(spark, [(0, t)])).collect()}.pop() for t in {t or "" for _, t in rows}}

    def like(a, b):
        if not bins[a] or not bins[b]:
            return float(bins[a] == bins[b])
        same = sum(bins[a][k : k + 2] == bins[b][k : k + 2] for k in range(0, 512, 2)) / 256
        return max(0.0, (same - 1 / 256) / (1 - 1 / 256))

    order = sorted((i, t or "") for i, t in rows if i is not None)
    want = [(i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order)] + [(None, t, t) for i, t in rows if i is None]
    want = sorted(((i, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest(), round(like(t, n), 9)) for i, t, n in want), key=str)
    got = sorted(((x["doc_id"], x["n_chars"], x["edited_sha256"], round(x["near_next"], 9)) for x in fingerprint.edited_fingerprints(table(spark, rows).repartition(3)).collect()), key=str)
    assert got == want


def test_windows_whose_hashes_collide(spark, monkeypatch):
    """With one hash for all windows the text alone decides, and frequent pieces change nothing."""
    shared = prose(70, 5).split()
    texts = {7: " ".join(shared), 3: prose(40, 6) + " " + " ".join(shared[:60]) + " " + prose(30, 7), 9: " ".join(shared[5:]) + " " + prose(60, 8), 11: prose(60, 8)}
    want = sorted(tuple(r) for r in substring_dedup.digests(table(spark, texts.items())).collect())
    assert sum(x[2] for x in want) > 100
    monkeypatch.setattr(substring_dedup, "long_windows", lambda w, k: wordhash.long_windows(w, k) % 2)
    assert sorted(tuple(r) for r in substring_dedup.digests(table(spark, texts.items())).collect()) == want
    monkeypatch.undo()
    monkeypatch.setattr(substring_dedup, "FREQUENT", 1)
    monkeypatch.setattr(substring_dedup, "OFTEN", 1)
    assert sorted(tuple(r) for r in substring_dedup.digests(table(spark, texts.items())).collect()) == want


def test_substring_rows(spark):
    t = prose(60, 1)
    rows = [(None, t), (5, t), (5, t), (5, prose(60, 2)), (6, t), (6, None)]
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.dedup(table(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 60, 0), (5, 60, 0), (5, 60, 0), (5, 60, 0), (6, 60, 60), (6, 0, 0)], key=str)


def test_long_texts(spark, folder, monkeypatch):
    """Texts of many chunks are read in pieces, with the same results as whole; other operators read them too."""
    texts = {1: prose(3000, 1) + " " + "z" * 700 + " " + prose(500, 2), 2: prose(400, 3) + " " + prose(3000, 1), 3: prose(500, 2)}
    whole = [sorted(tuple(r) for r in op(table(spark, texts.items())).collect()) for op in (substring_dedup.digests, jaccard_join.join)]
    monkeypatch.setattr(wordhash, "CHUNK", 2000)
    monkeypatch.setattr(substring_dedup, "CHUNK", 2000)
    monkeypatch.setattr(jaccard_join, "CHUNK", 2000)
    assert [sorted(tuple(r) for r in op(table(spark, texts.items())).collect()) for op in (substring_dedup.digests, jaccard_join.join)] == whole
    monkeypatch.undo()
    long = table(spark, [(1, prose(400_000, 1)), (2, "x" * 1_000_000 + " " + prose(200_000, 1)), (3, ITEM)])  # 2 MB each
    assert {r["doc_id"]: r["n_words"] for r in substring_dedup.digests(long).collect()} == {1: 400_000, 2: 200_001, 3: 18}
    assert jaccard_join.join(long).count() == fingerprint.edited_fingerprints(long).count() == license_scan.scan(long).count() == 3
    assert [r["doc_id"] for r in decontaminate.matches(long, spark.read.parquet(f"{folder}/benchmark.parquet")).collect()] == [3]
    assert sum(r["length"] for r in packing.pack(long, tokenizer_path()).collect()) > 600_000
    assert secrets.candidates(long).count() == 0


def test_packing_of_awkward_rows(spark):
    rows = packing.pack(table(spark, ROWS), tokenizer_path()).collect()
    assert sorted(str(r["doc_id"]) for r in rows if r["start"] == 0) == sorted(str(i) for i, _ in ROWS)
    assert packing.pack(table(spark, []), tokenizer_path()).collect() == []


def test_other_tokenizers_encode_whole_texts(tmp_path):
    import json

    from tokenizers import Tokenizer

    d = json.load(open(tokenizer_path(), encoding="utf-8"))
    d["normalizer"] = {"type": "NFC"}  # keeps capitals
    e, t = packing.WordEncoder(json.dumps(d)), Tokenizer.from_str(json.dumps(d))
    ids, counts = e.encode(["The Old house", "the"])
    assert not e.by_word and ids.tolist() == t.encode("The Old house").ids + t.encode("the").ids and counts.sum() == len(ids)


def test_repeated_pages(spark, tmp_path):
    big = "y" * 1500
    pages = spark.createDataFrame([(1, "http://a.com", big), (1, "http://a.com", big), (2, "http://b.com", big), (2, "http://b.com", big), (3, "http://c.com", "q"), (3, "http://d.com", "r")], "page_id long, url string, html string")
    got = sorted((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.round_trip(pages, f"file://{tmp_path}/w").collect())
    assert got == [(1, "revisit", 2, 1500)] * 2 + [(2, "response", None, 1500)] * 2 + [(3, "response", None, 1)] * 2
