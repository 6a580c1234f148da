"""The pipeline over a small folder: what each stage drops, and that awkward rows pass."""

import random
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np


def test_stages(spark, tmp_path):
    r = random.Random(1)
    text = lambda n: " ".join(f"w{r.randrange(500)}" for _ in range(n))
    base, item = text(80), text(20)
    docs = [(0, base), (1, base + " end"), (2, text(60) + " " + item), (3, text(50) + ' token = "1eb9c654e721b4f812088970e66a6345cee33dd6"'), (4, None), (5, ""), (6, text(3000))]
    docs += [(10 + k, text(30) + (" moron" if k % 4 == 0 else "")) for k in range(120)]
    rows = [(i, t, "en", "s", len(t or ""), 0.1) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(10 + k, int(k % 4 == 0), 1) for k in range(120)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, str(tmp_path))
        assert out.columns == table.columns
        out.write.parquet(f"{tmp_path}/{name}")
        table = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {x["doc_id"]: x["text"] for x in table.collect()}
    assert not any("moron" in (t or "") for t in seen["toxicity"].values()) and len(seen["toxicity"]) == 97
    assert set(seen["toxicity"]) - set(seen["near_duplicates"]) == {1}
    assert set(seen["near_duplicates"]) - set(seen["decontamination"]) == {2}
    assert seen["secrets"][3].endswith('token = "[SECRET]"') and set(seen["secrets"]) == set(seen["decontamination"])
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x["doc_id"] for x in packed} == set(seen["secrets"])


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()


def test_against_brute_force(spark, tmp_path):
    """Toxic words that nothing else has, groups of near copies, copies of an item, secrets of one form: what is left, and in which
    words, is worked out in plain Python; the pieces hold exactly its tokens."""
    from tokenizers import Tokenizer

    from glossarium.llm.queries import tokenizer_path

    r = random.Random(3)
    text = lambda n: " ".join(f"w{r.randrange(700)}" for _ in range(n))
    items = [text(20), text(30)]
    docs, toxic = {}, set()
    for k in range(160):
        docs[k] = text(30) + (r.choice([" moron ", " scum "]) * 2 if k % 4 == 0 else "")
        toxic |= {k} if k % 4 == 0 else set()
    for g in range(12):
        base = text(90).split()
        for k in range(r.randrange(1, 6)):
            w = list(base)
            for j in range(r.choice([0, 1, 2, 9])):
                w[r.randrange(90)] = f"x{g}{k}{j}"
            docs[1000 + 10 * g + k] = " ".join(w)
    docs |= {2000 + k: f"{text(40)} {items[k % 2]} {text(9)}" for k in range(6)}
    docs |= {3000 + k: f'{text(30)} token = "{r.randbytes(20).hex()}" {text(5)}' for k in range(8)} | {4000: None, 4001: "", 4002: text(30_000)}
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs.items()]
    r.shuffle(rows)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    write(rows, schema, "documents"), write([(k, int(k in toxic), 1) for k in range(160)], "doc_id long, toxic int, quality int", "labels"), write(list(enumerate(items)), "item_id long, text string", "benchmark")

    left = {i: t for i, t in docs.items() if i not in toxic}
    sets = {i: s for i, t in left.items() if (s := shingles(t))}
    root = {i: i for i in sets}
    for _ in range(6):
        for i in sets:
            for j in sets:
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    left = {i: t for i, t in left.items() if root.get(i, i) == i and not any(x in (t or "") for x in items)}
    want = {i: t if t is None else re.sub('token = "[0-9a-f]{40}"', 'token = "[SECRET]"', t) for i, t in left.items()}
    assert len(docs) - 40 - 6 > len(want) and sum("[SECRET]" in (t or "") for t in want.values()) == 8
    t = Tokenizer.from_file(tokenizer_path())
    ids = {i: np.array(t.encode(x or "", add_special_tokens=False).ids + [1], dtype="<u4") for i, x in want.items()}
    at, load = Counter(), Counter()
    for x in sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda x: (x["doc_id"], x["start"])):
        own = ids[x["doc_id"]]
        assert x["start"] == at[x["doc_id"]] and x["doc_tokens"] == len(own) and x["ids_crc32"] == zlib.crc32(own[x["start"] : x["start"] + x["length"]].tobytes())
        at[x["doc_id"]] += x["length"]
        load[x["sequence_id"]] += x["length"]
    assert at == {i: len(x) for i, x in ids.items()} and max(load.values()) <= 2048


def test_of_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, toxic int, quality int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
