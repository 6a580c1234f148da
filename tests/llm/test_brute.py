"""Operators against plain Python, where their results come from long computations."""

import collections
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import regex
import zstandard

from glossarium.llm import decontaminate as de
from glossarium.llm import oracle, quality, substring_dedup, toxicity
from glossarium.llm.wordhash import Words

NAMES = "Tom Mary Ann Zoe Carl Olga".split()


def problem(r, names, numbers):
    a, b, c = names
    m, n, k = numbers
    return [*f"Yesterday {a} bought {m} kg of fresh apples and gave {n} of them to {b} before {c} came along with {k} more bags of pears".split(), f"so {a}", "had", "to", "count", "all", "of", "them", "again", *f"with {b} until they found the {m} kg".split()]


def documents(r):
    """Texts with an item as it is, with other numbers and names, with one slot wrong, with a word more or less, in one case."""
    base = problem(r, ("Tom", "Mary", "Ann"), (3, 5, 9))
    prose = lambda k: " ".join(f"w{r.randrange(90)}" for _ in range(k))
    for _ in range(60):
        w = problem(r, r.sample(NAMES, 3), [r.randrange(2, 60) for _ in range(3)]) if r.random() < 0.7 else list(base)
        if r.random() < 0.3:  # a slot that is filled otherwise the second time
            at = [i for i, x in enumerate(w) if x[0].isupper() or x.isdigit()][-1]
            w[at] = "Bob" if w[at][0].isupper() else "77"
        for _ in range(r.randrange(3)):
            w.insert(r.randrange(len(w)), "really")
        if r.random() < 0.2:
            del w[r.randrange(len(w))]
        t = " ".join(w)
        yield r.choice([t, t, t.lower(), t.replace(" ", "\n", 3), f"{t} {t}", f"{prose(6)}: {t[0].lower()}{t[1:]}. {prose(4)}", t + ". " + " ".join(base)])
    yield from [None, "", prose(40), "what is the capital of France?", "What is the Capital of france", " ".join(base[:12]), "5 kg 5 kg 5 kg 5 kg"]


ITEMS = [(1, " ".join(problem(None, ("Tom", "Mary", "Ann"), (3, 5, 9)))), (2, "What is the capital of France?"), (3, "one apple and two pears and one apple and two pears and one apple and two pears"), (4, None), (5, "a b"), (6, "5 kg 5 kg 5 kg 5 kg")]


def canonical(text):
    raw = [x for x in regex.split(r"[\x20\x09-\x0D]+", regex.sub(r"[^\p{L}\p{N}\x20\x09-\x0D]+", "", text or "")) if x]
    form = ["#n" if regex.match(r"\p{N}", x) else "#p" if regex.match(r"\p{Lu}\p{Ll}", x) else x.lower() for x in raw]
    return ["#u" if k and form[k - 1] == "#n" and x in de.UNITS else x for k, x in enumerate(form)], raw


def brute(docs, items):
    out = {}
    for doc, text in docs:
        form, raw = canonical(text)
        for item, said in items:
            iform, iraw = canonical(said)
            places = [p for p in range(len(iform) - 7) if sum(c[0] != "#" for c in iform[p : p + 8]) >= 4]
            hits = {}
            for p in places:
                f, s = iform[p : p + 8], iraw[p : p + 8]
                low = [x.lower() if c == "#p" else c for c, x in zip(f, s)]
                for form8 in (f, low, [low[0]] + f[1:] if p == 0 else f):
                    for pos in range(len(form) - 7):
                        if form[pos : pos + 8] == form8:
                            hits[pos, p] = form8
            votes = Counter(pos - p for pos, p in hits)
            best = {}
            for pos, p in hits:
                best[pos] = min(best.get(pos, (1, 0, 0)), (-votes[pos - p], pos - p, p))
            occurrences, last = [], None
            for d, pos, p in sorted((d, pos, p) for pos, (_, d, p) in best.items()):
                if last is None or d - last >= 8:
                    occurrences.append([])
                occurrences[-1].append((pos, p))
                last = d
            seen, changed = set(), False
            for one in occurrences:
                slots = lambda pos, p: [(hits[pos, p][j], iraw[p + j], raw[pos + j], pos + j) for j in range(8) if hits[pos, p][j][0] == "#"]
                votes_of = defaultdict(Counter)
                for kind, was, now, _ in {s for w in one for s in slots(*w)}:
                    votes_of[kind, was][now] += 1
                chosen = {}
                for (kind, was), c in votes_of.items():
                    now = next((x for x, v in c.items() if 3 * v >= 2 * c.total()), was if was in c else None)
                    if now is not None:
                        chosen[kind, was] = (c[now], now)
                keeper = {}
                for (kind, was), (v, now) in chosen.items():
                    keeper[kind, now] = min(keeper.get((kind, now), (1, True, "")), (-v, now != was, was))
                for w in one:
                    own = slots(*w)
                    if all(chosen.get(s[:2], (0, None))[1] == s[2] and keeper[s[0], s[2]][2] == s[1] for s in own):
                        seen.add(w[1])
                        changed |= any(s[1] != s[2] for s in own)
            rows = [(len(seen), len(seen) / len(places), changed)] if seen and len(seen) / len(places) >= 0.5 else []
            if not any(places[k] > 0 for k in range(len(places))) and len(iraw) >= 3:
                low, ilow = [x.lower() for x in raw], [x.lower() for x in iraw]
                if any(low[k : k + len(ilow)] == ilow for k in range(len(low))):
                    rows.append((1, 1.0, False))
            if rows:
                out[doc, item] = tuple(max(c) for c in zip(*rows))
    return out


@pytest.mark.parametrize("few", [200_000, 0])
def test_decontamination_against_all_windows_and_diagonals(spark, monkeypatch, few):
    monkeypatch.setattr(de, "BROADCAST", few)
    docs = list(enumerate(documents(random.Random(6))))
    want = brute(docs, ITEMS)
    got = {(r["doc_id"], r["item_id"]): (r["n_windows"], r["coverage"], r["changed"]) for r in de.matches(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(ITEMS, "item_id long, text string")).collect()}
    assert got == want and 25 < sum(k[1] == 1 for k in want) < 55 and {k[1] for k in want} >= {1, 2, 6}


def test_decontamination_against_sql():
    docs = list(enumerate(documents(random.Random(8))))
    con = duckdb.connect()
    for name, key, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", ITEMS)):
        con.execute(f"create table {name} ({key} bigint, text varchar)")
        con.executemany(f"insert into {name} values (?, ?)", rows)
    got = {(d, i): (n, c, x) for d, i, n, c, x in con.execute(f"select doc_id, item_id, n_windows, coverage, changed from ({oracle.op1()})").fetchall()}
    assert got == brute(docs, ITEMS)


def test_an_inserted_word_does_not_hide_a_wrong_slot(spark):
    item = "Today Tom has 3 apples and Mary gives him 5 kg of old apples before Mary walks home alone with all the other apples"
    wrong = item.replace("Mary gives", "Ann gives").replace("Mary walks", "Zoe walks")
    docs = spark.createDataFrame([(0, wrong), (1, wrong.replace("of old", "of very old")), (2, wrong.replace("Zoe", "Ann")), (3, item.replace("Tom", "Bob").replace("Today", "Monday"))], "doc_id long, text string")
    found = {r["doc_id"]: r["changed"] for r in de.matches(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert found == {2: True, 3: True}


def test_one_wrong_slot_does_not_hide_a_copy(spark):
    """A copy whose second Mary is called otherwise; one with other names, of which one place in three deviates; two names made one."""
    item = "Today Tom has 3 apples and Mary gives him 5 kg of old apples before Mary walks home alone with all the other apples"
    long = "One day Tom met a very old man who asked him for bread and then Tom went back home to ask for it and there Tom sat down with them all to eat what was left of it"
    other = long.replace("Tom", "Bob")
    docs = [(0, item.replace("Mary walks", "Marie walks")), (1, "so: " + item.replace("Mary gives", "Marie gives") + ". and on"), (2, item.replace("Mary gives", "Ann gives").replace("Mary walks", "Zoe walks")), (3, other), (4, other.replace("Bob sat", "Carl sat")), (5, item.replace("Tom", "Ann").replace("Mary", "Ann")), (6, item.replace("Tom", "X1").replace("Mary", "Tom").replace("X1", "Mary"))]
    found = {(r["doc_id"], r["item_id"]): r["changed"] for r in de.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item), (2, long)], "item_id long, text string")).collect()}
    assert found == {(0, 1): False, (1, 1): False, (3, 2): True, (4, 2): True, (5, 1): True, (6, 1): True}
    assert found.keys() == brute(docs, [(1, item), (2, long)]).keys()


def test_risk_gradient_by_finite_differences():
    r = np.random.default_rng(1)
    for shift in (0.0, -3.0):  # the second: the risk on negatives is below zero, and its reversed gradient is the one of -minus
        p, u, prior = r.normal(size=5), r.normal(size=7) + shift, 0.3
        risk, to_p, to_u = toxicity.risk_gradient(p, u, prior)
        soft = lambda z: np.logaddexp(0, z)
        minus = lambda p, u: soft(u).mean() - prior * soft(p).mean()
        whole = (lambda p, u: prior * soft(-p).mean() + minus(p, u)) if minus(p, u) >= 0 else (lambda p, u: -minus(p, u))
        for x, g, at in ((p, to_p, 0), (u, to_u, 1)):
            for k in range(len(x)):
                step = np.zeros(len(x))
                step[k] = 1e-6
                args = [(p + step, u), (p - step, u)] if at == 0 else [(p, u + step), (p, u - step)]
                assert g[k] == pytest.approx((whole(*args[0]) - whole(*args[1])) / 2e-6, abs=1e-6)
        assert risk == pytest.approx(prior * soft(-p).mean() + max(minus(p, u), 0))


def test_toxicity_scores_one_by_one(spark):
    """Each score is the logistic of the bias and the weights of the distinct words and beginnings that a text has."""
    vocabulary = "moron scum table chair moronic été Ärger 12ab".split()
    hashes = {w: int(Words([w.encode()], True, True).hash[0]) for w in vocabulary}
    hashes |= {f"{w}|{n}": int(Words([w.encode()], True, True).prefixes(n)[0]) for w in vocabulary for n in toxicity.PREFIXES}
    weights = {h: (k % 7) / 3 - 1 for k, h in enumerate(sorted(set(hashes.values())))}
    model = toxicity.Model(np.array(sorted(weights), dtype=np.uint64), np.array([weights[h] for h in sorted(weights)]), -0.4, 0.1)
    r = random.Random(2)
    texts = [" ".join(r.choice([*vocabulary, "MORON", "stool"]) for _ in range(r.randrange(12))) + r.choice(["", "!", "\n-scum,"]) for _ in range(40)] + [None, ""]
    got = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, keep=("doc_id",)).collect()
    for row in got:
        own = set()
        for w in regex.findall("[0-9A-Za-z\x80-\U0010ffff]+", texts[row["doc_id"]] or ""):
            one = Words([w.encode()], True, True)
            own |= {int(one.hash[0]), *(int(one.prefixes(n)[0]) for n in toxicity.PREFIXES)}
        assert row["score"] == pytest.approx(1 / (1 + np.exp(0.4 - sum(weights.get(h, 0.0) for h in own))))


def test_quality_scores_one_by_one(spark):
    r = random.Random(3)
    text = lambda words, n: " ".join(r.choice(words) for _ in range(n))
    good, bad = ["river", "house", "garden", "evening"], ["###", "click", "$$$", "FREE"]
    dictionary = lambda words: zstandard.train_dictionary(2000, [text([w + str(k) for w in words for k in range(60)], 60).encode() for _ in range(200)], level=quality.LEVEL).as_bytes()
    model = quality.Model(dictionary(good), dictionary(bad), 30.0, 0.2)
    texts = [text(good + bad, n) for n in (1, 5, 80, 400, 1500)] + ["é" * 600, "", None]
    for row in quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, keep=("doc_id",)).collect():
        raw = (texts[row["doc_id"]] or "").encode()
        size = {}
        for name, d in (("good", model.good), ("bad", model.bad)):
            z = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), compression_params=zstandard.ZstdCompressionParameters.from_level(quality.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))
            size[name] = sum(len(z.compress(raw[k : k + quality.BLOCK])) for k in range(0, len(raw), quality.BLOCK))
        x = (size["bad"] - size["good"]) / max(size["bad"] + size["good"], 1)
        assert row["difference"] == pytest.approx(x) and row["score"] == pytest.approx(1 / (1 + np.exp(-(30 * x + 0.2))))


def test_held_out_is_the_crc_rule(spark):
    rows = toxicity.classify(spark.range(50).selectExpr("id as doc_id", "'x' as text"), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


@pytest.mark.parametrize("words", [0, 30, 57, 58, 4000])
def test_frequent_pieces(words):
    """Pieces that stand OFTEN times or more among those counted together, and how often."""
    r = random.Random(words)
    texts = [" ".join(r.choices("abc", k=words)), " ".join(["x"] * words), "", "short text"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc", "text"])
    got = Counter({p: n for b in substring_dedup._count(50, 3)(iter([batch])) for p, n in zip(*(c.to_pylist() for c in b.columns), strict=True)})
    want = Counter()
    for t in texts:
        w = t.split()
        if len(w) >= 50:
            want.update(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    assert sorted(got.values()) == sorted(n for n in want.values() if n >= substring_dedup.OFTEN)


def test_samples_are_bounded_where_one_id_repeats(spark):
    """One labelled id in 30,000 rows, and 30,000 texts under one id."""
    from glossarium.llm import common

    copies = spark.range(30_000).selectExpr("2L as doc_id", "'the same words' as text")
    texts = spark.range(30_000).selectExpr("3L as doc_id", "concat('text ', id) as text")
    others = spark.createDataFrame([(k, f"other {k}") for k in range(100)], "doc_id long, text string")
    docs = copies.unionByName(texts).unionByName(others)
    labels = spark.createDataFrame([(2, 1), (2, 0), (2, 1), (3, 1), *((k, 0) for k in range(10, 40))], "doc_id long, toxic int")
    got = collections.Counter(r["label"] for r in common.labelled_sample(docs, labels, "toxic", 500).collect())
    assert got[1] == 500 and got[0] == sum(zlib.crc32(str(k).encode()) % 5 != 0 for k in range(10, 40))
    assert {tuple(r) for r in common.labelled_sample(copies, labels, "toxic", 500).collect()} == {(2, "the same words", 1)} and common.labelled_sample(copies, labels, "toxic", 500).count() == 1
    assert common.few_texts(docs, 700, 12).count() == 700
    assert sorted(tuple(r) for r in common.known_labels(labels, "toxic").filter("doc_id < 10").collect()) == [(2, 1), (3, 1)]


def test_fits_say_the_same_whatever_the_partitions(spark):
    r = random.Random(9)
    rows = [(k, " ".join(r.choice(["moron", "table", "chair", "lamp", "door"]) for _ in range(9)) if k % 5 == 0 else " ".join(r.choice(["table", "chair", "lamp", "door"]) for _ in range(9))) for k in range(300)] + [(500, None), (501, ""), (None, "moron"), (502, "moron " * 200_000)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(0, 300, 2)], "doc_id long, toxic int")
    one, two = (toxicity.classify(docs.repartition(n), labels).orderBy("doc_id", "score").collect() for n in (1, 5))
    assert [r["doc_id"] for r in one] == [r["doc_id"] for r in two] and [r["score"] for r in one] == pytest.approx([r["score"] for r in two], abs=1e-4)
    assert one[-1]["doc_id"] == 502 and one[-1]["predicted"] == 1 and len(one) == len(rows)
